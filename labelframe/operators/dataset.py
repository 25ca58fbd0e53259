"""Instruction-tuning rows: contracts, teacher answers, prompts, messages, statistics of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.functions import geometry as G

COORDINATES = "座標は左上原点の 0〜1000 の相対座標 [x0,y0,x1,y1] で答えてください。"


def error_free() -> Column:
    """The record's flag, or else whether it has no errors."""
    return F.coalesce(F.col("control_flag.error_free"), F.size("injected_errors") == 0)


def span_boxes() -> Column:
    """(ref, box): the strict union of each error span's boxes, by its reference or place."""
    return F.transform("render.error_span_boxes_px", lambda s, i: F.struct(F.coalesce(s["error_ref"], i).alias("ref"), G.union(s["boxes"], strict=True).alias("box")))


def _box_of(spans: Column, i: Column) -> Column:
    return F.try_element_at(F.filter(spans, lambda s: s["ref"] == i), F.lit(-1))["box"]


def reject_reasons() -> Column:
    """What speaks against a record as training data (array, empty for none)."""
    spans = span_boxes()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fine = lambda b: F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    page = F.coalesce((F.col("render.page.w") > 0) & (F.col("render.page.h") > 0), F.lit(False))
    unboxed = F.exists(F.sequence(F.lit(0), F.size("injected_errors") - 1), lambda i: _box_of(spans, i).isNull())
    return F.array_compact(F.array(
        F.when(blank("sample_id"), "empty sample_id"), F.when(blank("pair_id"), "empty pair_id"), F.when(~page, "bad page size"),
        F.when(F.col("render.error_span_boxes_px").isNull(), "no span boxes"), F.when(F.exists(spans, lambda s: s["box"].isNull() | ~fine(s["box"])), "bad box"),
        F.when((F.size("injected_errors") > 0) & unboxed, "error without a box"), F.when(F.col("transcript_gt.text").isNull(), "no transcript"),
        F.when(error_free() & (F.size("injected_errors") > 0), "error_free with errors"), F.when(~error_free() & (F.size("injected_errors") == 0), "errors expected"),
    ))


def validated(records: DataFrame) -> DataFrame:
    """``records`` with ``reject_reasons``, repeated ids among them."""
    twice = records.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = records.join(twice, "sample_id", "left").withColumn("reject_reasons", reject_reasons())
    return rows.withColumn("reject_reasons", F.concat("reject_reasons", F.when(F.col("_n") > 1, F.array(F.lit("duplicate sample_id"))).otherwise(F.array().cast("array<string>")))).drop("_n")


def teacher() -> Column:
    """The teacher's answer as compact JSON: transcript, errors (step, relative box, type), score, in this order."""
    spans = span_boxes()
    errors = F.transform("injected_errors", lambda e, i: F.struct(e["mutation_site"].alias("step_id"), G.relative(_box_of(spans, i), F.col("render.page.w"), F.col("render.page.h")).alias("bbox"), e["type"].alias("type")))
    return F.to_json(F.struct(F.col("transcript_gt.text").alias("transcript"), errors.alias("errors"), F.col("score_gt.awarded").alias("score")), {"ignoreNullFields": "false"})


def prompt(blocks: list[Column], coordinates: bool = True) -> Column:
    """Blocks parted by blank lines; null blocks are left out."""
    return F.concat_ws("\n\n", *blocks, *([F.lit(COORDINATES)] if coordinates else []))


def solution_text(steps: Column) -> Column:
    """One line ``- id: text`` a step."""
    return F.array_join(F.transform(steps, lambda s: F.concat(F.lit("- "), s["step_id"], F.lit(": "), s["text"])), "\n")


def messages(user: Column, assistant: Column, image: bool = True) -> Column:
    """A user message (with an image part first) and the assistant's answer, as typed parts."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))
    mine = F.array(part("image", F.lit(None)), part("text", user)) if image else F.array(part("text", user))
    return F.array(F.struct(F.lit("user").alias("role"), mine.alias("content")), F.struct(F.lit("assistant").alias("role"), F.array(part("text", assistant)).alias("content")))


def tuning_rows(records: DataFrame) -> DataFrame:
    """id, image, messages, meta of each record."""
    user = prompt([F.col("problem.text_ja"), F.concat(F.lit("模範解答:\n"), solution_text(F.col("gold_solution"))), F.col("rubric.text_ja")])
    meta = F.struct("pair_id", F.col("problem.domain").alias("domain"), F.get("injected_errors", 0)["operator"].alias("operator"), error_free().alias("error_free"))
    return records.select(F.col("sample_id").alias("id"), F.concat(F.lit("images/"), "sample_id", F.lit(".png")).alias("image"), messages(user, teacher()).alias("messages"), meta.alias("meta"))


def without_payload(records: DataFrame, column: str = "injected_errors") -> DataFrame:
    """``records`` without the private field ``_payload`` of each error, if there is one."""
    fields = {f.name for f in records.schema[column].dataType.elementType.fields}
    return records.withColumn(column, F.transform(column, lambda e: e.dropFields("_payload"))) if "_payload" in fields else records


def distribution(rows: DataFrame, value: Column, by: list[str] | None = None, omit_null: bool = False) -> DataFrame:
    """(by, value, n): rows per value as text, in order; null counts as <none> or not at all."""
    rows = rows.where(value.isNotNull()) if omit_null else rows
    return rows.groupBy(*(by or []), F.coalesce(value.cast("string"), F.lit("<none>")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(*(by or []), "value")


def split_stats(rows: DataFrame, split: str, group: str, control: Column) -> DataFrame:
    """Per split and over all (split null): records, distinct groups, errors, controls, errors per control (null without controls)."""
    keep = rows.withColumn("_control", control)
    errors, controls = F.count_if(~F.col("_control")), F.count_if("_control")
    return keep.groupingSets([[F.col(split)], []], split).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(group).alias("pairs"), errors.alias("error_records"), controls.alias("control_records"), F.try_divide(errors.cast("double"), controls).alias("error_to_control_ratio"))
