"""Scans of JSON lines under the contracts of their consumers.

Spark's JSON reader takes trailing junk, turns numbers into strings and drops blank lines, so lines are read as text with their file and
place and parsed strictly by an Arrow function. A scan gives rows with ``ok`` and ``reason``; a strict scan raises on the first reasons, a tolerant one counts them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType


class ContractError(ValueError):
    """Rows that a strict scan does not take."""


def numbered_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, line, value): all lines of the files under ``path``, numbered from 1 in each file.

    Whole files are kept in one partition each by reading them as single text values, so numbers are the files' own.
    """
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    body = F.regexp_replace("value", r"\n\z", "")
    rows = files.where(F.length("value") > 0).select("file", F.posexplode(F.split(body, "\r\n|\n")).alias("pos", "value"))
    return rows.select("file", (F.col("pos") + 1).cast("long").alias("line"), "value")


@F.pandas_udf(StructType().add("ok", BooleanType()).add("reason", StringType()).add("id", StringType()).add("pair_id", StringType()).add("text", StringType()))
def _strict(values: pd.Series) -> pd.DataFrame:
    rows = []
    for value in values:
        if not value.strip():
            rows.append((False, "blank", None, None, None))
            continue
        try:
            row = json.loads(value)
        except (ValueError, RecursionError):
            rows.append((False, "bad json", None, None, None))
            continue
        if not isinstance(row, dict):
            rows.append((False, "not an object", None, None, None))
            continue
        text = lambda k: row[k] if isinstance(row.get(k), str) else None  # noqa: B023, E731
        rows.append((True, None, text("sample_id"), text("pair_id"), text("text")))
    return pd.DataFrame(rows, columns=["ok", "reason", "id", "pair_id", "text"])


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``ok``, ``reason`` and the strings ``id``, ``pair_id`` and ``text`` of strictly parsed objects (null if no string)."""
    return lines.withColumn("_p", _strict("value")).select(*lines.columns, "_p.*")


@dataclass(frozen=True)
class Contract:
    """What a consumer makes of lines."""

    skip_blank: bool = False
    need_id: bool = False
    need_text: bool = False
    unique_id: bool = False


#: The consumers' contracts: relabelling, evaluation, dataset build, dataset reader, corpus audit.
RELABEL = Contract(need_id=True, unique_id=True)
EVALUATION = Contract()
BUILD = Contract()
DATASET = Contract(skip_blank=True)
CORPUS = Contract(skip_blank=True, need_text=True)


def checked_lines(lines: DataFrame, contract: Contract) -> DataFrame:
    """Parsed lines with the contract's verdict in ``ok`` and ``reason``; skipped lines are gone."""
    rows = parsed_lines(lines)
    if contract.skip_blank:
        rows = rows.where(~F.col("reason").eqNullSafe("blank"))
    reason = F.col("reason")
    if contract.need_id:
        reason = F.coalesce(reason, F.when(F.coalesce(F.col("id"), F.lit("")) == "", "no sample_id"))
    if contract.need_text:
        reason = F.coalesce(reason, F.when(F.col("text").isNull(), "no text"))
    rows = rows.withColumn("reason", reason)
    if contract.unique_id:
        times = rows.where("id is not null").groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        rows = rows.join(times, F.col("id") == F.col("_id"), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_n") > 1, "duplicate sample_id"))).drop("_id", "_n")
    return rows.withColumn("ok", F.col("reason").isNull())


def strict(rows: DataFrame, key: str = "line", shown: int = 5) -> DataFrame:
    """``rows`` if all are ok; else ContractError with the first few reasons."""
    if bad := rows.where("not ok").orderBy(*(c for c in ("file", key) if c in rows.columns)).limit(shown).collect():
        raise ContractError("; ".join(f"{r['file']}:{r[key]}: {r['reason']}" if "file" in rows.columns else str(r["reason"]) for r in bad))
    return rows.drop("ok", "reason")


def tolerant(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row with the count ``malformed``)."""
    return rows.where("ok").drop("ok", "reason"), rows.agg(F.count_if(~F.col("ok")).alias("malformed"))


def read_records(spark: SparkSession, path: str, schema: str, contract: Contract = RELABEL, glob: str = "chunk_*.jsonl") -> DataFrame:
    """Typed records of all chunk files (strict), with ``_file`` and ``_line``; no files or a broken contract raise."""
    lines = numbered_lines(spark, path, glob)
    if lines.isEmpty():
        raise ContractError(f"no {glob} in {path}")
    rows = strict(checked_lines(lines, contract))
    return rows.select(F.col("file").alias("_file"), F.col("line").alias("_line"), F.from_json("value", schema).alias("r")).select("_file", "_line", "r.*")


def resumable(lines: DataFrame, chunk: int, expected: int) -> Column | bool:
    """Whether a chunk's lines are all there: its row count, and ids that begin with ``cNNN-``."""
    rows = parsed_lines(lines).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("ok") & F.col("id").startswith(f"c{chunk:03d}-"), F.lit(False))).alias("fine")).first()
    return rows["n"] == expected and bool(rows["fine"])


def unique_map(rows: DataFrame, key: str = "sample_id", needed: tuple[str, ...] = ("type_identifiable",)) -> DataFrame:
    """A lookup table checked for non-empty unique keys and non-null values."""
    reason = F.coalesce(F.when(F.coalesce(F.col(key), F.lit("")) == "", f"no {key}"), *(F.when(F.col(c).isNull(), f"no {c}") for c in needed), F.when(F.count(F.lit(1)).over(Window.partitionBy(key)) > 1, f"duplicate {key}"))
    return strict(rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()), key)


def with_ordinal(lines: DataFrame) -> DataFrame:
    """Lines with ``ordinal`` from 0 over all files in order of name: chunk offsets (a prefix sum over one row a file) plus place in file."""
    sizes = lines.groupBy("file").agg(F.max("line").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(sizes.select("file", offset.alias("_offset")), "file").withColumn("ordinal", F.col("_offset") + F.col("line") - 1).drop("_offset")


# Images


def listing(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(name, length) of the files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def eligibility(records: DataFrame, images: DataFrame) -> DataFrame:
    """``records`` (sample_id, page) with ``reason``: why one can't be evaluated, null if it can."""
    here = images.select(F.regexp_replace("name", r"\.png$", "").alias("_image")).distinct()
    sized = F.coalesce((F.col("page.w") > 0) & (F.col("page.h") > 0), F.lit(False))
    reason = F.when(F.coalesce(F.col("sample_id"), F.lit("")) == "", "missing_sample_id").when(~sized, "missing_page_size").when(F.col("_image").isNull(), "missing_image")
    return records.join(here, F.col("sample_id") == F.col("_image"), "left").withColumn("reason", reason).drop("_image")


def inside(path: Column) -> Column:
    """Whether a relative path stays below its folder."""
    parts = F.split(path, r"[/\\]")
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..")


def data_uris(spark: SparkSession, path: str, glob: str = "*.png", mime: str = "image/png") -> DataFrame:
    """(name, uri) with the files' contents as base64."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64("content"), r"\s", "")).alias("uri"))
