"""Evaluation: per-record metrics and their aggregates. One implementation for training and evaluation alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.functions import geometry as G
from labelframe.functions import text as T
from labelframe.functions.numbers import share
from labelframe.operators.programs import step_text
from labelframe.operators.relabel import family_of
from labelframe.schema import FAMILIES, FAMILY

HIT = "array<struct<type:string,exact_match:boolean,excluded_ambiguous:boolean,over_claim:boolean,subtype_retained:boolean>>"


def error_boxes(records_relative: bool = False) -> Column:
    """Per injected error its box: the union of its span's boxes (reference: the span's ``error_ref``, else its place; the last one wins)."""
    spans = F.transform("render.error_span_boxes_px", lambda s, i: F.struct(F.coalesce(s["error_ref"], i).alias("ref"), G.union(s["boxes"]).alias("box")))
    mine = lambda i: F.element_at(F.filter(spans, lambda s: s["ref"] == i), -1)["box"]
    found = lambda i: F.when(F.exists(spans, lambda s: s["ref"] == i), mine(i))
    boxes = F.transform("injected_errors", lambda e, i: found(i))
    if not records_relative:
        return boxes
    return F.transform(boxes, lambda b: F.transform(G.relative(b, F.col("render.page.w"), F.col("render.page.h")), lambda v: v.cast("double")))


def mock_predictions(records: DataFrame, relative: bool = False) -> DataFrame:
    """Predictions equal to the truth: evaluation of these must be perfect."""
    boxes = error_boxes(relative)
    errors = F.transform(F.arrays_zip(F.col("injected_errors").alias("e"), boxes.alias("b")), lambda z: F.struct(z["e"]["mutation_site"].alias("step_id"), z["b"].alias("bbox"), z["e"]["type"].alias("type")))
    return records.select("sample_id", F.col("transcript_gt.text").alias("transcript"), errors.alias("errors"), F.col("score_gt.awarded").cast("long").alias("score"), F.lit(None).cast("string").alias("failure"))


def type_hits(gt_type: Column, predicted: Column, ambiguous: Column, retained: Column, coarsen: bool = False) -> Column:
    """The single hit of the three-valued scheme: a family must be named as such, a subtype of it over-claims (never after ``coarsen``)."""
    is_family = gt_type.isin(*FAMILIES)
    kinds = F.when(is_family, F.transform(predicted, family_of)).otherwise(predicted) if coarsen else predicted
    over = is_family & F.exists(kinds, lambda k: F.coalesce(k.isin(*FAMILY) & (family_of(k) == gt_type), F.lit(False)))
    return F.array(F.struct(gt_type.alias("type"), (F.array_contains(kinds, gt_type) & ~over).alias("exact_match"), ambiguous.alias("excluded_ambiguous"), over.alias("over_claim"), retained.alias("subtype_retained"))).cast(HIT)


#: What an identifiable evaluation needs of the relabel map.
LABELS = ("type_identifiable", "ambiguous_cross_family", "subtype_retained")


def truth(records: DataFrame, relative: bool = False, labels: bool = False) -> DataFrame:
    """What an evaluation needs of ``records``, one narrow row each: joins sort and send these instead of whole step programs. ``labels``: with the columns of the relabel map, which the records carry."""
    site = F.get("injected_errors", 0)["mutation_site"]
    needed = {
        "_has_error": ~F.coalesce(F.col("control_flag.error_free"), F.lit(False)), "_types": F.transform("injected_errors", lambda e: F.coalesce(e["type"], F.lit(""))), "_boxes": error_boxes(relative),
        "_text": F.col("transcript_gt.text"), "_at_gold": step_text(F.col("gold_solution"), site), "_at_mutant": step_text(F.col("mutant_solution"), site), "_awarded": F.col("score_gt.awarded").cast("long"),
    }
    return records.select("sample_id", *(v.alias(k) for k, v in needed.items()), *(LABELS if labels else ()))


def evaluated(records: DataFrame, predictions: DataFrame, relative: bool = False, identifiable: bool = False, coarsen: bool = False) -> DataFrame:
    """One row per record that has a prediction: sample_id, parse_failure and the metrics.

    ``predictions``: sample_id, transcript, errors, score, failure. With ``identifiable`` the records must carry type_identifiable,
    ambiguous_cross_family and subtype_retained (``relabel.attach``).
    """
    return rated(truth(records, relative, identifiable), predictions, identifiable, coarsen)


def rated(truths: DataFrame, predictions: DataFrame, identifiable: bool = False, coarsen: bool = False) -> DataFrame:
    """``evaluated`` on rows of ``truth``."""
    p = predictions.select("sample_id", F.col("transcript").alias("_said"), F.col("errors").alias("_errors"), F.col("score").alias("_score"), F.col("failure").alias("failure_reason"))
    rows = truths.join(p.hint("merge"), "sample_id")  # as many rows on either side: never a broadcast, however small their files
    has_error = F.col("_has_error")
    detected = F.size("_errors") > 0
    rows = rows.withColumns({
        "_ref": T.normalize_text("_text"), "_hyp": T.normalize_text("_said"), "_lines": T.normalize_all(T.lines(F.col("_said"))),
        "_gold": T.normalize_text("_at_gold"), "_mutant": T.normalize_text("_at_mutant"),
    })
    boxes = F.filter("_boxes", lambda b: b.isNotNull())
    best = F.when(has_error & detected, G.best_iou(F.transform("_errors", lambda e: e["bbox"]), boxes))
    kinds = F.transform("_errors", lambda e: F.coalesce(e["type"], F.lit("")))
    if identifiable:
        hits = F.when(has_error, type_hits(F.col("type_identifiable"), kinds, F.coalesce("ambiguous_cross_family", F.lit(False)), F.coalesce("subtype_retained", F.lit(False)), coarsen)).otherwise(F.array().cast(HIT))
    else:
        none = F.lit(None).cast("boolean")
        hits = F.transform("_types", lambda t: F.struct(t.alias("type"), F.array_contains(kinds, t).alias("exact_match"), none.alias("excluded_ambiguous"), none.alias("over_claim"), none.alias("subtype_retained"))).cast(HIT)
    failed = F.col("failure_reason").isNotNull()
    over = F.when(has_error, F.coalesce((F.size("_types") > 0) & T.over_corrected(F.col("_lines"), F.col("_gold"), F.col("_mutant")), F.lit(False)))
    score, due = F.col("_score"), F.col("_awarded")
    metrics = {
        "detected_error": detected, "detection_correct": F.when(has_error, detected).otherwise(~detected), "transcript_cer": T.cer(F.col("_ref"), F.col("_hyp")),
        "over_correction": over, "bbox_iou": best, "bbox_iou_at_0_5": best >= 0.5, "type_exact_matches": hits,
        "score_exact_match": score.eqNullSafe(due), "score_within_1": F.coalesce(F.abs(score - due) <= 1, F.lit(False)),
    }
    return rows.select("sample_id", failed.alias("parse_failure"), "failure_reason", has_error.alias("has_error"), *(F.when(~failed, v).alias(k) for k, v in metrics.items()))


def detection_summary(rows: DataFrame, has_error: Column, detected: Column, by: list[str] | None = None) -> DataFrame:
    """TPR, TNR, balanced accuracy and rate of hallucinated errors; null where there is nothing to rate."""
    out = rows.groupBy(*(by or [])).agg(share(detected, has_error).alias("tpr"), (1.0 - share(detected, ~has_error)).alias("tnr"), F.count_if(has_error).alias("n_error_records"), F.count_if(~has_error).alias("n_control_records"))
    return out.withColumns({"bacc": (F.col("tpr") + F.col("tnr")) / 2, "hallucinated_error_rate": 1.0 - F.col("tnr")})


def summary(results: DataFrame, identifiable: bool = False) -> DataFrame:
    """One row of all metrics over the parsed results: failures are counted and left out of everything else.

    IoU is rated over detected error records only. Macro accuracy: the mean per class of the truth, then the mean of the classes; ambiguous hits are left out of it,
    but count in the coverage of subtypes.
    """
    parsed = results.where("not parse_failure")
    err, located = F.col("has_error"), F.col("has_error") & F.col("detected_error")
    base = detection_summary(parsed, err, F.col("detected_error"))
    more = parsed.agg(F.avg("transcript_cer").alias("transcript_cer_mean"), F.percentile("transcript_cer", 0.5).alias("transcript_cer_median"), share(F.col("over_correction"), err).alias("over_correction_rate"), F.avg(F.when(located, F.col("bbox_iou"))).alias("bbox_iou_mean"), share(F.col("bbox_iou_at_0_5"), located).alias("iou_at_0_5"), share(F.col("score_exact_match")).alias("score_exact_match"), share(F.col("score_within_1")).alias("score_within_1"), F.count_if(located).alias("n_location_records"))
    hits = parsed.select(F.explode("type_exact_matches").alias("hit")).select("hit.*")
    included = ~F.coalesce(F.col("excluded_ambiguous"), F.lit(False))
    by_class = macro(hits.where(included), "type", F.col("exact_match"))
    failures = results.agg(F.count_if("parse_failure").alias("n_parse_failures"), F.count(F.lit(1)).alias("n_results"))
    parts = [base, more, by_class, failures]
    if identifiable:
        n = F.count(F.lit(1))
        parts.append(hits.agg(share(F.col("over_claim"), included & F.col("type").isin(*FAMILIES)).alias("over_claim_rate"), F.count_if(~included).alias("ambiguous_cross_family_excluded"), F.try_divide(F.count_if("subtype_retained").cast("double"), n).alias("subtype_coverage"), F.count_if("subtype_retained").alias("subtype_gt_count"), F.count_if(included).alias("type_metric_n")))
    out = parts[0]
    for part in parts[1:]:  # rows of one: a join without a key of one row each
        out = out.join(F.broadcast(part))
    return out


def per_class(rows: DataFrame, kind: str, hit: Column) -> DataFrame:
    return rows.groupBy(F.col(kind).alias("class")).agg(F.count(F.lit(1)).alias("n"), share(hit).alias("accuracy"))


def macro(rows: DataFrame, kind: str, hit: Column) -> DataFrame:
    """One row: mean accuracy per class, then the unweighted mean of the classes (null for none), and the classes as a map."""
    by = per_class(rows, kind, hit)
    return by.agg(F.avg("accuracy").alias("type_macro_exact_match"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "accuracy")))).alias("type_exact_match_by_class"))


def before_after(before: DataFrame, after: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """Two long tables (metric, value) side by side with the difference; metrics of either stay."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full").withColumn("change", F.col("after") - F.col("before"))


def long(rows: DataFrame) -> DataFrame:
    """The numeric columns of a one-row frame as (metric, value)."""
    numeric = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric))
    return rows.select(F.inline(pairs))
