"""The composite reward of an answer sheet's reading, and its adversarial test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelframe.functions import geometry as G
from labelframe.functions import text as T
from labelframe.functions.numbers import bind
from labelframe.operators.metrics import error_boxes
from labelframe.operators.programs import choose, step_text
from labelframe.operators.relabel import family_of
from labelframe.schema import FAMILIES, FAMILY

#: Weights of the components (fixed values).
WEIGHTS = {"transcript": 0.25, "detection": 0.15, "location": 0.15, "type": 0.10, "score": 0.20, "comment": 0.05, "format": 0.10}
#: Types that an answer that lists everything names (fixed values).
ALL_TYPES = ("計算/加減", "計算/加減乗除", "計算/符号", "計算/除算", "記法/移項符号", "概念/演算順序", "表記/符号落とし")


def type_reward(gt: Column, kinds: Column, identifiable: bool | None = None) -> tuple[Column, Column]:
    """(reward, whether it is excluded) of predicted types.

    Legacy: 1 for the type, 0.5 for one with the same first part. Identifiable (null mode: where the record carries such a label): excluded if
    ambiguous; a family must be named itself and a subtype of it loses all; a subtype earns half by its family. Records without the label are legacy in any mode.
    """
    head = lambda k: F.split_part(k, F.lit("/"), F.lit(1))
    legacy = F.when(F.array_contains(kinds, gt["type"]), 1.0).when(F.exists(kinds, lambda k: (k != "") & (head(k) == head(gt["type"]))), 0.5).otherwise(0.0)
    label = gt["type_identifiable"]
    ambiguous = F.coalesce(gt["ambiguous_cross_family"], F.lit(False))
    over = F.exists(kinds, lambda k: k.isin(*FAMILY) & (family_of(k) == label))
    named = F.array_contains(kinds, label)
    as_family = F.when(over, 0.0).when(named, 1.0).otherwise(0.0)
    as_subtype = F.when(named, 1.0).when(label.isin(*FAMILY) & F.array_contains(kinds, family_of(label)), 0.5).otherwise(0.0)
    fine = F.when(ambiguous, 0.0).when(label.isin(*FAMILIES), as_family).otherwise(as_subtype)
    if identifiable is False:
        return legacy, F.lit(False)
    return F.when(label.isNull(), legacy).otherwise(fine), label.isNotNull() & ambiguous


def rewarded(rows: DataFrame, identifiable: bool | None = None) -> DataFrame:
    """``rows`` (a record's columns, and ``out``: struct of transcript, errors, score, comment_refs, or null) with ``reward``: components and total."""
    out, ok = F.col("out"), F.col("out").isNotNull() & F.col("out.transcript").isNotNull() & F.col("out.errors").isNotNull()
    site = F.get("injected_errors", 0)["mutation_site"]
    rows = rows.withColumns({
        "_ref": T.normalize_text(F.col("transcript_gt.text")), "_hyp": T.normalize_text(out["transcript"]), "_lines": T.normalize_all(T.lines(out["transcript"])),
        "_gold": T.normalize_text(step_text(F.col("gold_solution"), site)), "_mutant": T.normalize_text(step_text(F.col("mutant_solution"), site)), "_boxes": error_boxes(),
    })
    has_error, preds = ~F.col("control_flag.error_free"), out["errors"]
    zero = lambda c: F.greatest(F.lit(0.0), c)
    faithful = zero(1.0 - T.cer(F.col("_ref"), F.col("_hyp")))
    transcript = F.when(has_error & T.over_corrected(F.col("_lines"), F.col("_gold"), F.col("_mutant")), zero(faithful - 0.8)).otherwise(faithful)
    n_preds = F.size(preds)
    surplus = F.greatest(F.lit(0), n_preds - F.size("injected_errors"))
    detection = F.when(has_error, zero(F.when(n_preds > 0, 1.0).otherwise(0.0) - 0.25 * surplus)).otherwise(F.when(n_preds == 0, 1.0).otherwise(0.0))
    gt = F.get("injected_errors", 0)
    best = G.best_iou(F.transform(preds, lambda p: p["bbox"]), F.array(F.get("_boxes", 0)))
    near = 0.5 * F.when(best >= 0.5, 1.0).otherwise(best) + 0.5 * F.when(F.exists(preds, lambda p: p["step_id"].eqNullSafe(gt["mutation_site"])), 1.0).otherwise(0.0)
    kinds = F.transform(preds, lambda p: F.coalesce(p["type"], F.lit("")))
    kind, excluded = type_reward(gt, kinds, identifiable)
    quiet = F.when(n_preds == 0, 1.0).otherwise(0.0)
    location = F.when(~has_error, quiet).when(n_preds == 0, 0.0).otherwise(near)
    typed = F.when(~has_error, quiet).when(n_preds == 0, 0.0).otherwise(kind)
    left_out = F.coalesce(has_error & excluded, F.lit(False))
    truth, told = F.col("score_gt.awarded").cast("long"), out["score"]
    score = F.when(told == truth, 1.0).when(F.abs(told - truth) <= 1, 0.5).otherwise(0.0)
    refs = F.array_distinct(F.transform("injected_errors", lambda e: e["type"]))
    said = F.array_distinct(F.coalesce(out["comment_refs"], F.array().cast("array<string>")))
    hits = F.size(F.array_intersect(refs, said)).cast("double")
    precision, recall = F.try_divide(hits, F.size(said)), F.try_divide(hits, F.size(refs))
    f_half = F.coalesce(F.try_divide(1.25 * precision * recall, 0.25 * precision + recall), F.lit(0.0))
    stuffed = F.when(F.size(said) > 2 * F.greatest(F.lit(1), F.size(refs)), 0.2).otherwise(1.0)
    comment = F.when((F.size(refs) == 0) & (F.size(said) == 0), 1.0).when((F.size(refs) > 0) & (F.size(said) > 0), f_half * stuffed).otherwise(0.0)
    parts = {"transcript": transcript, "detection": detection, "location": location, "type": typed, "score": score, "comment": comment, "format": F.lit(1.0)}
    parts = {k: F.when(ok, v).otherwise(0.0) for k, v in parts.items()}
    whole = sum(w * parts[k] for k, w in WEIGHTS.items())
    without = sum(w * parts[k] for k, w in WEIGHTS.items() if k != "type") / (1.0 - WEIGHTS["type"])
    total = F.when(ok & left_out, without).when(ok, whole).otherwise(0.0)
    return rows.withColumn("reward", F.struct(*(v.alias(k) for k, v in parts.items()), total.alias("total"))).drop("_ref", "_hyp", "_lines", "_gold", "_mutant", "_boxes")


OUT = "struct<transcript:string,errors:array<struct<step_id:string,bbox:array<double>,type:string>>,score:bigint,comment_refs:array<string>>"


def perfect_output(seed: int = 0) -> Column:
    """The truth as an answer, boxes off by up to three pixels."""
    off = lambda i: (choose(seed, F.col("sample_id"), f"box{i}", 7) - 3).cast("double")
    shaky = bind(F.get("_boxes", 0), lambda box: F.when(box.isNotNull(), F.array(*(box[i] + off(i) for i in range(4)))))
    errors = F.transform("injected_errors", lambda e: F.struct(e["mutation_site"].alias("step_id"), shaky.alias("bbox"), e["type"].alias("type")))
    return F.struct(F.col("transcript_gt.text").alias("transcript"), errors.alias("errors"), F.col("score_gt.awarded").cast("long").alias("score"), F.transform("injected_errors", lambda e: e["type"]).alias("comment_refs")).cast(OUT)


def adversarial(records: DataFrame, seed: int = 0) -> DataFrame:
    """Each record with its perfect answer (family ``perfect``) and with answers that try to earn without reading: eight for errors, one for controls."""
    rows = records.withColumn("_boxes", error_boxes())
    # bound: the cases use the perfect answer in many places, and Catalyst would put all of it into each
    return rows.select(*records.columns, F.inline(bind(perfect_output(seed), lambda base: _cases(base, seed))))


def _cases(base: Column, seed: int) -> Column:
    made = lambda **new: F.struct(*((new[f] if f in new else base[f]).alias(f) for f in ("transcript", "errors", "score", "comment_refs"))).cast(OUT)
    pick = lambda what, n: choose(seed, F.col("sample_id"), what, n)
    one_type = lambda what: F.get(F.array(*map(F.lit, ALL_TYPES)), pick(what, len(ALL_TYPES)))
    fake = lambda i: F.struct(F.concat(F.lit("s"), (pick(f"step{i}", 4) + 1).cast("string")).alias("step_id"), F.array(*(v.cast("double") for v in (pick(f"x0{i}", 601), pick(f"y0{i}", 801), 700 + pick(f"x1{i}", 501), 900 + pick(f"y1{i}", 801)))).alias("bbox"), one_type(f"type{i}").alias("type"))
    first = F.get(base["errors"], 0)
    page = F.array(F.lit(0.0), F.lit(0.0), F.col("render.page.w").cast("double"), F.col("render.page.h").cast("double"))
    no_errors, no_refs = F.slice(base["errors"], 1, 0), F.array().cast("array<string>")
    gold = F.concat(F.col("problem.text_ja"), F.lit("\n"), F.array_join(F.transform("gold_solution", lambda s: s["text"]), "\n"))
    invented = F.struct(F.lit("s3").alias("step_id"), F.array(*map(F.lit, (200.0, 400.0, 900.0, 500.0))).alias("bbox"), one_type("invented").alias("type"))
    bad = {
        "empty_transcript": made(transcript=F.lit("")), "error_spam": made(errors=F.concat(base["errors"], F.array(*(fake(i) for i in range(4))))),
        "giant_bbox": made(errors=F.array(F.struct(first["step_id"].alias("step_id"), page.alias("bbox"), first["type"].alias("type")))),
        "duplicate_refs": made(errors=F.array_repeat(first, 4), comment_refs=F.flatten(F.array_repeat(base["comment_refs"], 4))),
        "over_correct": made(transcript=gold), "miss_and_full_score": made(errors=no_errors, score=F.col("score_gt.full").cast("long"), comment_refs=no_refs),
        "comment_stuffing": made(comment_refs=F.array(*map(F.lit, ALL_TYPES))), "empty_but_valid_json": made(transcript=F.lit(""), errors=no_errors, score=F.lit(0).cast("long"), comment_refs=no_refs),
    }
    lie = made(errors=F.array(invented), score=F.greatest(F.lit(0), F.col("score_gt.awarded") - 2).cast("long"), comment_refs=F.array(invented["type"]))
    case = lambda name, o: F.struct(F.lit(name).alias("family"), o.alias("out"))
    wrong = F.array(case("perfect", base), *(case(k, v) for k, v in bad.items()))
    return F.when(F.col("control_flag.error_free"), F.array(case("perfect", base), case("hallucinate_on_control", lie))).otherwise(wrong)


def inversions(records: DataFrame, seed: int = 0, identifiable: bool | None = None) -> DataFrame:
    """Per family (and in all, family null): trials, answers that earn more than the perfect one, the largest gap, the rate."""
    scored = rewarded(adversarial(records, seed), identifiable).select("sample_id", "family", F.col("reward.total").alias("total")).where("sample_id is not null")
    # a window over a record's few answers: a join of the scored rows with themselves would make and score all of them twice
    right = F.max(F.when(F.col("family") == "perfect", F.col("total"))).over(Window.partitionBy("sample_id"))
    gap = F.col("total") - F.col("valid")
    rows = scored.withColumn("valid", right).where("family <> 'perfect'")
    return rows.groupingSets([[F.col("family")], []], "family").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap > 0).alias("n_inversions"), F.max(gap).alias("max_gap")).withColumn("inversion_rate", F.col("n_inversions") / F.col("n"))
