"""Driver queries over generated records: as many as there are customers, made from nothing but their number, so that SQL can make the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.functions import seeds
from labelframe.functions import text as T
from labelframe.operators import layout, probe, programs, relabel, rewards, splits, verbalise
from labelframe.plans import expected as E
from labelframe.plans import pipelines
from labelframe.plans.registry import query, r6, table
from labelframe.sources import staging


def _made(spark: SparkSession, sf_dir: str, proposals: bool = False) -> DataFrame:
    n = table(spark, sf_dir, E.TABLE).count()
    return staging.staged(programs.generate(spark, n, E.SEED, proposer=E.proposal if proposals else None))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).drop("g1_reasons", "g2_reasons")


def _flat(rows: DataFrame) -> DataFrame:
    texts = lambda steps: F.array_join(F.transform(steps, lambda s: s["text"]), " | ")
    e = F.get("injected_errors", 0)
    return rows.select(
        "sample_id", "pair_id", F.col("problem.text_ja").alias("problem"), F.col("answer_key.final").alias("answer_key"), texts("gold_solution").alias("gold"), texts("mutant_solution").alias("mutant"), e["operator"].alias("operator"), e["type"].alias("type"), e["severity"].alias("severity"),
        e["mutation_site"].alias("site"), F.array_join(e["causally_affected_nodes"], ",").alias("affected"), F.col("score_gt.awarded").alias("awarded"), F.col("rubric.fn_id").alias("rubric"), F.col("transcript_gt.text").alias("transcript"),
    )


@query("generated_records", E.RECORDS)
def generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_made(spark, sf_dir))


@query("proposed_records", E.PROPOSED)
def proposed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations by an injected proposer where the rules take its proposals."""
    return _flat(_made(spark, sf_dir, True))


@query("generation_stats", E.STATS)
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.batch_stats(_made(spark, sf_dir)).withColumn("control_ratio", r6("control_ratio"))


@query("generated_operators", E.OPERATORS)
def generated_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.per_operator(_made(spark, sf_dir))


@query("relabel_map", E.LABELS)
def relabel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel.relabel_map(_made(spark, sf_dir, True)).select("sample_id", "type_identifiable", "subtype_retained", "ambiguous_cross_family", "type_legacy", "operator", "bucket", "unidentifiable")


@query("generated_relabels", E.LABEL_STATS)
def generated_relabels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel.relabel_stats(relabel.relabel_map(_made(spark, sf_dir, True))).withColumn("subtype_coverage", r6("subtype_coverage"))


# Evaluation and rewards of a mediocre reader's answers


def _k() -> Column:
    """The index in a record's id, which has six digits or, from a million on, more."""
    return F.regexp_extract("sample_id", "-([0-9]{6,})-", 1).cast("int")


def _boxed(rows: DataFrame) -> DataFrame:
    """Records with a page and the box of their error: two halves of 60 by 44 pixels, at a place that goes by the index."""
    d = lambda c: c.cast("double")
    x, y = 100 + _k() % 300, 200 + _k() % 200
    half = lambda a: F.array(d(x + a), d(y), d(x + a + 60), d(y + 44))
    span = F.struct(F.when(_k() % 2 == 0, 0).alias("error_ref"), F.array(half(0), half(60)).alias("boxes"))
    spans = F.when(F.size("injected_errors") > 0, F.array(span)).otherwise(F.array().cast("array<struct<error_ref:int,boxes:array<array<double>>>>"))
    return rows.withColumn("render", F.struct(F.struct(F.lit(1240).alias("w"), F.lit(1754).alias("h")).alias("page"), spans.alias("error_span_boxes_px")))


def _answered(rows: DataFrame) -> DataFrame:
    """``rows`` with the answer ``out`` (transcript, errors, score, comment_refs) and ``failed``."""
    k, control, truth = _k(), F.col("control_flag.error_free"), F.coalesce(F.get("injected_errors", 0)["type"], F.lit(""))
    kinds = F.array(*map(F.lit, E._KINDS))
    all_types = F.array(*map(F.lit, rewards.ALL_TYPES))
    step = F.when(k % 4 == 0, "s1").when(control, "s3").otherwise(F.get("injected_errors", 0)["mutation_site"])
    kind = F.when((k % 2 == 1) | control, F.get(kinds, k % len(E._KINDS))).otherwise(truth)
    x, y = (100 + k % 300 + k % 7 * 10).cast("double"), (200 + k % 200).cast("double")
    one = F.struct(step.alias("step_id"), F.array(x, y, x + 120, y + 44).alias("bbox"), kind.alias("type"))
    two = F.struct(F.lit("s4").alias("step_id"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("string").alias("type"))
    none = F.slice(F.array(one), 1, 0)
    errors = F.when(control & (k % 3 != 0), none).when(k % 5 == 1, none).when(k % 5 == 2, F.array(one, two)).otherwise(F.array(one))
    text = F.col("transcript_gt.text")
    gold = F.concat(F.col("problem.text_ja"), F.lit("\n"), F.array_join(F.transform("gold_solution", lambda s: s["text"]), "\n"))
    read = F.when(k % 6 == 1, F.substring(text, F.lit(1), F.length(text) - 3)).when(k % 6 == 2, F.concat(text, F.lit("zz"))).when(k % 6 == 3, gold).when(k % 6 == 4, "").when(k % 6 == 5, F.replace(text, F.lit(" "), F.lit("  "))).otherwise(text)
    score = F.when(k % 9 > 0, F.col("score_gt.awarded") + k % 4 - 1)
    refs = F.when(k % 13 > 0, F.when(k % 3 == 0, F.array(truth)).when(k % 3 == 1, F.array().cast("array<string>")).otherwise(all_types))
    out = F.struct(read.alias("transcript"), errors.alias("errors"), score.cast("long").alias("score"), refs.alias("comment_refs")).cast(rewards.OUT)
    return rows.withColumn("failed", k % 11 == 0).withColumn("out", F.when(~F.col("failed"), out))


def _predictions(rows: DataFrame) -> DataFrame:
    return _answered(rows).select("sample_id", "out.transcript", "out.errors", "out.score", F.when(F.col("failed"), "bad json").alias("failure"))


@query("evaluated_records", E.RESULTS)
def evaluated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxed(_records(spark, sf_dir))
    out = pipelines.evaluation(rows, _predictions(rows))[0]
    hits = F.array_join(F.transform("type_exact_matches", lambda h: F.concat(h["type"], F.lit("="), h["exact_match"].cast("string"))), ",")
    same = ("detected_error", "detection_correct", "over_correction", "bbox_iou_at_0_5", "score_exact_match", "score_within_1")
    return out.select("sample_id", "parse_failure", "has_error", *same, hits.alias("hits"), r6("transcript_cer").alias("transcript_cer"), r6("bbox_iou").alias("bbox_iou"))


@query("evaluation_summary", E.SUMMARY)
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxed(_records(spark, sf_dir))
    out = pipelines.evaluation(rows, _predictions(rows))[1]
    rounded = ("tpr", "tnr", "bacc", "hallucinated_error_rate", "transcript_cer_mean", "transcript_cer_median", "over_correction_rate", "bbox_iou_mean", "iou_at_0_5", "score_exact_match", "score_within_1", "type_macro_exact_match")
    return out.select(*(r6(c).alias(c) for c in rounded), "n_error_records", "n_control_records", "n_location_records", F.size("type_exact_match_by_class").cast("long").alias("n_classes"), "n_parse_failures", "n_results")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _boxed(_made(spark, sf_dir, True).drop("g1_reasons", "g2_reasons"))
    return rows, staging.staged(relabel.relabel_map(rows))


def _identifiable(spark: SparkSession, sf_dir: str, coarsen: bool) -> DataFrame:
    rows, labels = _labelled(spark, sf_dir)
    out = pipelines.evaluation(rows, _predictions(rows), pipelines.Options(identifiable=True, coarsen=coarsen), labels)[1]
    return out.select(*(r6(c).alias(c) for c in ("type_macro_exact_match", "over_claim_rate", "subtype_coverage")), "ambiguous_cross_family_excluded", "subtype_gt_count", "type_metric_n")


@query("evaluation_identifiable", E.identifiable(False))
def evaluation_identifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identifiable(spark, sf_dir, False)


@query("evaluation_coarsened", E.identifiable(True))
def evaluation_coarsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identifiable(spark, sf_dir, True)


def _reward_columns(answered: DataFrame, identifiable: bool | None) -> DataFrame:
    out = rewards.rewarded(answered, identifiable)
    return out.select("sample_id", *(r6(f"reward.{k}").alias(k) for k in (*rewards.WEIGHTS, "total")))


@query("record_rewards", E.REWARDS)
def record_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reward_columns(_answered(_boxed(_records(spark, sf_dir))), False)


@query("record_rewards_identifiable", E.REWARDS_LABELLED)
def record_rewards_identifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of records that carry their relabelled types."""
    rows, labels = _labelled(spark, sf_dir)
    # answered first, then only the steps that rewards look at: the join sorts and sends what is left
    at_site = lambda steps: F.filter(steps, lambda s: s["step_id"] == F.get("injected_errors", 0)["mutation_site"])
    rows = _answered(rows).select("sample_id", "injected_errors", "control_flag", "transcript_gt", "score_gt", "render", "out", at_site("gold_solution").alias("gold_solution"), at_site("mutant_solution").alias("mutant_solution"))
    given = relabel.attach(rows, labels.select("sample_id", F.col("type_identifiable").alias("t"), F.col("ambiguous_cross_family").alias("a")), mandatory=F.size("injected_errors") > 0)
    own = given.withColumn("injected_errors", F.transform("injected_errors", lambda e: e.withField("type_identifiable", F.col("t")).withField("ambiguous_cross_family", F.col("a")))).drop("t", "a")
    return _reward_columns(own, None)


@query("reward_inversions", E.INVERSIONS)
def reward_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewards.inversions(_boxed(_records(spark, sf_dir)), 6)
    return out.withColumns({"max_gap": r6("max_gap"), "inversion_rate": r6("inversion_rate")})


# Dataset build, layout, wording, probe


@query("tuning_rows", E.TUNING)
def tuning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the dataset build with the split of each record."""
    rows = pipelines.dataset_build(_boxed(_records(spark, sf_dir)), None, 0.1, 3, test_seed=4, test_n=5).rows
    said = lambda message, part: F.get(F.get("messages", message)["content"], part)["text"]
    return rows.select("id", "image", said(0, 1).alias("asked"), said(1, 0).alias("answered"), "meta.pair_id", "meta.domain", "meta.operator", "meta.error_free", "split")


@query("tuning_splits", E.SPLITS)
def tuning_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pipelines.dataset_build(_boxed(_records(spark, sf_dir)), None, 0.1, 3, test_seed=4, test_n=5).stats
    return stats.withColumn("error_to_control_ratio", r6("error_to_control_ratio"))


@query("rejected_records", E.REJECTS)
def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the build says of records that are spoilt in ten ways."""
    from labelframe.operators import dataset

    rows = _boxed(_records(spark, sf_dir)).withColumn("k", _k() % 10).withColumn("was", F.col("sample_id"))
    rows = rows.unionByName(rows.where("k = 8"))
    page, spans = F.col("render.page"), F.col("render.error_span_boxes_px")
    spans = F.when(F.col("k") == 3, None).when(F.col("k") == 4, F.transform(spans, lambda s: s.withField("boxes", F.array(F.array(F.lit(1.0)))))).when(F.col("k") == 5, F.slice(spans, 1, 0)).otherwise(spans)
    rows = rows.withColumn("render", F.struct(page.withField("w", F.when(F.col("k") == 2, 0).otherwise(page["w"])).alias("page"), spans.alias("error_span_boxes_px")))
    rows = rows.withColumns({"sample_id": F.when(F.col("k") == 0, "").otherwise(F.col("sample_id")), "pair_id": F.when(F.col("k") != 1, F.col("pair_id"))})
    rows = rows.withColumn("transcript_gt", F.col("transcript_gt").withField("text", F.when(F.col("k") != 6, F.col("transcript_gt.text"))))
    rows = rows.withColumn("control_flag", F.struct((F.col("control_flag.error_free") != (F.col("k") == 7)).alias("error_free")))
    return dataset.validated(rows).select("was", F.array_join("reject_reasons", ",").alias("reasons"))


@query("style_invariance", E.STYLES)
def style_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of pairs, some of whose controls have been given another one."""
    other = F.col("control_flag.error_free") & (_k() % 7 == 0)
    rows = _records(spark, sf_dir).withColumn("render", F.struct(F.when(other, "style-other").otherwise(seeds.style_id(F.col("pair_id"))).alias("style_id")))
    return layout.style_invariance(rows)


@query("box_acceptance", E.ACCEPTANCE)
def box_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of which some lie off the page."""
    rows = _boxed(_records(spark, sf_dir))
    far = F.transform("render.error_span_boxes_px", lambda s: s.withField("boxes", F.transform(s["boxes"], lambda b: F.transform(b, lambda v: v + F.when(_k() % 9 == 0, 2000.0).otherwise(0.0)))))
    return layout.box_acceptance(rows.withColumn("render", F.struct(far.alias("error_span_boxes_px"))))


def _fails_on_threes(problem: str, steps: list[dict]) -> list[str]:
    """A verbaliser that leaves the expression out where the first number is a multiple of three."""
    return ["つまり" if int(s["numbers"][0]) % 3 == 0 else t for s, t in zip(steps, verbalise.prefixed(problem, steps), strict=True)]


@query("verbalised_records", E.VERBALISED)
def verbalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = lambda steps: F.array_join(F.transform(steps, lambda s: s["text"]), " | ")
    out = verbalise.verbalised(_records(spark, sf_dir), _fails_on_threes)
    return out.select("sample_id", texts("gold_solution").alias("gold"), texts("mutant_solution").alias("mutant"), F.col("transcript_gt.text").alias("transcript"), "provenance.verbalizer")


@query("character_boxes", E.CHARACTERS)
def character_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All character boxes of pages; spans are those between the common beginning and end of gold and mutant."""
    rows = _records(spark, sf_dir)
    site = F.get("injected_errors", 0)["mutation_site"]
    rows = rows.withColumns({"_g": programs.step_text(F.col("gold_solution"), site), "_m": programs.step_text(F.col("mutant_solution"), site)})
    n, k = F.length("_g"), F.length("_m")
    alike = lambda most, same: F.array_max(F.filter(F.sequence(F.lit(0), most), same))
    part = lambda c, at, size: F.substring(F.col(c), at, size)
    rows = rows.withColumn("_head", alike(F.least(n, k), lambda q: part("_g", F.lit(1), q) == part("_m", F.lit(1), q)))
    rows = rows.withColumn("_tail", alike(F.least(n, k) - F.col("_head"), lambda q: part("_g", n - q + 1, q) == part("_m", k - q + 1, q)))
    lo = F.least(F.col("_head"), k - 1)
    span = F.array(lo, F.greatest(k - F.col("_tail"), lo + 1))
    rows = staging.staged(rows.withColumn("injected_errors", F.transform("injected_errors", lambda e: e.withField("span", span))).drop("_g", "_m", "_head", "_tail"))
    # outer: for a plain one Catalyst infers a filter that lays each page out once more; pages without characters go by the second one
    boxes = layout.laid_out(rows).select("sample_id", F.explode_outer("render.char_boxes_px").alias("step_id", "chars")).select("sample_id", "step_id", F.explode("chars").alias("c"))
    return boxes.select("sample_id", "step_id", F.col("c.i").alias("i"), F.col("c.row").alias("row_no"), "c.char", *(F.round(F.col("c.bbox")[q], 4).alias(f"b{q}") for q in range(4)))


@query("text_probe", E.PROBE)
def text_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the text alone tells errors from controls: trained on one part of the pairs, rated on the other."""
    rows = _records(spark, sf_dir).select("sample_id", "pair_id", F.when(F.col("control_flag.error_free"), 0).otherwise(1).alias("y"), T.normalize_text(F.col("transcript_gt.text")).alias("t"))
    placed = staging.staged(splits.split_groups(rows, "pair_id", 0.3, 2))
    model = probe.fit_bayes(placed.where("split = 'train'"), F.col("t"), "y")
    held = placed.where("split = 'val'")
    scored = probe.score_bayes(held, F.col("t"), "sample_id", model).withColumn("score", F.round("score", 9)).join(held.select("sample_id", "y"), "sample_id")
    return probe.auc(scored, "score", F.col("y") == 1).withColumn("auc", r6("auc"))


def _n_errors(spark: SparkSession, sf_dir: str) -> int:
    return round(table(spark, sf_dir, E.TABLE).count() * 0.7)


@query("injected_texts", E.TEXTS)
def injected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold texts with and without faults, and the steps that the check of texts flags."""
    rows = staging.staged(programs.problems(spark, _n_errors(spark, sf_dir), E.SEED).withColumn("gold", programs.execute()[0]))
    out = probe.injected(rows, E.SEED)
    failing = F.array_join(programs.check_texts(F.col("gold"), F.col("texts")), ",")
    return out.select("idx", "arm", F.array_join("texts", " | ").alias("texts"), failing.alias("failing"))


@query("gate_efficacy", E.EFFICACY)
def gate_efficacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.gate_efficacy(spark, _n_errors(spark, sf_dir), E.SEED).withColumn("flagged_rate", r6("flagged_rate"))
