"""The programs end to end: generation, dataset build, evaluation, audit. Each is one plan; rejects are outputs of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.operators import audit, dataset, layout, metrics, programs, relabel, splits, verbalise
from labelframe.sources import fixed, sinks


def generation(spark: SparkSession, n: int, seed: int, path: str, control_share: float = 0.3, verbaliser: verbalise.Verbaliser | None = None, settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept records with geometry, rejected ones with their reasons).

    Generated records are written to ``path`` (Parquet) before geometry is worked out, as the two programs do: a resumed run
    starts from there, and the optimiser need not carry step programs through geometry.
    """
    if not sinks.is_complete(path, spark):
        programs.generate(spark, n, seed, control_share).write.mode("overwrite").parquet(path)
    made = spark.read.parquet(path)
    fine = (F.size("g1_reasons") == 0) & (F.size("g2_reasons") == 0)
    kept = made.where(fine).drop("g1_reasons", "g2_reasons")
    if verbaliser is not None:
        kept = verbalise.verbalised(kept, verbaliser)
    rejected = made.where(~fine).select("sample_id", "pair_id", F.concat("g1_reasons", "g2_reasons").alias("reasons"))
    return layout.laid_out(kept, settings), rejected


@dataclass(frozen=True)
class Build:
    """What a dataset build gives."""

    rows: DataFrame
    stats: DataFrame
    rejected: DataFrame


def dataset_build(records: DataFrame, labels: DataFrame | None = None, val_share: float = 0.05, seed: int = 0, test_seed: int | None = None, test_n: int = 0) -> Build:
    """Tuning rows with their split, whole pairs apart from each other; pairs of the selected test records go to test."""
    if labels is not None:
        given = relabel.attach(records, labels.select("sample_id", F.col("type_identifiable").alias("_kind")), mandatory=F.size("injected_errors") > 0)
        records = given.withColumn("injected_errors", F.transform("injected_errors", lambda e: e.withField("type", F.coalesce(F.col("_kind"), e["type"])))).drop("_kind")
    checked = dataset.validated(records)
    good = checked.where(F.size("reject_reasons") == 0).drop("reject_reasons")
    test = splits.sample(good.select("sample_id", "pair_id"), "sample_id", test_n, test_seed) if test_seed is not None else None
    placed = splits.split_groups(good, "pair_id", val_share, seed, test)
    rows = dataset.tuning_rows(placed).join(placed.select(F.col("sample_id").alias("id"), "split"), "id")
    return Build(rows, dataset.split_stats(placed, "split", "pair_id", dataset.error_free()), checked.where(F.size("reject_reasons") > 0).select("sample_id", "reject_reasons"))


@dataclass(frozen=True)
class Options:
    """Independent switches of an evaluation."""

    relative: bool = False
    identifiable: bool = False
    coarsen: bool = False
    mock: bool = False


def evaluation(records: DataFrame, predictions: DataFrame | None, options: Options = Options(), labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row of metrics per record, one row of their summary); mock predictions are the truth."""
    if options.identifiable and labels is None:
        raise ValueError("an identifiable evaluation needs the relabel map")
    said = metrics.mock_predictions(records, options.relative) if options.mock else predictions
    if said is None:
        raise ValueError("predictions are missing")
    truths = metrics.truth(records, options.relative)
    if options.identifiable:
        truths = relabel.attach(truths, labels.select("sample_id", *metrics.LABELS), mandatory=F.size("_types") > 0)
    results = metrics.rated(truths, said, options.identifiable, options.coarsen)
    return results, metrics.summary(results, options.identifiable)


def family_audit(spark: SparkSession, paths: list[str], family: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decoded records, one row of coverage, undecodable classes) of a family's files."""
    rows = fixed.with_char(fixed.decode(fixed.scan(spark, paths, family, images=False), family), family).where("skipped is null")
    rows = fixed.writer_runs(rows) if family == "9G" else rows.withColumn("writer", F.col("sheet_number").cast("string"))
    order = F.struct("path", "record_index")
    return rows, audit.coverage_summary(rows, "writer", "class_code", fixed.EXPECTED_CLASSES[family], F.col("sheet_number") > 0), audit.undecodable(rows, "class_code", "char", order, "reading", "path", "record_index")
