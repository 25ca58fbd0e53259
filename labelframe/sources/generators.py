"""Parametric tables made from a range: no input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Purposes of pages (fixed values).
GLYPHS, EVALUATION, INVENTORY = "字形供給", "評価専用", "定性インベントリ(レンダラ校正)"


def collection_plan(spark: SparkSession, seed: int = 20260804) -> DataFrame:
    """1,350 pages: 900 copies (60 writers, 15 items each, no item twice), 330 for fairness (30 writers by 11 items), 120 solved ones.

    Which item a copy gets, and which problem a solver, follows hashes of (seed, place); items of copies are ranked by their hash, so each comes once.
    """
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ranks = spark.range(1, 901).select(F.concat(F.lit("U"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("content_id"))
    ranks = ranks.select("content_id", F.sha2(F.concat(F.lit(f"{seed}|"), "content_id").cast("binary"), 256).alias("h"))
    listed = F.sort_array(F.collect_list(F.struct("h", "content_id")))  # 900 rows
    ranks = ranks.agg(listed.alias("all")).select(F.posexplode("all").alias("place", "item")).select("place", "item.content_id")
    n = F.col("place")
    w = F.floor(n / 15).cast("int")
    writer = F.when(w < 20, F.concat(F.lit("G"), two(w + 1))).otherwise(F.concat(F.lit("E"), two(w - 19)))
    copies = ranks.select(F.concat(F.lit("COPY-"), writer, F.lit("-"), two(n % 15 + 1)).alias("page_id"), F.lit("書き写し").alias("block"), writer.alias("writer_id"), "content_id", F.lit("copy").alias("condition"), F.when(w < 20, GLYPHS).otherwise(EVALUATION).alias("purpose"))
    people, items = spark.range(1, 31).select(F.concat(F.lit("F"), two(F.col("id"))).alias("writer_id")), spark.range(1, 12).select(F.concat(F.lit("FC"), two(F.col("id"))).alias("content_id"))
    fair = people.crossJoin(items).select(F.concat(F.lit("FAIR-"), "writer_id", F.lit("-"), "content_id").alias("page_id"), F.lit("公平性").alias("block"), "writer_id", "content_id", F.lit("copy").alias("condition"), F.lit(EVALUATION).alias("purpose"))
    k = F.col("id")
    solver = F.when(k < 80, F.concat(F.lit("G"), two(F.floor(k / 4) + 1))).otherwise(F.concat(F.lit("C"), two(F.floor(k / 4) - 19)))
    task = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|solve|"), k.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long"), F.lit(60)) + 1
    solved = spark.range(120).select(F.concat(F.lit("SOLV-"), solver, F.lit("-"), (k % 4 + 1).cast("string")).alias("page_id"), F.lit("自力解答").alias("block"), solver.alias("writer_id"), F.concat(F.lit("S"), F.lpad(task.cast("string"), 3, "0")).alias("content_id"), F.when(k % 4 < 2, "timed_solve").otherwise("corrected_solve").alias("condition"), F.lit(INVENTORY).alias("purpose"))
    return copies.unionByName(fair).unionByName(solved)
