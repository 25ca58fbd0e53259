"""Selections and group-isolated splits. ``native`` order is by hash and stays distributed; ``compat`` repeats a shuffle of Python's generator on the driver."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that a compat shuffle collects at most.
COMPAT_KEYS = 2_000_000


def hash_order(key: Column, seed: int) -> Column:
    """SHA-256 of seed and key: the order of native selections (the same in any engine)."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"), 256)


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows with the first hashes of their key (a distributed top n)."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def compat_shuffle(keys: list, seed: int) -> list:
    out = list(keys)
    random.Random(seed).shuffle(out)
    return out


def compat_sample(rows: DataFrame, key: str, order: str, n: int, seed: int) -> DataFrame:
    """The rows that shuffling all keys in reading order with Python's generator puts first. Keys only go to the driver, ``COMPAT_KEYS`` at most."""
    keys = [r[0] for r in rows.select(key, order).orderBy(order).limit(COMPAT_KEYS + 1).collect()]
    if len(keys) > COMPAT_KEYS:
        raise ValueError("too many keys for a driver-side shuffle; use the native order")
    spark = rows.sparkSession
    first = spark.createDataFrame([(k,) for k in compat_shuffle(keys, seed)[:n]], f"`{key}` {rows.schema[key].dataType.simpleString()}")
    return rows.join(F.broadcast(first), key, "left_semi")


def split_groups(rows: DataFrame, group: str, val_share: float, seed: int, test: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``split``: whole groups go to test (those of the selected rows ``test``), val or train.

    Of the other groups exactly round(n val_share) (half to even) go to val, by the order of their hashes. Rows keep their partitions: only
    distinct groups are ranked.
    """
    groups = rows.select(group).distinct()
    touched = test.select(group).distinct() if test is not None else groups.limit(0)
    rest = groups.join(touched, group, "left_anti")
    n_val = int(round(rest.count() * val_share))
    val = rest.orderBy(hash_order(F.col(group), seed), group).limit(n_val)
    marked = touched.withColumn("split", F.lit("test")).unionByName(val.withColumn("split", F.lit("val")))
    return rows.join(marked, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def shared_keys(rows: DataFrame, key: str, across: str) -> DataFrame:
    """Keys that occur under more than one value of ``across``: empty when the parts are disjoint."""
    return rows.groupBy(key).agg(F.count_distinct(across).alias("n_parts")).where("n_parts > 1")


def assert_disjoint(rows: DataFrame, key: str, across: str) -> DataFrame:
    if bad := shared_keys(rows, key, across).limit(5).collect():
        raise ValueError(f"{across}: shared {key}: {[r[0] for r in bad]}")
    return rows


def keep_first(rows: DataFrame, key: str, priority: list[Column], n: int | None = None) -> DataFrame:
    """One row per key, the first by ``priority``; then the first ``n`` rows of all.

    Spark limits each key to its first row within a partition before the shuffle (WindowGroupLimit), so of a key with very many rows one a partition travels. Long keys are
    best given as hashes.
    """
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*priority))).where("_rank = 1").drop("_rank")
    return first if n is None else first.orderBy(*priority).limit(n)


def every_nth(rows: DataFrame, ordinal: str, n: int) -> DataFrame:
    """Rows whose global ordinal is a multiple of ``n``."""
    return rows.where(F.pmod(F.col(ordinal), F.lit(n)) == 0)


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an explicit order (a distributed top n: no shuffle of the rest)."""
    return rows.orderBy(*order).limit(n)


def first_ordinals(rows: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """A limit over all chunks: rows whose global ordinal is below ``n``."""
    return rows.where(F.col(ordinal) < n)
