"""Sinks: committed writes, markers, split outputs, reports, exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.functions.numbers import bind


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines by Spark's commit protocol: a reader sees all of the output, marked by _SUCCESS, or none."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_with_stats(df: DataFrame, stats: DataFrame, path: str, stats_path: str) -> None:
    """Statistics first, data last: the data's marker tells that both are complete."""
    write_jsonl(stats.coalesce(1), stats_path)
    write_jsonl(df, path)


def is_complete(df_path: str, spark) -> bool:
    """Whether a write to the folder has been committed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(df_path + "/_SUCCESS")
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_copy(df: DataFrame, source: str, target: str) -> None:
    """An annotated copy, which must not go where it comes from."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the annotated copy must go to another folder than its source")
    write_jsonl(df, target)


def write_rejects(df: DataFrame, path: str, key: str = "sample_id") -> None:
    """Rejected rows with their reasons in order of the key."""
    write_jsonl(df.orderBy(key), path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark before it (for spreadsheets); one file, for tables of bounded size."""
    names = df.columns
    mark = [F.col(c).alias(("﻿" if k == 0 else "") + c) for k, c in enumerate(names)]
    df.coalesce(1).select(*mark).write.mode("overwrite").option("header", True).csv(path)


#: Bytes of a part file of fixed-length records.
PART = 16 << 20


def write_fixed(keys: DataFrame, raw: Column, key: str, length: int, path: str) -> None:
    """Records of ``length`` bytes, made from rows by ``raw`` after these are in order of ``key`` (null first), as part files of some 16 MB that follow each other in order of their numbers.

    Spark's text sink writes a string's bytes as they are and a separator after each, so a record must end in a zero byte (a filler), which is that separator.
    """
    bad = F.raise_error(F.lit(f"a record is not {length} bytes with a zero byte at its end")).cast("string")
    whole = lambda r: (F.octet_length(r) == length) & (F.substring(r, length, 1) == F.unhex(F.lit("00")))
    value = bind(raw, lambda r: F.when(whole(r), F.substring(r, 1, length - 1).cast("string")).otherwise(bad))
    parts = max(1, -(-keys.count() * length // PART))
    rows = keys.repartitionByRange(parts, key).sortWithinPartitions(key)
    rows.select(value.alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


def summary(df: DataFrame, title: str, labels: dict[str, str] | None = None) -> tuple[str, str]:
    """(pretty JSON, Markdown table) of a one-row aggregate; missing values are N/A, doubles have six places."""
    row = df.first().asDict(recursive=True)
    shown = lambda v: "N/A" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    body = "".join(f"| {(labels or {}).get(k, k)} | {shown(v)} |\n" for k, v in row.items())
    return json.dumps(row, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n", f"# {title}\n\n| metric | value |\n|---|---|\n{body}"
