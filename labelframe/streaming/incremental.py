"""Incremental runs: new chunk files are processed once, finished work is kept.

The batch programs resume by skipping finished chunks; here a file stream with ``availableNow`` and a checkpoint does that: files that
a committed batch has read are not read again, and a batch that failed is repeated whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 100) -> int:
    """Apply ``work`` to the rows of files that have come since the last call, append its rows to ``target`` (Parquet, one folder a batch), and return the batches run.

    Each batch overwrites its own folder, so a repeated batch leaves its rows once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    n = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal n
        n += 1
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return n
