"""Intermediate tables between programs that would be one plan otherwise."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; only a session on a local master without that setting gets a temporary folder of its own."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="labelframe-"))
    return f"{(named or context.getCheckpointDir()).rstrip('/')}/staged-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in a ``folder`` and read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
