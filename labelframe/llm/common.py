"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, set as the context's checkpoint folder.

    Only a session on a local master without that setting and without a checkpoint folder (a test) gets a temporary one of its own; on a cluster that is an error.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="labelframe-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def reserved(df: DataFrame) -> None:
    """Refuse columns that could be taken for the operators' own."""
    if found := [c for c in df.columns if c.lower().startswith("_lf_")]:
        raise ValueError(f"column names that begin with _lf_ are reserved: {found}")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows up to which ``small`` broadcasts a side; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` of a few fixed-width columns, best a materialised one, with a broadcast hint if it is counted (by partial sums) at ``most`` rows or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the cluster's checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/labelframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` has made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
