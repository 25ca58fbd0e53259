"""A corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelframe.llm.common import discard, table, written
from labelframe.llm.decontamination import drop_contaminated
from labelframe.llm.lines import drop_lines
from labelframe.llm.packing import pack_documents
from labelframe.llm.quality import drop_rejected
from labelframe.llm.simhash import drop_near_copies
from labelframe.llm.tokens import default_engine


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that are more likely bad (of low quality or toxic) than not go."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines of 20 characters or more in three documents or more stay in the one of the largest id; all documents stay."""
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one of the smallest id stays."""
    return drop_near_copies(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of all documents, each with its place in a sequence of 1024 tokens at most."""
    return pack_documents(docs, default_engine())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL can't express the fitted classifier, SimHash groups and tokenization: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``. A stage's table goes when the next one is written."""
    docs, made = table(spark, sf_dir, "documents"), False
    for _, stage in STAGES:
        after = written(stage(spark, docs, sf_dir))
        if made:
            discard(docs)
        docs, made = after, True
    return docs
