"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelframe.llm import chat, decontamination, lines, packing, quality, secrets, simhash, tokens, urls, vectors


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the pipeline at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_chat_format": chat.op2_chat_format,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_url_filter": urls.op8_url_filter,
    "op9_embedding_dedup": vectors.op9_embedding_dedup,
    "op10_line_dedup": lines.op10_line_dedup,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": chat.OP2_SQL,
    "op5_decontamination": decontamination.OP5_SQL,
    "op8_url_filter": urls.op8_sql(),
    "op9_embedding_dedup": vectors.OP9_SQL,
    "op10_line_dedup": lines.OP10_SQL,
}
