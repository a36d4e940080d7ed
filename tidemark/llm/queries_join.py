"""op4: components of documents that share nine tenths of their shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ngram_join


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_ngram_join": op4_ngram_join}
ORACLE: dict[str, str] = {}
