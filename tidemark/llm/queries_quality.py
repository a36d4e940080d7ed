"""op9: a quality score for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import quality


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.score_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op9_quality": op9_quality}
ORACLE: dict[str, str] = {}
