"""op13: near duplicates by circulant MinHash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import minhash


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_minhash_dedup": op13_minhash_dedup}
ORACLE: dict[str, str] = {}
