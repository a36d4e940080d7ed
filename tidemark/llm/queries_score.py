"""op7: a language-model score for every document, learned from those not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ngram_model


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_model.score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)


QUERIES = {"op7_lm_score": op7_lm_score}
ORACLE: dict[str, str] = {}
