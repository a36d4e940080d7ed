"""op6: personal data, op8: secrets, in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pii, secret_scan
from tidemark.llm.spans import count_of, joined


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), pii.KINDS).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), pii.KINDS).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = ("assign", "access", "hex", "random")
    counts = [count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(kinds[:3])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), kinds).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), kinds).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op6_pii": op6_pii, "op8_secret_scan": op8_secret_scan}
ORACLE: dict[str, str] = {}
