"""op2: fingerprints of every document, of its edited text, and how alike they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fp.edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fp.text_form(F.col("sketch")).alias("fingerprint"), fp.text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        fp.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), fp.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), fp.distinct_shingles(F.col("sketch")).alias("n_distinct"),
    )


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLE: dict[str, str] = {}
