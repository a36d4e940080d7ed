"""op3: encoding and decoding of every document; op5: token counts of every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, token_counts


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False).drop("exact")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_byte_bpe": op3_byte_bpe, "op5_token_counts": op5_token_counts}
ORACLE: dict[str, str] = {}
