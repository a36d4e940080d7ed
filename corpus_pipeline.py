"""Documents to training tokens: five stages, each a corpus operator over all that the stage before kept.

Every stage but the last returns the columns of documents; its result is written as Parquet to the shared folder and
read again as the next stage's input, so a lost executor costs at most one stage's tasks. What a stage wrote on its way,
and the input it read, is deleted once its result is written.

Defined results of all stages: a null text counts as empty and stays null where the row stays; rows of null doc_id and
rows that share an id are judged one by one, by their own texts; an empty table gives no rows; extra columns are kept by
all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontamination, ngram_join, pii, quality
from tidemark.llm.common import made, materialise, release


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps: all of them where labels are lacking or of one class."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle likeness 0.8 or more, the one of least id (null last); texts
    without words are no copies of each other and stay."""
    return ngram_join.keep_one(docs, percent=80, width=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (an empty text holds none)."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms replaced by the names of their kinds; n_chars is counted anew."""
    return pii.sanitise_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding (an empty or null text has none)."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal", hide_personal),
    ("tokens", to_tokens),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in order."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, name)
            release(spark, before, made() - 1)
    return docs
