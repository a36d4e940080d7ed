"""Token counts through a digest cache.

Each text is known by a digest of its normal form and the tokenizer file by a digest of its bytes. Counts are looked up
in a stored table by both digests; only digests that it lacks are encoded, one text for each, and appended to it. The
table lies in the shared folder under the tokenizer's digest and is kept, so a later run encodes only what is new.

The normal form has no white space at its ends and one space for each run of white space inside (ASCII white space: the
tokenizer drops it and treats what lies between as it would alone), and A-Z in lower case where the whole text is ASCII
(elsewhere a letter's case can decide whether a mark after it is composed with it). So texts of one normal form have one
count. For the same reason a task counts a text by its words and keeps counts of words it has met; the memo is bounded
and changes no count.

Copies are pre-aggregated to one row before any join. The table of counts has one row a digest and is written before the
documents are joined with it, so adaptive execution splits the partition of a text that many documents share.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each get their row; rows of null doc_id
keep it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import materialise, shared_dir

LIMIT = 2048
#: Words whose counts one task remembers at most.
MEMO = 800_000
CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(2)
def _counter(path: str):
    library = Tokenizer.from_file(path)
    memo: dict[bytes, int] = {}

    def count(text: str) -> int:
        total = 0
        for word in text.encode().split():  # bytes split at ASCII white space only
            n = memo.get(word)
            if n is None:
                n = len(library.encode(word.decode(), add_special_tokens=False))
                if len(word) < 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = n
            total += n
        return total

    return count


def _encode(texts: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"content": batch.column("content"), "n_tokens": pa.array([count(v.as_py()) for v in batch.column("text")], pa.int64())})

    return texts.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def normal_form(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(F.octet_length(text) == F.length(text), F.lower(spaced)).otherwise(spaced)


def cache_folder(spark: SparkSession, path: str) -> str:
    """Where the counts of a tokenizer file are kept."""
    return f"{shared_dir(spark)}/tidemark/token-cache/{tokenizer_version(path)[:24]}"


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. cache: a Parquet folder of counts, read if it's there and appended to."""
    spark = docs.sparkSession
    version = tokenizer_version(path)
    cache = cache or cache_folder(spark, path)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # quick tells the texts of one id apart when a text is looked up again.
    quick = F.xxhash64("text")
    keyed = materialise(base.select("doc_id", quick.alias("quick"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(normal_form(F.col("text")).cast("binary"), 256).alias("content")), "digests")
    stored = _stored(spark, cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    wanted = keyed.groupBy("content").agg(F.min(F.struct("doc_id", "quick")).alias("at"))
    wanted = materialise(wanted.join(stored, "content", "left").select("content", "at.doc_id", "at.quick", "n_tokens"), "wanted")
    misses, counts = wanted.filter("n_tokens IS NULL").drop("n_tokens"), wanted.select("content", "n_tokens")
    if not misses.isEmpty():
        m = misses.select("content", F.col("doc_id").alias("of"), F.col("quick").alias("by"))
        asked = base.join(m, F.col("doc_id").eqNullSafe(F.col("of")) & (quick == F.col("by"))).select("content", "text")
        fresh = materialise(_encode(asked, path).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
        fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
        counts = materialise(counts.filter("n_tokens IS NOT NULL").unionByName(fresh), "counts")
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark: SparkSession, cache: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(cache)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return spark.createDataFrame([], CACHE_SCHEMA)
