"""Helpers that several corpus operators share: shared folders, block counts and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the corpus contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes that one vectorised pass handles; bounds a task's memory whatever a batch holds.
SLICE_BYTES = 1 << 20
#: Rows of a batch that a map works on at once.
ROWS = 1000


_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where none is configured and all runs in one process."""
    jsc = spark.sparkContext._jsc.sc()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if root is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="tidemark-shared-"))
    return root or jsc.getCheckpointDir().get()


def materialise(df: DataFrame, label: str = "t", options: dict | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int, until: int) -> None:
    """Deletes what materialise has written, from its since-th table to that before the until-th."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _MADE[since:until]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _MADE.remove(path)


def made() -> int:
    """How many tables materialise holds in the shared folder."""
    return len(_MADE)


def row_key() -> Column:
    """Names a row by its id and its text, for joins that copies and repeated ids don't confuse."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, or one made longer, that is none of the table's columns (in any case of letters)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def n_blocks(df: DataFrame, column: str, block_bytes: int) -> int:
    """How many blocks of about block_bytes of text the whole table makes (one small aggregate)."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return int(total // block_bytes) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, large-string array) pieces of about limit bytes, whole texts only; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ROWS, which bounds what a task makes of them at once."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def word_hashes(texts: pa.Array, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words (runs of bytes that aren't breaks) of a large-string array, and the words' count in each text."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    offsets = offsets - first
    word = ~breaks[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[inner] = word[inner]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    edges = np.append(starts, len(raw))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(edges))
    power = np.multiply.accumulate(np.full(int(place.max()) + 1, _STEP, np.uint64))
    part = _BYTE[LOWER[raw[starts[0] :]]] * power[place]
    part[~word[starts[0] :]] = 0
    return mix(np.add.reduceat(part, starts - starts[0])), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of width words; a text of fewer words gives its whole sequence once, none gives nothing."""
    k = np.maximum(counts - width + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts, k)
    begin = first + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    size = np.repeat(np.minimum(counts, width), k)
    out = mix(size.astype(np.uint64) + _STEP)
    for j in range(width):
        at = np.minimum(begin + j, max(0, len(words) - 1))
        out = np.where(j < size, mix(out * np.uint64(3) + words[at]) if len(words) else out, out)
    return out, k
