"""Near duplicates by circulant MinHash: two permutations give a whole signature; bands propose, full sets decide.

1. Signatures. A permutation of 64-bit words (sigma) scatters a set's shingle hashes, of which the upper half are positions
   on a circle of 2**32. A second permutation (pi) is shifted around the circle by one place for each coordinate, so that
   coordinate k is the least pi((position - k) mod 2**32). No further permutation is drawn, however long the signature.
2. Bands. The signature has two halves; each is cut into bands of `rows` coordinates, and a band's values are hashed to one
   token. A pair is a candidate if it shares a token in each half. `rows` follows from the threshold: the most that leave
   a linked pair without a shared token with probability 1e-7 or less in a half (at 85 per cent: 5 rows, 7e-9).
3. Classes. Equal sets are one class. Tokens that a single class holds are left out, with the classes that have none left in
   one of the halves; only of the others are texts read again and full sets made.
4. Exact sets. Classes lie in pages of bounded size by their first coordinate; pages verify candidates on full sets, meet at
   shared tokens until only tokens of one component are left, and links become components (see ngram_join for both).

Signatures come from one pass over documents that shuffles no text; texts are shuffled once, collapsed by row, to meet the
classes that need them. No bucket makes all pairs of its members: classes of one component are not compared again.

Defined results: null texts and texts without words have the empty set, n_shingles 0, and are their own component; equal
rows are linked; a row of null doc_id belongs to its component and never names it unless all its ids are null; rows that
share the least id of their component are all kept by the flag (keep_first keeps one row); an empty table gives no rows;
extra columns are ignored by the join and kept by keep_first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ngram_join
from tidemark.llm.common import materialise, mix, row_key, shingle_hashes, slices, word_hashes

#: Per cent of the union, words in a shingle, bands in each half of a signature, weight of a page in shingles.
PERCENT, WIDTH, BANDS, PAGE_TOKENS = 85, 3, 32, 100_000
#: How likely a half may be to show no band of a pair at the threshold.
MISS = 1e-7
#: Multipliers of pi, and text bytes that one pass of all coordinates handles, so that its arrays stay in a core's cache.
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_CACHED = 1 << 19
_SIGMA = np.uint64(0x2545F4914F6CDD1D)


def rows_of(percent: int, bands: int = BANDS) -> int:
    """Coordinates in a band: the most that miss a pair at the threshold with probability MISS or less."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** bands <= MISS:
        rows += 1
    return rows


def signatures(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """[coordinate, text] of uint32, for texts that all have shingles."""
    begin = np.cumsum(counts) - counts
    spread = (mix(hashes ^ _SIGMA) >> np.uint64(32)).astype(np.uint32) * _A
    out, x, y = np.empty((size, len(counts)), np.uint32), np.empty_like(spread), np.empty_like(spread)
    with np.errstate(over="ignore"):
        for k in range(size):
            # (position - k) * A on the circle, then a mixing step and a second odd factor: all of them permutations.
            np.subtract(spread, np.uint32(k) * _A, out=x)
            np.right_shift(x, 15, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _B, out=x)
            out[k] = np.minimum.reduceat(x, begin)
    return out


def band_tokens(signature: np.ndarray, rows: int) -> np.ndarray:
    """[band, text]: one 64-bit token for each band of rows coordinates."""
    bands = len(signature) // rows
    token = mix(np.arange(bands, dtype=np.uint64)[:, None] + _SIGMA) + np.zeros(signature.shape[1], np.uint64)
    for r in range(rows):
        token = mix(token * np.uint64(3) + signature[r::rows][:bands].astype(np.uint64))
    return token.astype(np.int64)


_FIELDS = [("doc_id", pa.int64()), ("row", pa.string()), ("n", pa.int64()), ("node", pa.int64()), ("home", pa.int64()), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.int64()))]
_SCHEMA = "doc_id long, row string, n long, node long, home long, first array<long>, second array<long>"


def _sketched(table: pa.RecordBatch, width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for at, part in slices(table["text"], _CACHED):
        hashes, counts = shingle_hashes(*word_hashes(part), width)
        ends = np.cumsum(counts)
        n, node = [], []
        for a, b in zip(ends - counts, ends, strict=True):
            s = np.unique(hashes[a:b])
            n.append(len(s))
            node.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
        full = np.flatnonzero(counts)
        home, first, second = ([None] * len(counts) for _ in range(3))
        if len(full):
            signature = signatures(hashes, counts[full], 2 * bands * rows)
            halves = [band_tokens(h, rows).T for h in np.split(signature, 2)]
            for i, j in enumerate(full):
                home[j], first[j], second[j] = int(signature[0, i]), halves[0][i], halves[1][i]
        held = [table["doc_id"][at : at + len(part)], table["row"][at : at + len(part)], n, node, home, first, second]
        yield pa.record_batch([pa.array(x, t) if isinstance(x, list) else x for x, (_, t) in zip(held, _FIELDS, strict=True)], [c for c, _ in _FIELDS])


def sketches(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS) -> DataFrame:
    """doc_id, row, n (set size), node (names the set), home (first coordinate), first and second (tokens of each half); null without words."""
    rows = rows_of(percent, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sketched(batch, width, bands, rows)

    return docs.select("doc_id", row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _SCHEMA)


def _shared(classes: DataFrame, half: str) -> DataFrame:
    """node and its tokens of that half that other classes hold too, for classes that have such."""
    at = classes.select("node", F.explode(half).alias("token"))
    common = at.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("token")
    return materialise(at.join(materialise(common, "tokens"), "token").groupBy("node").agg(F.collect_list("token").alias(half)), "shared")


def candidates(docs: DataFrame, sketched: DataFrame, width: int = WIDTH) -> DataFrame:
    """Classes that share a token with others in both halves: node, n, home, their shared tokens and full sets (items)."""
    classes = materialise(sketched.filter("n > 0").dropDuplicates(["node"]), "classes")
    left = classes.drop("first").join(_shared(classes, "first"), "node")
    left = materialise(left, "halves")
    both = left.drop("second").join(_shared(left, "second"), "node")
    # Copies of a row are collapsed on their way to the join, which needs the same distribution.
    texts = docs.select(row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text")).groupBy("row").agg(F.first("text").alias("text"))
    joined = texts.join(both.select("node", "n", "home", "first", "second", "row"), "row").select("node", "n", "home", "first", "second", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch["text"]):
                items = [s.tobytes() for s in ngram_join._sets(part, width)]
                yield pa.record_batch([*(batch[c][at : at + len(part)] for c in ("node", "n", "home", "first", "second")), pa.array(items, pa.binary())], ["node", "n", "home", "first", "second", "items"])

    return materialise(joined.mapInArrow(sets, "node long, n long, home long, first array<long>, second array<long>, items binary"), "live")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, page_tokens: int = PAGE_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (it names its component): one row for each document."""
    sketched = materialise(sketches(docs, percent, width, bands), "sketches")
    paged = ngram_join.lay_out(candidates(docs, sketched, width), percent, page_tokens)
    out = ngram_join.by_components(sketched.select("doc_id", "n", "node"), paged, percent, page_tokens)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, page_tokens: int = PAGE_TOKENS) -> DataFrame:
    """docs with one row of each component, the one of least id (null comes last), of equal rows one; rows without words all stay."""
    sketched = materialise(sketches(docs, percent, width, bands), "sketches")
    paged = ngram_join.lay_out(candidates(docs, sketched, width), percent, page_tokens)
    return ngram_join.keep_least(docs, sketched.select("doc_id", "row", "n", "node"), paged, percent, page_tokens)
