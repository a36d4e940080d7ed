"""Benchmark decontamination by the q-gram lemma.

Texts are reduced to lower-case letters and digits with single spaces between runs, keeping each code point's place.
An occurrence of an item of n code points with at most k edits shares at least n + 1 - q - k q q-grams with it, all
within k diagonals of each other. So the shared q-grams are counted in bands of diagonals 2 w wide that overlap by
half (w is at least k + 1, hence each occurrence lies whole within one band); bands that reach the item's bound become
regions, and a banded alignment, free at the text's ends, verifies each one. Regions are aligned in batches.

Items of fewer than SHORT reduced code points have no edits to spare: they are found word for word, with whole words at
both ends, by the hash of their whole length (the lemma with q the item's length and a band of one diagonal).

Items are the small side. They go to the executors in blocks of a bounded number of code points, so what is held by the
driver, broadcast and indexed has a fixed size; more items mean more passes over the documents, each of which is written
before the next block is read. A worker keeps the index of the block that it searches, whatever number of tasks it runs.

Defined results: null and empty texts match nothing, items without a letter or digit match nothing; equal items each
match; repeated rows each get theirs and rows of null doc_id keep it; an empty table of documents or items gives no
matches; extra columns are ignored by find_leaks and kept by decontaminate, which judges each row by its own text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import materialise, pieces

#: q-gram length, edits allowed as a share of an item's length, length below which none are, items' code points in a block.
Q, EDITS, SHORT, BLOCK_CHARS = 8, 0.06, 40, 4_000_000
#: Code points that one pass over documents holds, and regions aligned at once.
SLICE_CHARS, ALIGN = 1 << 20, 512
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint32(0x110000)


def _table() -> np.ndarray:
    """For each code point: its lower-case form if it's a letter or digit, else 0."""
    out = np.zeros(0x110002, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[_PAD] = _PAD
    return out


_REDUCED: list[np.ndarray] = []


def reduce_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced code points of all texts with a pad before each, their places in the joined texts, and each text's first index."""
    if not _REDUCED:
        _REDUCED.append(_table())
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.full(int(sizes.sum()) + len(texts), _PAD, np.uint32)
    first = np.cumsum(sizes + 1) - sizes - 1
    body = np.ones(len(raw), bool)
    body[first] = False
    raw[body] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    low = _REDUCED[0][raw]
    gap = low == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1] & (raw[:-1] != _PAD)
    low[gap] = 32
    places = np.flatnonzero(keep)
    return low[places], places, np.searchsorted(places, first)


def qgrams(x: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q code points from each index on, by doubling the window's width."""
    if len(x) < q:
        return np.empty(0, np.uint64)
    wide = x.astype(np.uint64)
    h, width = wide, 1
    for bit in bin(q)[3:]:
        h, width = h[:-width] * np.uint64(pow(int(_STEP), width, 1 << 64)) + h[width:], 2 * width
        if bit == "1":
            h, width = h[:-1] * _STEP + wide[width:], width + 1
    return (h ^ (h >> np.uint64(29))) * _STEP


class _Short:
    """Items of one short length, by the hash of the whole."""

    def __init__(self, n: int, rows: list[tuple[int, np.ndarray]]):
        h = np.array([qgrams(c, n)[0] for _, c in rows])
        order = np.argsort(h, kind="stable")
        self.n, self.keys, self.rows = n, h[order], [rows[i] for i in order]

    def find(self, reduced: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of each occurrence with whole words at both ends."""
        if len(reduced) < self.n:
            return
        h = qgrams(reduced, self.n)
        low, high = np.searchsorted(self.keys, h), np.searchsorted(self.keys, h, "right")
        for at in np.flatnonzero(low < high):
            end = at + self.n
            if reduced[at - 1] in (32, _PAD) and (end == len(reduced) or reduced[end] in (32, _PAD)):
                for item, code in self.rows[low[at] : high[at]]:
                    if (reduced[at:end] == code).all():
                        yield int(np.searchsorted(first, at, "right")) - 1, item, int(at), int(end)


class Items:
    """The q-gram index of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], q: int, edits: float):
        self.q = q
        reduced, _, first = reduce_texts([t for _, t in rows])
        ends = np.append(first[1:], len(reduced))
        self.ids, self.codes = [], []
        short: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (item, _), a, b in zip(rows, first, ends, strict=True):
            code = reduced[a + 1 : b]
            code = code[:-1] if len(code) and code[-1] == 32 else code
            code = code[1:] if len(code) and code[0] == 32 else code
            if len(code) >= SHORT:
                self.ids.append(item)
                self.codes.append(code)
            elif len(code):
                short.setdefault(len(code), []).append((item, code))
        self.short = {n: _Short(n, rows) for n, rows in short.items()}
        size = np.array([len(c) for c in self.codes], np.int64)
        self.size, self.k = size, np.floor(size * edits).astype(np.int64)
        self.bound = np.maximum(1, size + 1 - q - self.k * q)
        self.width = max(32, int(self.k.max(initial=0)) + 1)
        grams = [qgrams(c, q) for c in self.codes]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.keys, self.begin = np.unique(h[order], return_index=True)
        self.end = np.append(self.begin[1:], len(h))
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.at = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])[order].astype(np.int64)
        self.bits = max(16, int(np.ceil(np.log2(max(2, len(self.keys))))) + 6)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True

    def regions(self, reduced: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, lower diagonal) of each band that reaches its item's bound."""
        none = np.empty(0, np.int64)
        if not len(self.keys) or len(reduced) < self.q:
            return none, none, none
        h = qgrams(reduced, self.q)
        hit = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)])
        slot = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
        same = self.keys[slot] == h[hit]
        hit, slot = hit[same], slot[same]
        # A band lies within one text: places are counted from far apart bases, so texts never share a band.
        n = self.end[slot] - self.begin[slot]
        place = np.repeat(self.begin[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[place]
        diagonal = np.repeat(hit, n) - self.at[place] + len(self.size) + int(self.size.max())
        text = np.repeat(np.searchsorted(first, hit, "right") - 1, n)
        out = []
        for shift in (0, 1):
            band = (diagonal + shift * self.width) // (2 * self.width)
            span = int(band.max(initial=0)) + 1
            key = (text * len(self.size) + item) * span + band
            key, count = np.unique(key, return_counts=True)
            which = (key // span) % len(self.size)
            good = count >= self.bound[which]
            key, which = key[good], which[good]
            out.append(np.stack([key // span // len(self.size), which, (key % span) * 2 * self.width - shift * self.width - len(self.size) - int(self.size.max())]))
        return tuple(np.concatenate(out, axis=1))

    def align(self, reduced: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the regions within their edit budget; indices into reduced, end exclusive."""
        ends = np.append(first[1:], len(reduced))
        order = np.argsort(self.size[item], kind="stable")
        for i in range(0, len(order), ALIGN):
            part = order[i : i + ALIGN]
            yield from self._batch(reduced, first[text[part]] + 1, ends[text[part]], text[part], item[part], low[part])

    def _batch(self, reduced, lo, hi, text, item, low):
        # Column c of row r stands for the text index low + r + c: a band of diagonals, r running over the item.
        band = 2 * self.width + 1
        rows = int(self.size[item].max())
        columns = np.arange(band)
        cost = np.zeros((len(item), band), np.int32)
        start = low[:, None] + columns[None, :]
        far = np.int32(1 << 20)
        cost[(start < lo[:, None]) | (start > hi[:, None])] = far
        origin = np.broadcast_to(start, cost.shape).copy()
        codes = np.zeros((len(item), rows), np.uint32)
        for j, i in enumerate(item):
            codes[j, : self.size[i]] = self.codes[i]
        for r in range(1, rows + 1):
            live = np.flatnonzero(self.size[item] >= r)
            at = low[live, None] + r + columns[None, :] - 1
            inside = (at >= lo[live, None]) & (at < hi[live, None])
            letter = np.where(inside, reduced[np.clip(at, 0, len(reduced) - 1)], _PAD)
            c, o = cost[live], origin[live]
            best = np.where(inside, c + (letter != codes[live, r - 1][:, None]), far)
            root = o.copy()
            up = np.concatenate([c[:, 1:], np.full((len(live), 1), far, np.int32)], axis=1) + 1
            up_root = np.concatenate([o[:, 1:], o[:, -1:]], axis=1)
            root, best = np.where(up < best, up_root, root), np.minimum(best, up)
            # Insertions run along the row: prefix minimum of cost minus column.
            slope = best - columns[None, :]
            run = np.minimum.accumulate(slope, axis=1)
            source = np.maximum.accumulate(np.where(slope == run, columns[None, :], 0), axis=1)
            cost[live] = run + columns[None, :]
            origin[live] = np.take_along_axis(root, source, axis=1)
        end = low[:, None] + self.size[item][:, None] + columns[None, :]
        cost[(end > hi[:, None]) | (end <= lo[:, None])] = far
        pick = cost.argmin(axis=1)
        row = np.arange(len(item))
        for j in np.flatnonzero(cost[row, pick] <= self.k[item]):
            yield int(text[j]), int(item[j]), int(origin[j, pick[j]]), int(end[j, pick[j]]), int(cost[j, pick[j]])


    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of each region found in the texts, as code points of the row's text."""
        for row, part in _chunks(texts):
            reduced, places, first = reduce_texts(part)
            begins = np.cumsum([0] + [len(t) + 1 for t in part])
            found = {(t, self.ids[i], a, b, e) for t, i, a, b, e in self.align(reduced, first, *self.regions(reduced, first))}
            for short in self.short.values():
                found |= {(t, item, a, b, 0) for t, item, a, b in short.find(reduced, first)}
            for t, item, a, b, e in sorted(found):
                yield row + t, item, int(places[a] - begins[t] - 1), int(places[b - 1] - begins[t]), e


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    a = total = 0
    for b, t in enumerate(texts):
        if b > a and total + len(t) > SLICE_CHARS:
            yield a, texts[a:b]
            a, total = b, 0
        total += len(t)
    if a < len(texts):
        yield a, texts[a:]


#: The index that this worker searches, by the name of its block.
_HELD: dict[str, Items] = {}


class _Block:
    """A block of items as the executors see it."""

    def __init__(self, spark: SparkSession, rows: list[tuple[int, str]], q: int, edits: float):
        self.rows, self.q, self.edits, self.name = spark.sparkContext.broadcast(rows), q, edits, uuid.uuid4().hex

    def items(self) -> Items:
        if self.name not in _HELD:
            _HELD.clear()
            _HELD[self.name] = Items(self.rows.value, self.q, self.edits)
        return _HELD[self.name]


_FOUND = "doc_id long, item_id long, start long, `end` long, edits long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text, end exclusive), edits: one row for each region found in each row."""

    def searched(block: _Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], *rest) for t, *rest in block.items().search([t or "" for t in batch.column("text").to_pylist()])]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

        return docs.select("doc_id", "text").mapInArrow(run, _FOUND)

    out, spark = None, docs.sparkSession
    for rows, last in item_blocks(benchmark, block_chars):
        found = searched(_Block(spark, rows, q, edits))
        found = found if last else materialise(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows whose text holds a benchmark item: a filter over whole rows, nothing is shuffled."""

    def kept(out: DataFrame, block: _Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                clean = np.ones(len(batch), bool)
                clean[[t for t, *_ in block.items().search([t or "" for t in batch.column("text").to_pylist()])]] = False
                yield batch.filter(pa.array(clean))

        return out.mapInArrow(run, StructType(list(out.schema.fields)))

    for rows, last in item_blocks(benchmark, block_chars):
        docs = kept(docs, _Block(docs.sparkSession, rows, q, edits))
        docs = docs if last else materialise(docs, "clean")
    return docs


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Items in blocks of at most block_chars code points (or one item), and whether it's the last: one block at a time on the driver."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        if block and held + len(r["text"]) > block_chars:
            yield block, False
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
    if block:
        yield block, True
