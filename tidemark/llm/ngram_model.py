"""Language-model scoring with an n-gram trie held in Elias-Fano levels.

The model is an interpolated bigram with absolute discounting over words and an end mark:

    p(w | v) = max(c(v, w) - D, 0) / C(v) + D N(v) / C(v) p(w),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

The trie's first level holds the contexts v with their quantised back-off weight D N(v) / C(v); a monotone pointer
leads to the range of v's successors in the second level, which holds them in order with the quantised discounted
probability. Successor words are stored relative to their context (the context's place times a fixed width), so the
whole level is one monotone sequence. Both levels and the pointers are Elias-Fano coded in one piece of mapped memory,
whose bits a task searches as they are, with vectorised successor search.

The trie is split by ranges of context hash into shards that grow in number, not in size, with the corpus. Documents
are dealt to blocks; a block sends the distinct n-grams of its documents with their training counts, pre-aggregated,
to the shards; a shard sums the counts of all blocks, builds its part of the trie and answers each block with counts
and codes; the block then scores its documents. Only n-grams and codes travel, a shard answers only the blocks that
asked it, and everything is counted over all training documents.

A context that occurs more often than a shard holds tokens is hot: its successors are dealt by hash to as many slices
as its count asks for, each in a shard of its own choice, so no shard gets a hot context whole. The count C(v) of a
hot context comes from the vocabulary, which is counted first; N(v) is the sum over its slices, all of which a block
that holds the context asks. Hot contexts are at most 200,000, whatever the corpus.

Words are told apart by 64-bit hashes; below a context by their upper 40 bits.

Defined results: null and empty texts are one end mark; repeated rows each get their score; without training
documents every token has probability 1 under the base and the model; extra columns are ignored.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, mix, slices, word_hashes

DISCOUNT, SMOOTH, BLOCK_BYTES = 0.75, 0.1, 4 << 20
#: Hashes of the begin and end marks; no word's hash is expected to be one of them.
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_SUCCESSOR = np.uint64(24)
#: Bytes of text taken for one token where counts are compared with sizes; and a bound of the hot contexts.
TOKEN_BYTES, MOST_HOT = 6, 200_000


class EliasFano:
    """A monotone sequence: low bytes stored plainly, high parts as a unary bit string (a one for each element, a zero at
    each bucket's end) that is searched as it is, with the ones before every BLOCK words as its only directory. Arrays may
    be memory-mapped; nothing is unpacked."""

    #: 64-bit words between two entries of the directory.
    BLOCK = 8

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bytes, self.low, self.bits = n, low_bytes, low, high.view("<u8")
        ones = np.add.reduceat(np.bitwise_count(self.bits).astype(np.int64), np.arange(0, len(self.bits), self.BLOCK))
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32 if n < 1 << 32 else np.int64)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        # Whole bytes, rounded up: the unary string and the buckets stay within a few bits of an element.
        low_bytes = min(7, ((max(1, top // max(1, n)).bit_length() - 1) + 7) // 8)
        raw = values.astype("<u8").view(np.uint8).reshape(n, 8)
        high = (values >> np.uint64(8 * low_bytes)).astype(np.int64)
        length = int(high[-1]) + n + 1 if n else 1
        bits = np.zeros(-(-length // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        return n, low_bytes, np.ascontiguousarray(raw[:, :low_bytes]).tobytes(), np.packbits(bits, bitorder="little").tobytes()

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th one (or zero), counted from 0: by directory, then by word, then by halves of the word."""
        held = self.before.astype(np.int64)
        if zeros:
            held = np.arange(len(held)) * 64 * self.BLOCK - held
        block = np.searchsorted(held, k, "right") - 1
        left, word = k - held[block], block * self.BLOCK
        flip = np.uint64(0xFFFFFFFFFFFFFFFF) if zeros else np.uint64(0)
        for _ in range(self.BLOCK - 1):
            count = np.bitwise_count(self.bits[np.minimum(word, len(self.bits) - 1)] ^ flip).astype(np.int64)
            on = left >= count
            left, word = np.where(on, left - count, left), np.where(on, word + 1, word)
            if not on.any():
                break
        rest, at = self.bits[word] ^ flip, np.zeros(len(k), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((rest >> at) & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left >= count
            left, at = np.where(on, left - count, left), np.where(on, at + np.uint64(width), at)
        return word * 64 + at.astype(np.int64)

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for b in range(self.low_bytes):
            out |= self.low[at, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, False) - at).astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._low(at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element not below each value (n if none): a search inside the value's bucket."""
        out = np.full(len(values), self.n, np.int64)
        if not self.n:
            return out
        shift = np.uint64(8 * self.low_bytes)
        last = int(self._select(np.array([self.n - 1]), False)[0]) - self.n + 1
        inside = np.flatnonzero((values >> shift) <= np.uint64(last))
        bucket = (values[inside] >> shift).astype(np.int64)
        lo = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), True) - np.maximum(bucket - 1, 0), 0)
        hi = self._select(bucket, True) - bucket
        want = values[inside] & ((np.uint64(1) << shift) - np.uint64(1))
        while (open_ := lo < hi).any():
            middle = (lo + hi) >> 1
            below = np.zeros(len(lo), bool)
            below[open_] = self._low(middle[open_]) < want[open_]
            lo, hi = np.where(open_ & below, middle + 1, lo), np.where(open_ & ~below, middle, hi)
        out[inside] = lo
        return out


def quantise(p: np.ndarray, levels: int = 254) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 1 and a code book (code 0: absent, value 0): bins of equal width in log p, each with its mean p."""
    if not len(p):
        return np.empty(0, np.uint8), np.zeros(levels + 2)
    lp = np.log(np.maximum(p, 1e-30))
    distinct = np.unique(lp)
    edges = distinct if len(distinct) <= levels else np.linspace(distinct[0], distinct[-1], levels)
    code = np.clip(np.searchsorted((edges[1:] + edges[:-1]) / 2, lp), 0, len(edges) - 1)
    book = np.zeros(levels + 2)
    total = np.bincount(code, weights=p, minlength=len(edges))
    book[1 : len(edges) + 1] = total / np.maximum(1, np.bincount(code, minlength=len(edges)))
    return (code + 1).astype(np.uint8), book


class Trie:
    """A shard's trie in mapped memory of its own, which only its task sees and which no file backs."""

    def __init__(self, contexts: np.ndarray, backoff: np.ndarray, place: np.ndarray, successor: np.ndarray, p: np.ndarray):
        """contexts: ascending; place and successor: of each n-gram, ascending by both; p: its discounted probability."""
        self.backoff_codes, self.backoff_book = quantise(backoff)
        codes, self.book = quantise(p)
        pointers = np.searchsorted(place, np.arange(len(contexts) + 1)).astype(np.uint64)
        levels = [EliasFano.encode(x) for x in (contexts, pointers, (place.astype(np.uint64) << np.uint64(40)) | successor)]
        # Words first, so that they lie at multiples of eight bytes.
        self.memory = mmap.mmap(-1, sum(len(high) + len(low) for _, _, low, high in levels) + len(codes) + 1)
        for part in (*(high for *_, high in levels), *(low for _, _, low, _ in levels), codes.tobytes()):
            self.memory.write(part)
        held = np.frombuffer(self.memory, np.uint8)
        at, self.levels, highs = 0, [], []
        for *_, high in levels:
            highs.append(held[at : at + len(high)])
            at += len(high)
        for (n, low_bytes, low, _), high in zip(levels, highs, strict=True):
            self.levels.append(EliasFano(n, low_bytes, held[at : at + len(low)].reshape(n, low_bytes), high))
            at += len(low)
        self.codes = held[at : at + len(codes)]
        self.size = at + len(codes)

    def find_contexts(self, v: np.ndarray) -> np.ndarray:
        """Place of each context, -1 if the trie lacks it."""
        level = self.levels[0]
        at = level.successor(v)
        inside = at < level.n
        same = np.zeros(len(v), bool)
        same[inside] = level[at[inside]] == v[inside]
        return np.where(same, at, -1)

    def find_successors(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each word below the context at that place; 0 if it never follows it."""
        out = np.zeros(len(place), np.uint8)
        known = np.flatnonzero(place >= 0)
        value = (place[known].astype(np.uint64) << np.uint64(40)) | word[known]
        at = self.levels[2].successor(value)
        inside = at < self.levels[1][place[known] + 1].astype(np.int64)
        known, at, value = known[inside], at[inside], value[inside]
        same = self.levels[2][at] == value
        out[known[same]] = self.codes[at[same]]
        return out


class Block:
    """The distinct words and bigrams of a block's documents; the same texts always give the same order."""

    def __init__(self, table: pa.Table):
        parts, counts = [], []
        for _, text in slices(table["text"]):
            h, c = word_hashes(text)
            parts.append(h)
            counts.append(c)
        words, counts = np.concatenate([*parts, np.empty(0, np.uint64)]), np.concatenate([*counts, np.empty(0, np.int64)])
        self.size = counts + 1
        ends = np.cumsum(counts + 2)
        stream = np.empty(int(ends[-1]), np.uint64)
        inner = np.ones(len(stream), bool)
        inner[ends - 1] = inner[ends - counts - 2] = False
        stream[inner], stream[ends - 1], stream[ends - counts - 2] = words, END, BEGIN
        self.doc = np.repeat(np.arange(len(counts)), counts + 1)
        self.v, slot = np.unique(stream, return_inverse=True)
        head = np.ones(len(stream), bool)
        head[ends - 1] = False
        self.left, self.right = slot[head], slot[np.roll(head, 1)]
        code, self.gram = np.unique(self.left * len(self.v) + self.right, return_inverse=True)
        self.of, self.to = code // len(self.v), code % len(self.v)
        self.train = np.repeat(table["train"].to_numpy(zero_copy_only=False), self.size)


class Hot:
    """The hot contexts, ascending by hash, with their training counts and numbers of slices."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, most: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.slices = self.counts // most + 1

    def place(self, v: np.ndarray) -> np.ndarray:
        """Place of each context, -1 if it isn't hot."""
        if not len(self.words):
            return np.full(len(v), -1)
        at = np.minimum(np.searchsorted(self.words, v), len(self.words) - 1)
        return np.where(self.words[at] == v, at, -1)

    def shard(self, v: np.ndarray, piece: np.ndarray, shards: int) -> np.ndarray:
        """The shard of each slice of a hot context."""
        return (mix(mix(v) + piece.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


class Layout:
    """What a block sends to each shard: words (those at home there and the hot contexts sliced there) and n-grams."""

    def __init__(self, b: Block, shards: int, hot: Hot):
        n, home = len(b.v), ((b.v >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        place = hot.place(b.v)
        at = home[b.of]
        sliced = np.flatnonzero(place[b.of] >= 0)
        v, pieces = b.v[b.of[sliced]], hot.slices[place[b.of[sliced]]]
        at[sliced] = hot.shard(v, mix(b.v[b.to[sliced]] >> _SUCCESSOR) % pieces.astype(np.uint64), shards)
        # Every slice of each hot context that the block holds is asked, for the sum of successors.
        held = np.flatnonzero(place >= 0)
        many = hot.slices[place[held]]
        owner = np.repeat(held, many)
        piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own = home * n + np.arange(n)
        entry = np.unique(np.concatenate([own, hot.shard(b.v[owner], piece, shards) * n + owner]))
        key = at * n + b.of
        self.shards, self.word = np.divmod(entry, n)
        self.at_home = home[self.word] == self.shards
        self.follows = np.bincount(np.searchsorted(entry, key), minlength=len(entry))
        self.gram = np.argsort(key, kind="stable")
        self.use, first = np.unique(self.shards, return_index=True)
        ends = np.append(first[1:], len(entry))
        gram_ends = np.concatenate([[0], np.cumsum(self.follows)])
        self.words = [slice(x, y) for x, y in zip(first, ends, strict=True)]
        self.grams = [slice(gram_ends[x], gram_ends[y]) for x, y in zip(first, ends, strict=True)]


def _binary(values: list[np.ndarray], kind: str) -> pa.Array:
    return pa.array([x.astype(kind).tobytes() for x in values], pa.binary())


def _numbers(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v or b"", kind) for v in column.to_pylist()]


_ASKED = "block int, shard int, words binary, counts binary, follows binary, low binary, high binary, seen binary"
_ANSWERED = "block int, shard int, counts binary, backoff binary, codes binary, books binary"


def _ask(shards: int, hot: Broadcast):
    def run(table: pa.Table) -> pa.Table:
        b = Block(table)
        sent = Layout(b, shards, hot.value)
        unigrams = np.bincount(b.right, weights=b.train, minlength=len(b.v)).astype(np.int64)[sent.word] * sent.at_home
        seen = np.bincount(b.gram, weights=b.train, minlength=len(b.of)).astype(np.int64)[sent.gram]
        words, to = b.v[sent.word], b.v[b.to[sent.gram]] >> _SUCCESSOR
        return pa.table({
            "block": pa.array([table["block"][0].as_py()] * len(sent.use), pa.int32()), "shard": pa.array(sent.use, pa.int32()), "words": _binary([words[c] for c in sent.words], "<u8"),
            "counts": _binary([unigrams[c] for c in sent.words], "<u4"), "follows": _binary([sent.follows[c] for c in sent.words], "<u4"), "low": _binary([to[g] & np.uint64(0xFFFFFFFF) for g in sent.grams], "<u4"),
            "high": _binary([to[g] >> np.uint64(32) for g in sent.grams], "u1"), "seen": _binary([seen[g] for g in sent.grams], "<u4"),
        })

    return run


def _answer(discount: float, hot: Broadcast):
    def run(table: pa.Table) -> pa.Table:
        words, counts, follows, low, high, seen = (_numbers(table[c], k) for c, k in (("words", "<u8"), ("counts", "<u4"), ("follows", "<u4"), ("low", "<u4"), ("high", "u1"), ("seen", "<u4")))
        v, slot = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(slot, weights=np.concatenate(counts)).astype(np.int64)
        asked_of = np.repeat(slot, np.concatenate(follows))
        to = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
        times = np.concatenate(seen).astype(np.int64)
        taught = times > 0
        key, at = np.unique((asked_of[taught].astype(np.uint64) << np.uint64(40)) | to[taught], return_inverse=True)
        c = np.bincount(at, weights=times[taught], minlength=len(key)) if len(key) else np.empty(0)
        place = (key >> np.uint64(40)).astype(np.int64)
        total = np.bincount(place, weights=c, minlength=len(v)) if len(key) else np.zeros(len(v))
        kinds = np.bincount(place, minlength=len(v))
        known = hot.value.place(v)
        total = np.where((known >= 0) & (total > 0), np.append(hot.value.counts, 0)[known], total)
        held = np.flatnonzero(total > 0)
        rank = np.cumsum(total > 0) - 1
        trie = Trie(v[held], discount * kinds[held] / total[held], rank[place], key & np.uint64((1 << 40) - 1), np.maximum(c - discount, 0) / total[place] if len(key) else c)
        spot = trie.find_contexts(v)
        codes = trie.find_successors(spot[asked_of], to)
        backoff = np.where(spot >= 0, np.append(trie.backoff_codes, 0)[spot], 0).astype(np.uint8)
        books = np.concatenate([trie.backoff_book, trie.book]).astype("<f4").tobytes()
        rows: dict[int, tuple] = {}
        a = g = 0
        for block, w, t in zip(table["block"].to_pylist(), words, low, strict=True):
            own = slot[a : a + len(w)]
            rows[block] = (count[own].astype("<i8").tobytes(), backoff[own].tobytes(), codes[g : g + len(t)].tobytes())
            a, g = a + len(w), g + len(t)
        n = len(rows)
        columns = list(zip(*rows.values(), strict=True))
        return pa.table({
            "block": pa.array(list(rows), pa.int32()), "shard": pa.array([table["shard"][0].as_py()] * n, pa.int32()), **{k: pa.array(c, pa.binary()) for k, c in zip(("counts", "backoff", "codes"), columns, strict=True)},
            "books": pa.array([books] * n, pa.binary()),
        })

    return run


def _tally(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and the sums of their counts."""
    found, at = np.unique(np.concatenate(words), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def vocabulary(base: DataFrame, most: int) -> tuple[int, int, Hot]:
    """Tokens and distinct tokens of the training rows, end marks included, and the hot contexts (more than most times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = [np.array([END])], [np.array([len(batch)])]
            for _, part in slices(batch.column("text")):
                found, n = np.unique(word_hashes(part)[0], return_counts=True)
                words.append(found)
                counts.append(n)
                if sum(map(len, words)) > 2 * len(words[0]) + SLICE_BYTES:  # holds distinct words, not all words of the batch
                    found, n = _tally(words, counts)
                    words, counts = [found], [n]
            found, n = _tally(words, counts)
            yield pa.RecordBatch.from_pydict({"h": pa.array(found.view(np.int64)), "n": pa.array(n, pa.int64())})

    counts = base.filter("train").select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # Counts above most are fewer than tokens / most, which score_documents bounds.
    often = F.collect_list(F.when(F.col("n") > most, F.struct("h", "n")))
    total, distinct, found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), often).first()
    words, times = np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    # Each training document begins as often as it ends; an end has no successors.
    return total, distinct, Hot(np.where(words == END, BEGIN, words), times, most)


def _score(smooth: float, total: int, distinct: int, shards: int, hot: Broadcast):
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")

    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{n: pa.array([], pa.float64() if "score" in n else pa.int64()) for n in names}})
        b = Block(docs)
        sent, got = Layout(b, shards, hot.value), got.sort_by("shard")
        books = [book.reshape(2, -1) for book in _numbers(got["books"], "<f4")]
        count, backoff, codes = np.empty(len(b.v), np.int64), np.zeros(len(b.v)), np.empty(len(b.of))
        count[sent.word[sent.at_home]] = np.concatenate(_numbers(got["counts"], "<i8"))[sent.at_home]
        for c, f, book in zip(sent.words, _numbers(got["backoff"], "u1"), books, strict=True):
            backoff[sent.word[c]] += book[0][f]
        for g, c, book in zip(sent.grams, _numbers(got["codes"], "u1"), books, strict=True):
            codes[sent.gram[g]] = book[1][c]
        backoff[backoff == 0] = 1.0
        base = (count + smooth) / (total + smooth * (distinct + 1))
        known = count > 0
        p = codes + backoff[b.of] * base[b.to]
        n = len(b.size)
        by_doc = lambda x: np.bincount(b.doc, weights=x, minlength=n)
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": pa.array(~docs["train"].to_numpy(zero_copy_only=False)), "n_tokens": pa.array(b.size.astype(np.int64)), "n_known": pa.array(by_doc(known[b.right]).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(by_doc(np.log10(base)[b.right])), "score": pa.array(by_doc(np.log10(p)[b.gram])),
        })

    return run


def score_documents(docs: DataFrame, train: Column, discount: float = DISCOUNT, smooth: float = SMOOTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; train says which rows the model learns from."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    shards = blocks // 2 + 1
    total, distinct, found = vocabulary(base, max(size // shards // TOKEN_BYTES, size // MOST_HOT, block_bytes // TOKEN_BYTES, 1))
    hot = docs.sparkSession.sparkContext.broadcast(found)
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = base.groupBy("block").applyInArrow(_ask(shards, hot), _ASKED)
    answered = asked.groupBy("shard").applyInArrow(_answer(discount, hot), _ANSWERED)
    scored = _score(smooth, total, distinct, shards, hot)
    return base.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
