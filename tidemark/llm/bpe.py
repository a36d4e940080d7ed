"""Byte-level BPE by monoid tree reduction, and decoding up the same tree.

A text is cut in halves down to leaves of LEAF code points. An encoded part is its list of pre-token matches with their
tokens; two neighbours are joined by encoding anew a window around their border that grows until what lies outside
provably stays as it is:

* On the left a match stays once LOOK code points follow it, for no match looks farther past its own end.
* On the right the matches stay from the first place on at which a match of the window and one of the right part begin
  alike, for a match depends only on where it begins and what follows. The window takes in more of the right part's
  matches, twice as many at each step, until there is such a place.

Inside one match the same is done with bytes: a match is cut in halves down to WORD bytes, which are merged by rank, and
a sequence of tokens is the encoding of its bytes exactly when each adjacent pair is the encoding of that pair's bytes.
So a window of tokens around the border is merged anew and grows until the pairs at both of its ends are stable. A match that goes on over the
border of two parts is joined from the tokens of both, so a run of letters of any length costs each level a window only.

Tokens of short matches are remembered in memos of bounded size, which changes no result; they end with the task, so that
a worker that goes on to other work doesn't hold them. Leaves of a match that a block of texts brings up anew are merged
by rank side by side, a column of an array each, into the memo; what isn't there later is merged by itself.

Defined results: null and empty texts have no tokens; text of any length is encoded whole; repeated rows each keep
theirs; special strings are ordinary text; rows of null doc_id keep it; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import pieces

#: Code points in a leaf of a text, bytes in a leaf of a match; code points that a match may look past its end; matches
#: and tokens in a first window; tokens in a decoded leaf; matches remembered, and the code points of the longest of them.
LEAF, WORD, LOOK, MATCHES, TOKENS, DECODED, MEMO, SHORT = 256, 16, 3, 2, 2, 256, 400_000, 48
#: Code points whose new matches are merged side by side.
BLOCK = 1 << 17
_NEVER = 1 << 60
#: In arrays: a pair's rank stands above the bits of its row; a pair of tokens is one number; ranks stay below both bounds.
_ROW, _SIDE, _NONE = 5, 32, (1 << 31) - 1
Ids = tuple[int, ...]
#: A part of a text: lengths and packed tokens of its matches.
Part = tuple[list[int], list[bytes]]


def pack(ids: Ids) -> bytes:
    """Tokens as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack(packed: bytes) -> Ids:
    return struct.unpack(f"<{len(packed) // 4}I", packed)


class ByteBpe:
    """One vocabulary: ranks by byte string and the pattern of its pre-token matches. windows counts what was encoded anew."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._index_pairs()
        self.matches = regex.compile(pattern).findall
        self.windows = 0
        self.forget()

    def forget(self) -> None:
        """Empties the memos. Freed tuples that Python keeps for reuse pin most of their memory until a collection."""
        self._memo: dict[str, bytes] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._merged: dict[Ids, Ids] = {}
        gc.collect()

    # Text tree.
    def encode(self, text: str) -> list[int]:
        return list(unpack(next(self.encode_all([text]))[1]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each text and its packed tokens; its new matches are merged with those of its neighbours, up to BLOCK code points."""
        block, size = [], 0
        for text in texts:
            if block and size + len(text) > BLOCK:
                yield from self._encoded(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        yield from self._encoded(block)

    def _encoded(self, block: list[str]) -> Iterator[tuple[str, bytes]]:
        parts = [self._part(block[0], 0, len(block[0]))] if len(block) == 1 else self._parts([(t, 0, len(t)) for t in block])
        for text, (_, packed) in zip(block, parts, strict=True):
            yield text, b"".join(packed)

    def _part(self, text: str, a: int, b: int) -> Part:
        if b - a <= BLOCK:
            return next(self._parts([(text, a, b)]))
        middle = (a + b) // 2
        return self._join_parts(text, middle, self._part(text, a, middle), self._part(text, middle, b))

    def _parts(self, block: list[tuple[str, int, int]]) -> Iterator[Part]:
        """Each part of a block of texts up its tree; what the leaves don't find in the memo is merged side by side before."""
        leaves, late, get = [], [], self._memo.get
        for text, a, b in block:
            for i, j in _leaves(a, b):
                found = self.matches(text[i:j])
                ids = list(map(get, found))
                leaves.append((list(map(len, found)), ids))
                if not all(ids):
                    late.append((ids, [(k, found[k]) for k, known in enumerate(ids) if known is None]))
        self._learn({piece for _, gaps in late for _, piece in gaps})
        for ids, gaps in late:
            for k, piece in gaps:
                ids[k] = get(piece) or self.word(piece)
        held = iter(leaves)
        return (self._tree(text, a, b, held) for text, a, b in block)

    def _tree(self, text: str, a: int, b: int, leaves: Iterator[Part]) -> Part:
        if b - a <= LEAF:
            return next(leaves)
        middle = (a + b) // 2
        return self._join_parts(text, middle, self._tree(text, a, middle, leaves), self._tree(text, middle, b, leaves))

    def _learn(self, new: set[str]) -> None:
        """Remembers those of the matches that are tokens or a single leaf."""
        ranks, pieces, words = self.ranks, [], []
        for piece in new:
            data = piece.encode()
            if data in ranks:
                self._remember(piece, pack((ranks[data],)))
            elif len(data) <= WORD:
                pieces.append(piece)
                words.append(data)
        for piece, packed in zip(pieces, self.merge_all(words), strict=True):
            self._remember(piece, packed)

    def _join_parts(self, text: str, border: int, left: Part, right: Part) -> Part:
        """The monoid's product on texts: the matches of both parts together."""
        self.windows += 1
        keep, begin = len(left[0]), border
        while keep and border - begin < LOOK:
            keep -= 1
            begin -= left[0][keep]
        last, take, end, held = left[1][-1:], 0, border, MATCHES
        while True:
            for size in right[0][take:held]:
                end += size
            take = min(held, len(right[0]))
            found = self.matches(text[begin:end])
            upto, skip = self._meeting(found, begin - border, right[0][:take], take == len(right[0]))
            if upto >= 0:
                break
            held *= 2
        over = left[0][-1] + right[0][0] if last and right[0] else -1
        at, ids = begin, []
        for piece in found[:upto]:
            # A match made of the left part's last and the right part's first is joined from their tokens.
            joined = len(piece) == over and at == border - left[0][-1]
            ids.append(self._match(piece, last[0], right[1][0]) if joined else self.word(piece))
            at += len(piece)
        del left[0][keep:], left[1][keep:]
        left[0].extend(map(len, found[:upto]))
        left[0].extend(right[0][skip:])
        left[1].extend(ids)
        left[1].extend(right[1][skip:])
        return left

    @staticmethod
    def _meeting(found: list[str], at: int, sizes: list[int], whole: bool) -> tuple[int, int]:
        """How many matches of the window, and of the right part's first ones, lie before the first place where both
        begin a match and LOOK code points follow (or all, if the window holds the whole right part); -1 without one."""
        end, begin, skip = sum(sizes), 0, 0
        for upto, piece in enumerate(found):
            while skip < len(sizes) and begin < at:
                begin += sizes[skip]
                skip += 1
            if at >= 0 and at == begin and (whole or at + LOOK <= end):
                return upto, skip
            at += len(piece)
        return (len(found), len(sizes)) if whole else (-1, 0)

    def word(self, piece: str) -> bytes:
        """Packed tokens of one match."""
        packed = self._memo.get(piece)
        if packed is None:
            data = piece.encode()
            packed = pack((self.ranks[data],) if data in self.ranks else self._bytes(data))
            self._remember(piece, packed)
        return packed

    def _match(self, piece: str, left: bytes, right: bytes) -> bytes:
        packed = self._memo.get(piece)
        if packed is not None:
            return packed
        if len(piece) <= self.longest and (data := piece.encode()) in self.ranks:
            return pack((self.ranks[data],))
        return pack(self.join(unpack(left), unpack(right)))

    def _remember(self, piece: str, packed: bytes) -> None:
        if len(piece) <= SHORT:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            self._memo[piece] = packed

    # Byte tree inside one match.
    def _bytes(self, data: bytes) -> Ids:
        if len(data) <= WORD:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self._bytes(data[:middle]), self._bytes(data[middle:]))

    def merge(self, data: bytes) -> Ids:
        """Merges neighbours by rank, the lowest and leftmost first, until none is in the vocabulary."""
        rank, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], _NEVER) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < _NEVER:
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], _NEVER)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], _NEVER)
        return tuple(map(self.ranks.__getitem__, parts))

    def _index_pairs(self) -> None:
        """Ranks of what pairs of tokens make: of pairs of bytes by both, of others by a sorted number of both."""
        get, pairs = self.ranks.get, {}
        for whole, rank in self.ranks.items():
            if len(whole) <= WORD:
                for i in range(1, len(whole)):
                    if (left := get(whole[:i])) is not None and (right := get(whole[i:])) is not None:
                        pairs[left << _SIDE | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self._pair_keys = np.append(keys[order], _NEVER)
        self._pair_ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], np.int32(_NONE >> _ROW))
        self._of_byte = np.array([get(bytes([i]), -1) for i in range(256)], np.int32)
        self._of_bytes = self._rank_pairs(self._of_byte[:, None], self._of_byte)

    def _rank_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, as high as can be where the vocabulary has none or a side is none (-1)."""
        pair = left.astype(np.int64) << _SIDE | right  # below 0 with a side of -1
        at = self._pair_keys.searchsorted(pair)
        return np.where(self._pair_keys[at] == pair, self._pair_ranks[at], np.int32(_NONE >> _ROW))

    def merge_all(self, words: list[bytes]) -> Iterator[bytes]:
        """merge() of each word of at most WORD bytes, packed, all side by side: each round merges the lowest and leftmost pair of each."""
        n, high = len(words), max(map(len, words), default=1) or 1
        sizes = np.fromiter(map(len, words), np.int32, n)
        data = np.array(words, f"S{high}").view(np.uint8).reshape(n, high).T
        rows = np.arange(high + 1, dtype=np.int32)[:, None]
        # A word is a column, a token stands in the row where it begins; the last row is beyond every word.
        tokens, low = np.full((high + 1, n), -1, np.int32), np.full((high + 1, n), _NONE, np.int32)
        tokens[:high] = np.where(rows[:high] < sizes, self._of_byte[data], tokens[:high])
        if np.count_nonzero(tokens >= 0) != sizes.sum():
            raise KeyError("a byte that the vocabulary lacks")
        low[: high - 1] = np.where(rows[1:high] < sizes, self._of_bytes[data[:-1], data[1:]] << _ROW | rows[: high - 1], low[: high - 1])
        after, before = np.minimum(rows + 1, sizes), np.repeat(rows - 1, n, 1)
        after[after >= sizes] = high
        before[0] = high
        tokens, low, after, before = (x.ravel() for x in (tokens, low, after, before))
        while True:
            least = low.reshape(high + 1, n).min(0)
            word = np.flatnonzero(least < _NONE >> _ROW << _ROW)
            if not word.size:
                break
            row = least[word] & (1 << _ROW) - 1
            at = row * n + word
            gone = after[at] * n + word
            behind = after[gone]
            ahead = before[at]
            tokens[at] = least[word] >> _ROW
            tokens[gone], low[gone] = -1, _NONE
            after[at], before[behind * n + word] = behind, row
            low[at] = self._rank_pairs(tokens[at], tokens[behind * n + word]) << _ROW | row
            at_ahead = ahead * n + word
            low[at_ahead] = self._rank_pairs(tokens[at_ahead], tokens[at]) << _ROW | ahead
        held = tokens.reshape(high + 1, n).T
        packed, end = held[held >= 0].astype("<u4").tobytes(), 0
        for size in (4 * (held >= 0).sum(1)).tolist():
            yield packed[end : end + size]
            end += size

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == (left, right)
        return known

    def join(self, left: Ids, right: Ids) -> Ids:
        """The monoid's product inside a match: the encoding of both byte strings together.

        The window moves over the right part's tokens until the pair at its right end is stable; where the pair at its
        left end isn't, it grows to the left.
        """
        out, at = list(left), 0
        while at < len(right) and out and not self.stable(out[-1], right[at]):
            width, end = TOKENS, min(at + TOKENS, len(right))
            while True:
                begin = max(0, len(out) - width)
                window = self._window((*out[begin:], *right[at:end]))
                if begin == 0 or self.stable(out[begin - 1], window[0]):
                    break
                width *= 2
            out[begin:] = window
            at = end
        return (*out, *right[at:])

    def _window(self, tokens: Ids) -> Ids:
        known = self._merged.get(tokens)
        if known is None:
            self.windows += 1
            if len(self._merged) >= MEMO:
                self._merged.clear()
            known = self._merged[tokens] = self.merge(b"".join([self.bytes_of[t] for t in tokens]))
        return known

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of halves, concatenated up the tree."""
        if len(ids) <= DECODED:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _leaves(a: int, b: int) -> Iterator[tuple[int, int]]:
    """Ranges of the leaves of a text's range, from the left."""
    if b - a <= LEAF:
        yield a, b
    else:
        middle = (a + b) // 2
        yield from _leaves(a, middle)
        yield from _leaves(middle, b)


@lru_cache(4)
def vocabulary(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact, and ids (binary, little-endian unsigned 32-bit; unless keep_ids is off).

    A map over the documents: nothing is shuffled. exact says whether decoding gave the text's bytes again.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(rank_file, pattern)
        for batch in pieces(batches):
            rows: dict[str, list] = {c: [] for c in ("n_tokens", "ids_sha256", "decoded_sha256", "exact", *["ids"] * keep_ids)}
            for text, packed in coder.encode_all(value.as_py() or "" for value in batch.column("text")):
                back = coder.decode(np.frombuffer(packed, "<u4").tolist())
                rows["n_tokens"].append(len(packed) // 4)
                rows["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                rows["exact"].append(back == text.encode())
                if keep_ids:
                    rows["ids"].append(packed)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | rows)
        coder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, text of encode_documents' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(rank_file, pattern)
        for batch in batches:
            texts = [coder.decode(np.frombuffer(v.as_py() or b"", "<u4").tolist()).decode() for v in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
