"""Secret scans: three patterns, and a battery of randomness tests over other long tokens.

A candidate is any long token that no pattern covers, except plain words (letters, lower-case after the first). Each
one gets the smallest alphabet that explains it (hex in small or capital letters, base32, base64) and five statistics against a uniform source over
that alphabet: chi-squared of symbol counts and of classes (upper, lower, digits, others), the balance about the
alphabet's middle, the runs test of classes, and the lag-one serial correlation. Their p-values combine to one score:
how far the token is from being rejected as random. What a score means depends on length and alphabet, so the null is
prose of the band's shortest length over that alphabet: a fixed number of strings drawn from the letter pairs of plain
English (words run together, joined by signs, in camel case, in title case, lower case with numbers between, in
capitals), scored by the same battery. It is the same for every corpus. A candidate's p-value is the largest share that
any of these ways of writing has at its score or above; past the last scores drawn often the share falls on at the rate
at which it fell before, which overstates it. Benjamini and Hochberg's step-up over all candidates of a band bounds the
share of false discoveries.

Candidates are counted over all documents into a table of fixed size, so nothing that grows reaches the driver or a
broadcast.

Defined results: null and empty texts have no spans; spans are code points, end exclusive; repeated rows each get
their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabets by name (fixed values).
ALPHABETS = {"hex": "0123456789abcdef", "capital_hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Lower ends of the length bands, bins of the score, and the share of false discoveries allowed.
BANDS, BINS, RATE = (20, 24, 32, 40, 64, 128), 256, 0.01
_CODES = {n: np.array([a.find(chr(c)) for c in range(128)]) for n, a in ALPHABETS.items()}
_CLASSES = {n: np.array([0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in a]) for n, a in ALPHABETS.items()}
#: Symbols of prose: letters, digits, a gap; and plain English whose pairs make prose.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789 "
ENGLISH = (
    "the old harbour was quiet in the morning and only a few boats had come back from the open sea their crews were tired but glad to be home again on the quay two boys sold bread cheese and fresh apples to anyone who passed by "
    "a clerk from the customs office wrote down what each boat had brought and how much it weighed before the goods could be moved to the large market behind the church people had been waiting there since dawn because prices were lowest when the stalls first opened "
    "later the wind would change and rain was expected so most of them hurried to finish their work quickly by noon the square would be empty except for some dogs and an extra guard who kept just one key to every gate of the town "
)
#: Strings drawn for each way of writing, and how many must reach a score for its share to be counted, not carried on.
DRAWN, OFTEN = 10_000, 50


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the three patterns, each leftmost and non-overlapping, failing matches dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A run is maximal where it is matched, so asking for 16 at once drops just the short ones.
    out += [(2, m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def encoding_of(token: str) -> str:
    body = set(token.rstrip("=").replace("-", "+").replace("_", "/"))
    return next((n for n, a in ALPHABETS.items() if body <= set(a)), "base64")


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _log_tail(z: np.ndarray) -> np.ndarray:
    """Logarithm of the two-sided tail of the standard normal."""
    return np.log(np.maximum(_erfc(np.abs(z) / math.sqrt(2)).astype(float), 1e-300))


def _chi_squared(count: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
    """Logarithm of the upper tail, by the statistic's mean and variance under the multinomial."""
    k = len(share)
    chi = (count * count / share).sum(axis=1) / n - n
    var = 2 * (k - 1) + ((1 / share).sum() - k * k - 2 * k + 2) / n
    return _log_tail(np.maximum(0, (chi - (k - 1)) / math.sqrt(var)))


def _scores(tokens: list[str], encoding: str) -> np.ndarray:
    """The battery over tokens of one alphabet and one length (without padding)."""
    codes, classes = _CODES[encoding], _CLASSES[encoding]
    n, m = len(tokens[0]), len(classes)
    x = codes[np.frombuffer("".join(tokens).encode(), np.uint8)].reshape(len(tokens), n)
    rows = np.arange(len(tokens))[:, None]
    count = np.bincount((rows * m + x).ravel(), minlength=len(tokens) * m).reshape(len(tokens), m)
    own = np.flatnonzero(np.bincount(classes, minlength=4))
    of_class = np.stack([count[:, classes == c].sum(axis=1) for c in own], axis=1)
    # Classes of symbols, and halves of the alphabet, switch often in a random string.
    share = np.bincount(classes, minlength=4)[own] / m
    kind, stay, triple = classes[x], (share**2).sum(), (share**3).sum()
    switches = (kind[:, 1:] != kind[:, :-1]).sum(axis=1)
    var = (n - 1) * stay * (1 - stay) + 2 * (n - 2) * (triple - stay * stay)
    side = 2 * x >= m
    middle = x - (m - 1) / 2
    serial = (middle[:, 1:] * middle[:, :-1]).sum(axis=1) / ((m * m - 1) / 12 * math.sqrt(n - 1))
    logs = (
        _chi_squared(count, np.full(m, 1 / m), n),
        _chi_squared(of_class, share, n),
        _log_tail((side.sum(axis=1) - n / 2) / math.sqrt(n / 4)),
        _log_tail((switches - (n - 1) * (1 - stay)) / math.sqrt(var)),
        _log_tail(serial),
    )
    # Fisher's method: -2 sum log p is chi-squared with 2k degrees of freedom.
    half = -sum(logs)
    term = np.exp(-np.minimum(half, 700))
    total = term.copy()
    for k in range(1, len(logs)):
        term = term * half / k
        total += term
    return np.minimum(1.0, total)


def _body(token: str) -> str:
    return token.rstrip("=").replace("-", "+").replace("_", "/")


def randomness(token: str) -> float:
    """0 to 1: the combined p-value of the battery; small means not random."""
    return float(_scores([_body(token)], encoding_of(token))[0])


def _bins(scores: np.ndarray) -> np.ndarray:
    """Higher bins are more random; log scale down to 1e-64."""
    return np.clip((BINS + 4 * np.log10(np.maximum(scores, 1e-64))).astype(int), 0, BINS - 1)


def _band(length: int) -> int:
    return sum(length >= b for b in BANDS) - 1


def letter_pairs() -> np.ndarray:
    """How often each of SYMBOLS follows each in ENGLISH."""
    k, x = len(SYMBOLS), np.array([SYMBOLS.index(c) for c in ENGLISH])
    # Every pair can occur: a twentieth as if the symbols stood in any order.
    single = np.bincount(x, minlength=k) + 0.1
    return np.bincount(x[:-1] * k + x[1:], minlength=k * k).reshape(k, k) + np.outer(single, single) / single.sum() / 20


@lru_cache(1)
def null_shares() -> np.ndarray:
    """For each alphabet, band and bin: the largest share of prose, over the ways of writing it, that reaches the bin."""
    rng = np.random.default_rng(20240229)
    pairs = letter_pairs()
    pairs[-1, -1] = 0
    until = np.cumsum(pairs / pairs.sum(axis=1, keepdims=True), axis=1)
    at, long = np.full(DRAWN, len(SYMBOLS) - 1), np.empty((DRAWN, 3 * BANDS[-1]), np.int64)
    for j in range(long.shape[1]):
        at = np.minimum((until[at] < rng.random(DRAWN)[:, None]).sum(axis=1), len(SYMBOLS) - 1)
        long[:, j] = at
    prose = ["".join(map(SYMBOLS.__getitem__, row)).strip() for row in long.tolist()]
    # Names in mixed case are made of content words.
    names = [" ".join(w.capitalize() for w in s.split() if len(w) > 2) for s in prose]
    # Every third word or so is followed by a number of one to four digits.
    numbered = [" ".join(w + (f" {v % 10 ** (1 + v % 4)}" if v < 10_000 else "") for w, v in zip(s.split(), rng.integers(0, 30_000, len(s)).tolist(), strict=False)) for s in prose]
    # Few letters of a string are left in capital hex, so several are joined there.
    joined = ["".join(prose[(i + j) % len(prose)] + numbered[(i + j) % len(prose)] for j in range(5)) for i in range(len(prose))]
    written = {
        "capital_hex": [[re.sub("[^A-F0-9]", "", s.upper()) for s in joined], [re.sub("[^A-F]", "", s.upper()) for s in joined]],
        "base32": [[re.sub("[^A-Z2-7]", "", s.upper()) for s in prose]],
        "base64": [[s.replace(" ", sign) for s in way] for way in (prose, names) for sign in ("", "+", "/")] + [[s.replace(" ", sign) for s in numbered] for sign in ("", "+")] + [[s.upper().replace(" ", sign) for s in prose] for sign in ("+", "/")],
    }
    out = np.ones((len(ALPHABETS), len(BANDS), BINS))
    for a, name in enumerate(ALPHABETS):
        for band, length in enumerate(BANDS):
            shares = [_reach(_bins(_scores(cut, name))) for ways in written.get(name, []) if (cut := [s[:length] for s in ways if len(s) >= length])]
            if shares:
                out[a, band] = np.max(shares, axis=0)
    return out


def _reach(bins: np.ndarray) -> np.ndarray:
    """For each bin the share of strings that reach it; past the last bin that many reach, it falls on as it fell over the two decades before."""
    count = np.cumsum(np.bincount(bins, minlength=BINS)[::-1])[::-1]
    share = (count + 1) / (len(bins) + 1)
    last = int(np.flatnonzero(count >= min(OFTEN, len(bins)))[-1])
    if last:
        back = max(0, last - 8)
        fall = min(0.0, math.log(share[last] / share[back]) / (last - back))
        share[last:] = share[last] * np.exp(fall * np.arange(BINS - last))
    return share


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind, start, end) and candidates (start, end, alphabet, band, bin) of each text."""
    schema = "doc_id long, base array<struct<kind:int,start:int,end:int>>, candidates array<struct<start:int,end:int,alphabet:int,band:int,bin:int>>"
    types = {"base": pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "end")])), "candidates": pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "alphabet", "band", "bin")]))}

    names = list(ALPHABETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in types}
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                found = []
                for m in _TOKEN.finditer(text):
                    token = m.group()
                    plain = token[1:].islower() and token.isalpha()
                    if not plain and not any(a < m.end() and m.start() < b for _, a, b in base):
                        at = (names.index(encoding_of(token)), _band(len(_body(token))), int(_bins(np.array([randomness(token)]))[0]))
                        found.append({"start": m.start(), "end": m.end(), "alphabet": at[0], "band": at[1], "bin": at[2]})
                rows["base"].append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                rows["candidates"].append(found)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {c: pa.array(v, types[c]) for c, v in rows.items()})

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cutoffs(scanned: DataFrame, rate: float = RATE) -> dict[tuple[int, int], int]:
    """For each alphabet and band the lowest bin whose candidates are discoveries; those with none are left out."""
    tested = np.zeros((len(ALPHABETS), len(BANDS), BINS), np.int64)
    for r in scanned.select(F.explode("candidates").alias("c")).groupBy("c.alphabet", "c.band", "c.bin").agg(F.count("*").alias("n")).collect():
        tested[r["alphabet"], r["band"], r["bin"]] = r["n"]
    if not tested.any():
        return {}
    share, out = null_shares(), {}
    for band in range(len(BANDS)):
        p, n = share[:, band].ravel(), tested[:, band].ravel()
        order = np.argsort(p, kind="stable")
        passed = np.cumsum(n[order])[np.searchsorted(p[order], p[order], "right") - 1]
        good = p[order][p[order] * n.sum() <= rate * passed]
        for a in range(len(ALPHABETS) if len(good) else 0):
            bins = np.flatnonzero(share[a, band] <= good[-1])
            if len(bins):
                out[a, band] = int(bins[0])
    return out


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and spans: the patterns' spans, and those with the discoveries (kind 3, `random`) by start."""
    scanned = materialise(scan(docs), "secrets")
    cut = cutoffs(scanned, rate)
    keep = lambda x: F.coalesce(*(F.when((x["alphabet"] == a) & (x["band"] == b), x["bin"] >= k) for (a, b), k in cut.items()), F.lit(False)) if cut else F.lit(False)
    extra = F.transform(F.filter("candidates", keep), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    own = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return scanned.select("doc_id", own.alias("base"), F.array_sort(F.concat(own, extra)).alias("spans"))
