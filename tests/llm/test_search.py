"""Ranked search against SQL and a plain version, its exact stop, and the bisection."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ranked_search as rs
from tidemark.llm import registry

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs: list[tuple], items: list[tuple], k: int = 50) -> list[tuple]:
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    many, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        score = []
        for d, c, n in held:
            m = 50 + (50 * n * many) // length
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                score.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(score)[:k])]
    return sorted(out, key=repr)


def rows(frame) -> list[tuple]:
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


def test_small_table_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES["op12_ranked_search"](spark, SF)
    want = con.execute(registry.ORACLE["op12_ranked_search"])
    assert got.columns == [d[0] for d in want.description]
    assert rows(got) == sorted(want.fetchall(), key=repr)


AWKWARD = [(None, "shared words of a row without id"), (None, "shared words of a row without id"), (5, "shared words of a row without id"), (5, "shared words of a row without id"), (1, None), (2, ""), (3, " .,;\n"),
           (7, "Ünïcode ünïcode 日本語 日本語 text42 TEXT42"), (8, "a " * 70_000 + "rare"), (9, "rare rare rare"), (10, "RARE, rare-words; a\x00b"), (11, "x" * 200_000)]
ASKED = [(1, "shared WORDS"), (1, "shared WORDS"), (2, None), (3, "...!"), (4, "rare a"), (5, "日本語 ünïcode nowhere"), (None, "text42"), (6, "x" * 200_000), (7, "nothing of the kind")]


@pytest.mark.parametrize("options", [{}, {"page_bytes": 60, "sample": 6}])
def test_awkward_rows(spark, options):
    """Nulls, ties, repeated rows and queries, long texts and clashing columns; small pages, blocks and samples change nothing."""
    docs = AWKWARD + [(100 + i, f"filler text number {i} with a few shared words {i % 7}") for i in range(80)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], f"{DOCS}, cluster int, ids string, slot int").repartition(3)
    index = rs.build_index(frame, **options)
    asked = spark.createDataFrame([(*r, 1) for r in ASKED], f"{ITEMS}, query int")
    for most, k in ((2000, 50), (4, 3)):
        assert rows(rs.search(index, asked, k=k, block_items=most)) == plain_search(docs, ASKED, k)
    assert not rs.search(index, asked.limit(0)).collect()
    assert not rs.search(rs.build_index(frame.limit(0)), asked).collect()
    assert not rs.search(rs.build_index(frame.filter("doc_id = 2")), asked).collect()


def test_stops_exactly(spark):
    """Queries visit fewer clusters than there are, every document is indexed, and lists are those of a full search."""
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"{'abcdefgh'[i % 8]}{j}" for j in rng.zipf(1.4, 40) % 500)) for i in range(1500)]
    items = [(q, " ".join(f"{'abcdefgh'[q % 8]}{j}" for j in rng.integers(0, 500, 6))) for q in range(24)]
    index = rs.build_index(spark.createDataFrame(docs, DOCS), page_bytes=4000)
    assert sorted(x for r in index.pages.select("ids").collect() for x in r["ids"]) == [d for d, _ in docs]
    log: list = []
    assert rows(rs.search(index, spark.createDataFrame(items, ITEMS), k=5, log=log)) == plain_search(docs, items, 5)
    assert sum(log) < 0.5 * len(items) * index.clusters


def test_bisection_brings_like_documents_together():
    """Two mixed kinds of documents are told apart, and unseen ones go where their kind is."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"{'uv'[i % 2]}{j}" for j in rng.integers(0, 60, 30)) for i in range(400)]
    held = np.zeros((400, rs.FEATURES), np.float32)
    owner, hashes, _ = rs.distinct_terms(pa.array(texts, pa.large_string()))
    held[owner, (hashes % np.uint64(rs.FEATURES)).astype(np.int64)] = 1
    weights, cut = rs.bisect(held[:200])
    right = held @ weights > cut
    agree = np.mean(right == (np.arange(400) % 2 == 1))
    assert max(agree, 1 - agree) > 0.95 and abs(right.mean() - 0.5) < 0.05
    tree = rs.fit_tree(held[:200], np.full(200, 100), depth=3)
    leaves = rs.leaf_of(tree, pa.array(texts, pa.large_string()))
    assert set(leaves[::2]) & set(leaves[1::2]) == set() and len(set(leaves.tolist())) == 8
    assert (rs.leaf_of(tree, pa.array(["", ".,"], pa.large_string())) == -1).all()
