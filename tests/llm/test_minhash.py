"""Circulant MinHash against all pairs, on given, awkward and crowded documents."""

import numpy as np
import pytest

import brute
from tidemark.llm import minhash, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def found(rows) -> dict:
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_small_table_against_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op13_minhash_dedup"](spark, SF).collect()
    want = brute.linked(texts, 85, 3)
    assert found(got) == {d: v[:2] for d, v in want.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and any(not r["kept"] for r in got)


def crowd() -> list[tuple]:
    """Near copies above and below the threshold, a passage that half of the rows share, copies of a third of all rows."""
    rng, rows = np.random.default_rng(4), []
    base, passage = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    for i in range(120):
        words = list(base)
        for j in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            words[j] = f"edit{i}_{j}" if rng.random() < 0.7 else f"common{j}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join([f"own{i}_{j}" for j in range(60)] + passage)) for i in range(120)]
    rows += [(400 + i, "the same text in all of these rows, word for word. " * 3) for i in range(150)]
    return rows


@pytest.mark.parametrize(("percent", "width"), [(85, 3), (80, 5), (60, 2)])
def test_crowded_pages_against_all_pairs(spark, percent, width):
    rows = crowd()
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(7), percent, width, page_tokens=500).collect()
    assert found(got) == {d: v[:2] for d, v in brute.linked(dict(rows), percent, width).items()}


def test_awkward_rows(spark):
    long = "word " * 30_000 + " ".join(f"v{i}" for i in range(20_000))
    rows = [(None, "one two three four"), (3, "ONE two three\tfour"), (1, None), (1, ""), (2, " \n"), (4, "one two"), (5, "One two"), (6, "two one"), (7, long), (8, long + " end"), (8, long + " end"), (9, "日本語 テキスト")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{SCHEMA}, page int, node string, first int")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=repr)
    n = len(brute.shingles(long, 3))
    want = [(0, 2, 3, False), (3, 2, 3, True), (1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, n, 7, True), (8, n + 1, 7, False), (8, n + 1, 7, False), (9, 1, 9, True)]
    assert got == sorted(want, key=repr)
    left = minhash.keep_first(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in left.collect()) == [(1, ""), (1, ""), (2, " \n"), (3, "ONE two t"), (4, "one two"), (6, "two one"), (7, "word word"), (9, "日本語 テキスト")]
    assert not minhash.near_duplicates(docs.limit(0)).collect() and not minhash.keep_first(docs.limit(0)).collect()
    alone = minhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c")], SCHEMA)).collect()
    assert [(r["component_id"], r["kept"]) for r in alone] == [(None, True)] * 2


def test_coordinates_agree_as_often_as_sets_overlap():
    """Each coordinate of two signatures is equal with probability J, small sets and large, and pi is a permutation."""
    rng = np.random.default_rng(8)
    for size, shared in ((12, 11), (40, 37), (2000, 1200)):
        agree = []
        for _ in range(200):
            common, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (shared, size - shared, size - shared))
            sets = np.concatenate([common, a, common, b])
            sig = minhash.signatures(sets, np.array([size, size]), 160)
            agree.append((sig[:, 0] == sig[:, 1]).mean())
        want = shared / (2 * size - shared)
        assert abs(np.mean(agree) - want) < 4 * np.sqrt(want * (1 - want) / 200 / min(160, shared)) + 0.003
    x = np.arange(2**20, dtype=np.uint64) << np.uint64(12)
    assert len(np.unique(minhash.signatures(x, np.ones(len(x), np.int64), 1))) == len(np.unique((minhash.mix(x ^ minhash._SIGMA) >> np.uint64(32)).astype(np.uint32)))


def test_links_at_the_threshold_share_tokens():
    """Of pairs just at the threshold all share a token in both halves, and rows follow the threshold."""
    assert [minhash.rows_of(p) for p in (80, 85, 90, 95)] == [4, 5, 8, 18]
    rng, rows = np.random.default_rng(9), minhash.rows_of(85)
    for size in (13, 25, 100):
        shared = -(-170 * size // 185)
        for _ in range(150):
            common, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (shared, size - shared, size - shared))
            sig = minhash.signatures(np.concatenate([common, a, common, b]), np.array([size, size]), 64 * rows)
            for half in np.split(sig, 2):
                tokens = minhash.band_tokens(half, rows)
                assert (tokens[:, 0] == tokens[:, 1]).any()


