"""The stages one by one, each on its own input, against plain versions."""

import base64
import re

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, as lists of rows."""
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), [spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        out.append(docs.collect())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] or "" for r in rows}


def test_near_copies(kept):
    groups = brute.linked(texts(kept[1]), 80, 5)
    assert set(texts(kept[2])) == {d for d, (n, c, _) in groups.items() if c == d or n == 0}


def test_poor_documents_go(spark, kept):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = set(texts(kept[1]))
    good = [d for d, q in labels.items() if q == 1]
    assert np.mean([d in left for d in good]) > 0.95 and len(left) < len(kept[0])


def test_leaks_go(spark, kept):
    bare = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())
    items = [bare(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, t in texts(kept[2]).items() if any(f" {i} " in f" {bare(t)} " for i in items)}
    gone = set(texts(kept[2])) - set(texts(kept[3]))
    assert held <= gone and len(gone - held) <= 2


def test_personal_data_goes(kept):
    before, after = texts(kept[3]), texts(kept[4])
    assert set(before) == set(after)
    for d, t in before.items():
        assert not re.search(brute.PII["email"], after[d])
        if not any(brute.spans(brute.PII, t)[0]):
            assert after[d] == t


def test_tokens(kept):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = texts(kept[4])
    assert {r["doc_id"]: list(np.frombuffer(r["ids"], "<u4")) for r in kept[5]} == {d: library.encode_ordinary(t) for d, t in want.items()}
    assert all(r["exact"] for r in kept[5])


LONG = "word " * 30_000 + "x" * 20_000
AWKWARD = [
    (1, None), (1, None), (2, ""), (3, " \t\n"), (None, "mail a.b@c.de to the office at noon today please"), (None, "mail a.b@c.de to the office at noon today please"), (None, "another text of no id that is long enough to be one"),
    (7, LONG), (8, LONG), (9, "the same id has two texts and this is the first of them"), (9, "the same id has two texts but that is quite another text"), (10, "the quick brown fox jumps over the lazy dog and runs away from the bear"), (11, "日本語 text"),
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder of awkward documents with columns whose names clash with the stages' own, and an empty one."""
    top = tmp_path_factory.mktemp("awkward-stages")
    extra = "row int, row_ string, key int, spans string, block int, page long, label double, content string, text_ string"
    names = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "r", 2, "s", 3, 4, 0.5, "c", "t") for d, t in AWKWARD], names)
    for folder, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(f"{top}/{folder}/documents.parquet")
        spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away")], "item_id long, text string").write.parquet(f"{top}/{folder}/benchmark.parquet")
        spark.createDataFrame([(7, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/{folder}/labels.parquet")
    return str(top)


@pytest.mark.parametrize("folder", ["some", "none"])
def test_stages_on_awkward_rows(spark, awkward, folder):
    """Each stage on all the awkward rows: what it defines for nulls, blanks, repeats, long texts and clashing names."""
    docs = spark.read.parquet(f"{awkward}/{folder}/documents.parquet")
    got = {name: stage(spark, docs, f"{awkward}/{folder}").collect() for name, stage in corpus_pipeline.STAGES}
    if folder == "none":
        assert not any(got.values())
        return
    for name, rows in got.items():
        if name != "tokens":
            assert all(r.__fields__ == docs.columns and (r["row"], r["key"], r["spans"], r["text_"]) == (1, 2, "s", "t") for r in rows)
    pairs = lambda name: sorted(((r["doc_id"], r["text"]) for r in got[name]), key=repr)
    every = sorted(AWKWARD, key=repr)
    assert pairs("quality") == every
    once = list(AWKWARD)
    once.remove((8, LONG))
    once.remove(AWKWARD[4])
    assert pairs("near_copies") == sorted(once, key=repr)
    assert pairs("decontamination") == [x for x in every if x[0] != 10]
    assert pairs("personal") == sorted(((d, t and t.replace("a.b@c.de", "[EMAIL]")) for d, t in AWKWARD), key=repr)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got["personal"])
    assert sorted(r["n_tokens"] for r in got["tokens"])[:3] == [0, 0, 0] and len(got["tokens"]) == len(AWKWARD) and all(r["exact"] for r in got["tokens"])


def test_run_deletes_what_it_passed_through(spark, awkward):
    """The whole pipeline: its rows, and in the shared folder only the last stage's input."""
    from tidemark.llm import common

    before = common.made()
    rows = corpus_pipeline.run(spark, f"{awkward}/some").collect()
    assert len(rows) == len(AWKWARD) - 3 and common.made() - before == 1
    assert not corpus_pipeline.run(spark, f"{awkward}/none").collect()
