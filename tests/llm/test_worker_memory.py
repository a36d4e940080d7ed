"""What the pipeline's maps hold in Python workers, which all stages share."""

import tracemalloc

import pyarrow as pa
import public_tokenizers
from pyspark import SparkContext

from tidemark.llm import bpe, decontamination, quality

SF = "/root/testdata/sf0.001"


def texts(n, size):
    return pa.array([" ".join(f"w{(i * 7919 + j * 31) % 5003}" for j in range(size)) for i in range(n)], pa.string())


def test_content_features_need_little_beside_their_rows():
    """Arrays over the words of a whole MB of text took 30 MB."""
    part = texts(600, 500)
    quality.content_features(part.slice(0, 2))
    tracemalloc.start()
    out = quality.content_features(part)
    peak = tracemalloc.get_traced_memory()[1] - out.nbytes
    tracemalloc.stop()
    assert peak < 25e6


def test_content_features_by_piece_are_those_of_all():
    part = texts(40, 900)
    one_by_one = [quality.content_features(part.slice(i, 1))[0] for i in range(len(part))]
    assert (quality.content_features(part) == one_by_one).all()


def test_fit_starts_no_other_python_workers(spark, monkeypatch):
    """Rows handed over as a list became an RDD of Python's own, with a daemon and workers beside the maps'."""

    def refuse(*args, **kw):
        raise AssertionError("rows became an RDD")

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    taken = []
    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    monkeypatch.setattr(quality.CoTrained, "take", lambda self, view, x, guess, f=quality.CoTrained.take: (taken.append(len(x)), f(self, view, x, guess))[1])
    quality.fit(docs, labels)
    assert sum(taken) > 0


def test_memos_end_with_the_task(spark):
    """In the map's own worker: a later task finds nothing remembered; rows of several pieces keep their order and ids."""
    path, n = public_tokenizers.path("byte_bpe_50k.tiktoken"), 2500
    docs = spark.createDataFrame(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array([f"unseen{i}word {i * i}" for i in range(n)])})).coalesce(1)
    back = bpe.decode_documents(bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in docs.collect()]

    def held(batches):
        for _ in batches:
            coder = bpe.vocabulary(path, public_tokenizers.PATTERN)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(coder._memo) + len(coder._pairs) + len(coder._merged)], pa.int64())})

    assert [r["n"] for r in spark.range(1).coalesce(1).mapInArrow(held, "n long").collect()] == [0]
    coder = bpe.ByteBpe(path, public_tokenizers.PATTERN)
    first = coder.encode("unseen0word and more")
    assert coder._memo
    coder.forget()
    assert not (coder._memo or coder._pairs or coder._merged) and coder.encode("unseen0word and more") == first


def test_decontamination_of_several_pieces(spark):
    n = 2500
    items = spark.createDataFrame(pa.table({"item_id": pa.array([1], pa.int64()), "text": ["the quick brown fox jumps over the lazy dog and runs away"]}))
    held = {0, 999, 1000, 1001, 1999, 2000, 2499}
    rows = ["so the quick brown fox jumps over the lazy dog and runs away today" if i in held else f"plain text {i}" for i in range(n)]
    docs = spark.createDataFrame(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": rows})).coalesce(1)
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()] == [i for i in range(n) if i not in held]
