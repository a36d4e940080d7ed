"""Chains of stored pages, and the paged data source in batch and as a stream that starts again."""

import json

import pytest

from tidemark.sources import paged
from tidemark.sources.paged import PagedSource

SCHEMA = "campaign_id string, spend string"


def chain(spark, links, starts, cap):
    pages = spark.createDataFrame(links, "cursor string, next string")
    got = paged.follow(pages, spark.createDataFrame(starts, "feed string, cursor string"), cap).collect()
    out: dict = {}
    for r in got:
        out.setdefault((r["feed"], r["failure"]), []).append((r["number"], r["cursor"]))
    return {k: [c for _, c in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("cap", [1, 4, 7, 200])
def test_chains_against_following_them(spark, cap):
    links = [(f"a{i}", f"a{i + 1}") for i in range(6)] + [("a6", None), ("loop1", "loop2"), ("loop2", "loop1"), ("lost", "nowhere"), ("same", None), ("same", None), ("alone", None)]
    starts = [("whole", "a0"), ("late", "a3"), ("loop", "loop1"), ("cut", "lost"), ("twice", "same"), ("none", "gone"), ("one", "alone")]
    follow, want = dict(links), {}
    for feed, at in starts:
        seen = []
        while at in follow and len(seen) <= cap:
            seen.append(at)
            at = follow[at]
        if seen:
            want[feed, "pagination_failure" if len(seen) > cap else None] = seen[:cap]
    assert chain(spark, links, starts, cap) == want


def write(folder, number, rows):
    (folder / f"page-{number:05d}.json").write_text(json.dumps({"data": rows, "paging": {}}))


def test_batch_and_stream_with_restart(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    folder = tmp_path / "pages"
    folder.mkdir()
    for n in range(3):
        write(folder, n, [{"campaign_id": f"c{n}", "spend": n + 0.5, "other": 1}, {"campaign_id": None}] if n != 1 else [])
    read = spark.read.format("paged").schema(SCHEMA).load(str(folder))
    assert read.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, read.collect()), key=repr) == sorted([("c0", "0.5"), (None, None), ("c2", "2.5"), (None, None)], key=repr)
    with pytest.raises(Exception, match="pagination_failure"):
        spark.read.format("paged").schema(SCHEMA).option("maxPages", 2).load(str(folder)).collect()

    def run():
        stream = spark.readStream.format("paged").schema(SCHEMA).load(str(folder)).filter("campaign_id IS NOT NULL")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["campaign_id"] for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert run() == ["c0", "c2"]
    write(folder, 3, [{"campaign_id": "c3", "spend": {"value": 1}}])
    assert run() == ["c0", "c2", "c3"] and run() == ["c0", "c2", "c3"]
    assert spark.read.format("paged").schema(SCHEMA).load(str(tmp_path / "empty")).count() == 0
