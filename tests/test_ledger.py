"""Day-partitioned commits: what they write, what readers see, and what a crash leaves."""

import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.streaming import ingest

SCHEMA = "app string, day date, campaign string, spend decimal(20,6), clicks long, name string"


def day(n):
    return dt.date(2024, 1, n) if n else None


def table(path, **options):
    return ledger.Ledger(str(path), "day", ("app", "day", "campaign"), ("spend", "clicks"), ("name",), **options)


def frame(spark, *rows):
    return spark.createDataFrame([(a, day(d), c, s if s is None else Decimal(s), k, n) for a, d, c, s, k, n in rows], SCHEMA)


def facts(spark, held):
    rows = ledger.read(spark, held, ledger.version(spark, held)).collect()
    return {(r["app"], r["day"] and r["day"].day, r["campaign"]): (r["spend"] and float(r["spend"]), r["clicks"], r["name"], r["generation"], r["restated_in"]) for r in rows}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_commits_write_only_touched_days(spark, tmp_path):
    held = table(tmp_path)
    ledger.commit(held, frame(spark, *(("x", d, f"c{i}", d * 10, i, "n") for d in range(1, 8) for i in range(4)), ("x", None, "c", 1, 1, "n")), 1)
    before = files(tmp_path)
    ledger.commit(held, frame(spark, ("x", 3, "c0", 30, 0, "renamed"), ("x", 3, "c1", 31, 1, "n"), ("x", 3, None, None, 2, "n"), ("x", 9, "c9", 9, 9, "n")), 2)
    after = files(tmp_path)
    assert {k: after[k] for k in before} == before
    assert {p.split("/")[2] for p in set(after) - set(before) if p.startswith("data")} == {"day=2024-01-03", "day=2024-01-09"}
    got = facts(spark, held)
    assert len(got) == 31 and got["x", 3, "c0"] == (30.0, 0, "renamed", 0, 1) and got["x", 3, "c1"] == (31.0, 1, "n", 1, 2)
    assert got["x", 3, None] == (None, 2, "n", 0, 2) and got["x", 3, "c2"] == (30.0, 2, "n", 0, 1) and got["x", None, "c"][4] == 1
    ledger.commit(held, frame(spark, ("x", 3, None, 0, 2, "n"), ("x", None, "c", 1, 2, "n")), 3)
    got = facts(spark, held)
    assert got["x", 3, None] == (0.0, 2, "n", 1, 3) and got["x", None, "c"] == (1.0, 2, "n", 1, 3)


def test_scope_supersedes_and_empties_days(spark, tmp_path):
    held = table(tmp_path, scope=("app", "day"))
    ledger.commit(held, frame(spark, ("x", 1, "a", 1, 1, ""), ("x", 1, "b", 1, 1, ""), ("y", 1, "a", 1, 1, ""), ("x", 2, "a", 1, 1, "")), 1)
    ledger.commit(held, frame(spark, ("x", 1, "c", 1, 1, "")), 2)
    assert set(facts(spark, held)) == {("x", 1, "c"), ("y", 1, "a"), ("x", 2, "a")}
    ledger.commit(held, frame(spark), 3)
    assert len(facts(spark, held)) == 3 and ledger.version(spark, held).number == 3
    with pytest.raises(ValueError, match="scope"):
        table(tmp_path, scope=("app",))
    with pytest.raises(ValueError, match="other columns"):
        ledger.commit(ledger.Ledger(str(tmp_path), "day", ("app", "day"), ("spend",)), frame(spark), 4)


def test_a_crash_leaves_the_last_version_and_the_number_comes_again(spark, tmp_path, monkeypatch):
    held = table(tmp_path)
    ledger.commit(held, frame(spark, ("x", 1, "a", 1, 1, ""), ("x", 2, "a", 1, 1, "")), 1)
    whole, write = facts(spark, held), type(frame(spark)).coalesce
    monkeypatch.setattr(type(frame(spark)), "coalesce", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        ledger.commit(held, frame(spark, ("x", 1, "a", 5, 5, ""), ("x", 4, "junk", 1, 1, "")), 2)
    monkeypatch.setattr(type(frame(spark)), "coalesce", write)
    assert facts(spark, held) == whole and any("commit=0000000002" in f for f in files(tmp_path))
    again = frame(spark, ("x", 1, "a", 7, 1, ""))
    ledger.commit(held, again, 2)
    ledger.commit(held, frame(spark, ("x", 1, "a", 99, 99, "")), 2)  # the number is taken
    got = facts(spark, held)
    assert got["x", 1, "a"] == (7.0, 1, "", 1, 2) and ("x", 4, "junk") not in got and len(got) == 2
    assert ledger.read(spark, held, ledger.version(spark, held, 1)).count() == 2
    assert ledger.vacuum(spark, held, keep=1) == 2 and facts(spark, held) == got
    assert ledger.version(spark, held, 1) is None and ledger.vacuum(spark, held) == 0


def test_stream_commits_each_batch_once(spark, tmp_path):
    """Files come in batches of one; a run that starts again takes only what is new, and a lost checkpoint repeats nothing."""
    held, source = table(tmp_path / "table"), str(tmp_path / "in")
    run = lambda at: ingest.merge_stream(ingest.read_stream(spark, source, SCHEMA, files_per_batch=1), held, str(tmp_path / at), order="name").awaitTermination()
    frame(spark, ("x", 1, "a", 9, 1, "n1"), ("x", 1, "a", 2, 5, "n2"), ("x", 2, "a", 1, 1, "n1")).coalesce(1).write.parquet(source)
    run("ck")
    frame(spark, ("x", 2, "a", 4, 1, "n3")).coalesce(1).write.mode("append").parquet(source)
    run("ck")
    run("ck")
    want = {("x", 1, "a"): (2.0, 5, "n2", 0, 1), ("x", 2, "a"): (4.0, 1, "n3", 1, 2)}
    assert facts(spark, held) == want and ledger.version(spark, held).number == 2
    run("another")
    assert facts(spark, held) == want


def test_reading_prunes_days(spark, tmp_path):
    held = table(tmp_path)
    ledger.commit(held, frame(spark, *(("x", d, "a", 1, 1, "") for d in range(1, 29))), 1)
    rows = ledger.read(spark, held, ledger.version(spark, held), [day(5)])
    assert len(rows.inputFiles()) == 1 and rows.select(F.max("day")).first()[0] == day(5)
    assert ledger.read(spark, held, None) is None and ledger.read(spark, held, ledger.version(spark, held), []).count() == 0
