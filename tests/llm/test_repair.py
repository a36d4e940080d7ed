"""Conversation repair against a plain search, its SQL, and awkward rows."""

import functools
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as cr
from tidemark.llm import queries_repair, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_repair(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired turns of one conversation's (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = []
    for i, (_, role, text) in enumerate(rows):
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in [r[1:] for r in rows[:i]] else "truncated" if bare[-1] not in ".!?" else "")
    initials = "".join(r[1][:1] or "?" for r in rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i: int, state: str, inserted: int) -> tuple[int, str]:
        """Least cost, then least audit, from the i-th turn on."""
        out = [(0, "")] if i == len(rows) and state in ("", "a") else []
        free = "a" if state == "u" else "u"
        if inserted < 3:
            out.append((3, "I", best(i, free, inserted + 1)))
        if i < len(rows):
            more = 3 * (faults[i] == "truncated")
            out.append((4, "D", best(i + 1, state, 0)))
            if faults[i] not in ("blank", "duplicate"):
                out.append((3 + more, "R", best(i + 1, free, 0)))
                if (state, initials[i]) in step:
                    out.append((more, "K", best(i + 1, step[state, initials[i]], 0)))
        return min((o if len(o) == 2 else (o[0] + o[2][0], o[1] + o[2][1]) for o in out), default=(10**9, ""))

    cost, audit = best(0, "", 0)
    state, i, repaired = "", 0, []
    for letter in audit:
        if letter in "IR":
            state = "a" if state == "u" else "u"
            repaired.append(("assistant" if state == "a" else "user", "" if letter == "I" else rows[i][2]))
        elif letter == "K":
            state = step[state, initials[i]]
            repaired.append(rows[i][1:])
        i += letter != "I"
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, repaired)


def plain_damage(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def facts(rows) -> dict:
    return {r["conv_id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), [tuple(x) for x in r["repaired"]]) for r in rows}


def random_turns(seed: int, many: int, most: int) -> list[tuple]:
    rng, out = np.random.default_rng(seed), []
    for conv in range(many):
        for turn in range(int(rng.integers(1, most))):
            role = rng.choice(["user", "assistant", "system", "tool", "", "unknown"], p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05])
            text = rng.choice(["", " \t\n", "Yes.", "No", "Why? ", "One two three", f"It is {turn}.", f"cut {turn}"])
            out.append((conv, None if rng.random() < 0.05 else int(turn // rng.integers(1, 3)), str(role), str(text)))
    return out


def test_cheapest_edits_against_a_plain_search(spark):
    rows = random_turns(1, 300, 12) + [(900, t, "user", "same.") for t in range(5)] + [(901, 0, "system", "Only this.")]
    by: dict = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    got = facts(cr.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == {conv: plain_repair(r) for conv, r in by.items()}


def test_buckets_change_nothing():
    """Tensors of one conversation each and of many give the same; so do long conversations beside short ones."""
    rng, lists = np.random.default_rng(2), []
    for size in (0, 1, 1, 2, 3, 5, 8, 30, 31, 700, 0):
        lists.append((rng.integers(0, 4, size), rng.integers(0, 3, size), rng.integers(0, size // 2 + 1, size)))
    columns = [pa.array([x[i].tolist() for x in lists], pa.list_(t)) for i, t in enumerate((pa.int8(), pa.int8(), pa.int64()))]
    assert cr.repair(*columns).equals(cr.repair(*columns, cells=1))
    assert cr.repair(*(pa.array([], pa.list_(pa.int8())) for _ in range(3))).to_pylist() == []


@pytest.mark.parametrize("at", ["small", "awkward"])
def test_query_against_sql_and_a_plain_version(spark, tmp_path, at):
    folder = SF
    if at == "awkward":
        folder = str(tmp_path)
        rows = random_turns(3, 200, 14) + [(None, None, None, None), (None, 3, "user", "Hello."), (None, None, "assistant", None), (7000, 1, "user", "x" * 100_000 + "."), (7000, 1, "user", "x" * 100_000 + ".")]
        rows += [(8000, t, "user" if t % 2 else "assistant", f"Long talk {t}.") for t in range(1500)]
        wide = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{SCHEMA}, rows int, fixed string, kept int")
        wide.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    read = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = registry.QUERIES["op11_conversation_repair"](spark, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{'/*.parquet' if at == 'awkward' else ''}'")
    want = con.execute(registry.ORACLE["op11_conversation_repair"])
    names = [d[0] for d in want.description]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(want.fetchall(), key=repr)
    plain = {c: plain_repair(r) for c, r in plain_damage([tuple(r) for r in read.collect()]).items() if len(r) < 500}
    digest = lambda turns: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
    found = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}
    assert {c: found[c] for c in plain} == {c: (*p[:-1], digest(p[-1])) for c, p in plain.items()}


def test_conversations_without_turns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], SCHEMA)
    none = facts(cr.repair_conversations(rows, F.lit(False)).collect())
    assert none == {1: (0, 0, 0, 0, 0, 0, "", [])}
    assert facts(cr.repair_conversations(rows).collect()) == {1: (0, 0, 0, 0, 0, 0, "KK", [("user", "Hi."), ("assistant", "Ho.")])}
    assert not cr.repair_conversations(rows.limit(0)).collect()
    assert set(queries_repair.damaged(rows).columns) == {"conv_id", "turn", "role", "text", "kept", "copy"}
