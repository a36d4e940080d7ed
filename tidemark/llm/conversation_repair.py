"""Structure repair of conversations: the cheapest edits that make turns alternate, by dynamic programming over tensors.

A repaired conversation's roles read `(s?(ua)+)?` by their first letters: perhaps a system turn, then user and assistant
in turn. Edits are named by their initials: Delete a turn (4, the only edit that blank and repeated turns allow), Insert an
empty user or assistant turn anywhere (3), Keep a turn (0), Rerole it to user or assistant (3). A truncated turn that stays
costs 3 more. Among cheapest edits the list of initials that is least in ASCII wins.

Four states say what was given out last: nothing, system, user, assistant. In each state just one role can be inserted or
taken over (assistant after user, else user), so the initials alone decide the repaired turns. Conversations of a batch are
put into buckets of like length, and each bucket is a tensor whose first axis is time:

1. Backwards over turns, the least cost from each state to a good end is found for all conversations of the bucket at once,
   and kept for every turn.
2. Forwards, all conversations take, step by step, the least initial that stays on a path of that cost.

Only role codes, faults and a 64-bit name of each turn go to Python; texts stay in the JVM, where the edits are applied to
them. A conversation is one row of the result, so its turns meet in one row; memory in Python is bounded by cells of a
bucket (turns times conversations), and one conversation of many turns makes a bucket by itself.

Defined results: null roles and texts count as one space (a blank turn); turns of null number come first, those of one
number follow by role and text; a turn is repeated if one of the same role and text came earlier (as a 64-bit name, so two
different turns are taken for one with probability about 2**-64); rows that don't count still name their conversation; null
conv_id is a conversation; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, at whose end a turn's last sign stands before.
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Role codes: 0 system, 1 user, 2 assistant, 3 any other. States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
#: NEXT[state, role] is the state after a kept turn, or -1; TAKEN[state] the one after an inserted or reroled turn.
NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
TAKEN = np.array([2, 2, 3, 2])
FAR = 1 << 40
#: Cells (turns times conversations) of one tensor.
CELLS = 1 << 19
#: Role pairs that may stand beside each other: su, ua, au.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True

RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, source array<int>, given array<tinyint>"
_ARROW = pa.struct([*((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("source", pa.list_(pa.int32())), ("given", pa.list_(pa.int8()))])


def _closed(cost: np.ndarray) -> np.ndarray:
    """Least costs when turns may be inserted first: a way round leads back to a state after two, so three rounds do."""
    for _ in range(3):
        cost = np.minimum(cost, INSERT + cost[..., TAKEN])
    return cost


#: Cost from each state to a good end after the last turn.
END = _closed(np.array([0, FAR, FAR, 0], np.int64))


def _moves(after: np.ndarray, role: np.ndarray, gone: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs from each state (last axis) of deleting, keeping and reroling a turn, given the costs after it."""
    to = np.moveaxis(NEXT[:, role], 0, -1)
    stay = np.where(gone, FAR, TRUNCATED * cut)[..., None]
    keep = np.where(to < 0, FAR, np.take_along_axis(after, np.maximum(to, 0), -1)) + stay
    return DELETE + after, keep, REROLE + after[..., TAKEN] + stay


def backward(role: np.ndarray, gone: np.ndarray, cut: np.ndarray, size: np.ndarray) -> np.ndarray:
    """costs[turn, conversation, state] to a good end, for turns in [turn, conversation] arrays; past its size a conversation is at its end."""
    turns, many = role.shape
    costs = np.empty((turns + 1, many, 4), np.int64)
    costs[turns] = END
    for t in range(turns - 1, -1, -1):
        best = np.minimum.reduce(_moves(costs[t + 1], role[t], gone[t], cut[t]))
        costs[t] = np.where((t < size)[:, None], _closed(best), END)
    return costs


def trace(costs: np.ndarray, role: np.ndarray, gone: np.ndarray, cut: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """audit (letters as bytes, 0 past the end), source (the turn edited, -1 if inserted) and given (role code, -1: its own), all [step, conversation]."""
    turns, many = role.shape
    at, state, which = np.zeros(many, np.int64), np.zeros(many, np.int64), np.arange(many)
    steps: list[tuple[np.ndarray, ...]] = []
    while True:
        here, inside = np.minimum(at, turns - 1), at < size
        total = costs[at, which, state]
        after = costs[here + 1, which]
        options = [np.where(inside, m[which, state], FAR) for m in _moves(after, role[here, which], gone[here, which], cut[here, which])]
        drop, keep, take = (o == total for o in options)
        more = INSERT + costs[at, which, TAKEN[state]] == total
        letter = np.select([drop, more, keep, take], [ord(c) for c in "DIKR"], 0).astype(np.uint8)
        if not letter.any():
            break
        added = np.isin(letter, [ord("I"), ord("R")])
        steps.append((letter, np.where(letter == ord("I"), -1, at), np.where(added, TAKEN[state] - 1, -1)))
        state = np.where(added, TAKEN[state], np.where(letter == ord("K"), NEXT[state, role[here, which]], state))
        at = at + np.isin(letter, [ord(c) for c in "DKR"])
    if not steps:
        return (np.zeros((0, many), np.uint8), *(np.zeros((0, many), np.int64) for _ in range(2)))
    return tuple(np.stack(x) for x in zip(*steps, strict=True))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = lists.flatten()
    return values.to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))


def repair(roles: pa.Array, faults: pa.Array, names: pa.Array, cells: int = CELLS) -> pa.Array:
    """Counts, cost, audit and edits of each conversation; faults: 1 blank, 2 truncated; names: equal for equal turns."""
    role, ends = _flat(roles)
    fault, name = _flat(faults)[0], _flat(names)[0]
    size = np.diff(ends)
    of = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((np.arange(len(of)), name, of))
    again = np.zeros(len(of), bool)
    if len(of):
        again[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (name[order[1:]] == name[order[:-1]])
    blank = fault == 1
    twice = again & ~blank
    cut = (fault == 2) & ~again
    beside = np.zeros(len(of), bool)
    beside[:-1] = (of[1:] == of[:-1]) & ~_LEGAL[role[:-1], role[1:]]
    counts = [np.bincount(of[x], minlength=len(size)) for x in (blank, twice, cut, beside)]
    cost = np.zeros(len(size), np.int64)
    audit, source, given = (np.empty(len(size), object) for _ in range(3))
    for i in np.flatnonzero(size == 0):
        audit[i], source[i], given[i] = "", [], []
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for b in np.unique(bucket[size > 0]):
        members = np.flatnonzero((bucket == b) & (size > 0))
        step = max(1, cells >> int(b))
        for part in (members[i : i + step] for i in range(0, len(members), step)):
            turns = int(size[part].max())
            held = np.arange(turns)[:, None] < size[part]
            place = np.minimum(ends[part] + np.arange(turns)[:, None], len(of) - 1)
            tensors = [np.where(held, x[place], 0) for x in (role.astype(np.int64), blank | twice, cut)]
            tensors[1:] = [x.astype(bool) for x in tensors[1:]]
            costs = backward(*tensors, size[part])
            cost[part] = costs[0, :, 0]
            letters, turn, to = trace(costs, *tensors, size[part])
            stays = (letters != 0) & (letters != ord("D"))
            for j, i in enumerate(part):
                audit[i] = letters[:, j].tobytes().rstrip(b"\0").decode()
                source[i], given[i] = turn[stays[:, j], j].astype(np.int32), to[stays[:, j], j].astype(np.int8)
    columns = [*(pa.array(c, pa.int64()) for c in (*counts, cost)), pa.array(audit, pa.string()), pa.array(source, pa.list_(pa.int32())), pa.array(given, pa.list_(pa.int8()))]
    return pa.StructArray.from_arrays(columns, fields=list(_ARROW))


def repair_conversations(turns: DataFrame, counts: Column | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text; counts: which rows are turns (all, if not given).

    One row for each conv_id: gaps in its turn numbers, its blank, duplicate, truncated turns (by the first fault of each),
    illegal neighbours, the cost and the audit of the cheapest edits, and the repaired turns (role, text) in order.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(BLANKS))
    initial = F.substring(role, 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).cast("tinyint")
    fault = F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(2).cast("tinyint")
    row = F.struct(F.col("turn"), role.alias("role"), text.alias("text"), code.alias("code"), fault.alias("fault"), F.xxhash64(role, text).alias("name"))
    rows = turns.select("conv_id", F.when(F.lit(True) if counts is None else counts, row).alias("row"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    fixed = F.arrow_udf(lambda a, b, c: repair(a, b, c), RESULT)
    held = held.withColumn("fixed", fixed("rows.code", "rows.fault", "rows.name"))
    numbers = F.filter("rows.turn", lambda n: n.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")
    of = lambda x: F.get("rows", x["source"])
    repaired = F.transform(
        F.arrays_zip(F.col("fixed.source").alias("source"), F.col("fixed.given").alias("given")),
        lambda x: F.struct(
            F.when(x["given"] == 1, "user").when(x["given"] == 2, "assistant").otherwise(of(x)["role"]).alias("role"),
            F.when(x["source"] < 0, "").otherwise(of(x)["text"]).alias("text"),
        ),
    )
    return held.select("conv_id", gaps.alias("gaps"), *(F.col(f"fixed.{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")), repaired.alias("repaired"))
