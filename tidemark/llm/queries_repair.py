"""op11: conversations damaged by rule, then repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as cr


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, kept: a twentieth of the rows each dropped (not kept), emptied, stripped of its sentence
    ends, repeated, or given to the user; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    twice = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("kept"), F.explode(twice).alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = cr.repair_conversations(damaged(rows), F.col("kept"))
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))


#: The checksum from its polynomial, then a forward search over states that keeps the least (cost, audit) of each.
SQL = r"""
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS key
  FROM conversations),
kinds AS (SELECT conv_id, turn, role, text,
    xor(list_reduce(key, lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INTEGER) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM raw, bits),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, kind FROM kinds WHERE kind <> 0),
turns AS (SELECT conv_id, turn, role, text FROM hurt UNION ALL SELECT conv_id, turn, role, text FROM hurt WHERE kind = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial FROM turns),
judged AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS twice,
    lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM placed),
faulty AS (SELECT *, blank OR twice AS gone, NOT blank AND NOT twice AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM judged),
ids AS (SELECT DISTINCT conv_id FROM conversations),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (twice) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
added AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'),
    (0, 3, 6, 'II'), (1, 3, 6, 'II'), (2, 2, 6, 'II'), (3, 3, 6, 'II')) AS v(before, state, price, letters)),
edits AS (SELECT * FROM (VALUES ('K', 0, 's', 1), ('K', 0, 'u', 2), ('K', 1, 'u', 2), ('K', 2, 'a', 3), ('K', 3, 'u', 2), ('D', 0, NULL, 0), ('D', 1, NULL, 1),
    ('D', 2, NULL, 2), ('D', 3, NULL, 3), ('R', 0, NULL, 2), ('R', 1, NULL, 2), ('R', 2, NULL, 3), ('R', 3, NULL, 2)) AS v(letter, before, initial, middle)),
search AS (
  SELECT i.conv_id, CAST(0 AS BIGINT) AS pos, a.state, {'cost': a.price, 'audit': a.letters} AS best FROM ids i, added a WHERE a.before = 0
  UNION ALL
  SELECT s.conv_id, r.pos, a.state, min({'cost': s.best.cost + a.price + CASE WHEN e.letter = 'D' THEN 4 ELSE (e.letter = 'R')::INT * 3 + r.cut::INT * 3 END, 'audit': s.best.audit || e.letter || a.letters})
  FROM search s
  JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos + 1
  JOIN edits e ON e.before = s.state AND (e.initial IS NULL OR e.initial = r.initial) AND (e.letter = 'D' OR NOT r.gone)
  JOIN added a ON a.before = e.middle
  GROUP BY s.conv_id, r.pos, a.state),
chosen AS (SELECT s.conv_id, min(s.best) AS best FROM search s LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE s.state IN (0, 3) AND s.pos = coalesce(f.n, 0) GROUP BY s.conv_id),
letters AS (SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS j, best.audit AS audit FROM chosen),
steps AS (SELECT conv_id, j, audit[j] AS letter, sum((audit[j] <> 'I')::INT) OVER w AS pos, sum((audit[j] <> 'D')::INT) OVER w AS given FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
kept AS (SELECT s.*, r.role, r.text FROM steps s LEFT JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos WHERE s.letter <> 'D'),
shifted AS (SELECT *, given + max((given = 1 AND letter = 'K' AND left(role, 1) = 's')::INT) OVER (PARTITION BY conv_id) AS nth FROM kept),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM shifted GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
  coalesce(f.illegal, 0) AS illegal, CAST(c.best.cost AS BIGINT) AS cost, c.best.audit AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM chosen c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLE = {"op11_conversation_repair": SQL}
