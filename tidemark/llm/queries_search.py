"""op12: the best documents for every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ranked_search


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ranked_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH found AS (SELECT doc_id, row_number() OVER () AS place,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT doc_id, place, terms, len(terms) AS n FROM found WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
counts AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM sizes) GROUP BY place, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, whole GROUP BY term, big_n),
asked AS (SELECT DISTINCT item, item_id, term FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
scores AS (SELECT a.item, a.item_id, s.place, s.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked a JOIN weights USING (term) JOIN counts c USING (term) JOIN sizes s ON s.place = c.place, whole GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLE = {"op12_ranked_search": SQL}
