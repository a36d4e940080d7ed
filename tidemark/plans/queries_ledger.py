"""Restated facts in day-partitioned tables: by a stream of late reports, and for each type of fact; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals, ledger
from tidemark.plans.bridge import shared_root, view, with_views
from tidemark.sources import paged
from tidemark.streaming import ingest

QUERIES: dict = {}
ORACLE: dict = {}

#: Reports come in so many deliveries, each the totals so far of the rows that changed since the one before.
ARRIVALS = 4
_REPORTS = f"""SELECT CAST(ts AS DATE) AS report_date, 'c' || CAST(user_id % 12 AS STRING) AS campaign, event_type,
CAST(event_id % {ARRIVALS} AS INT) AS arrival, count(*) AS events, sum(CAST(value AS DECIMAL(20,6))) AS value FROM {{events}} GROUP BY 1, 2, 3, 4"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_REPORTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    so_far = "OVER (PARTITION BY report_date, campaign, event_type ORDER BY arrival)"
    return rows.select("report_date", "campaign", "event_type", "arrival", F.expr(f"sum(events) {so_far}").alias("events"), F.expr(f"CAST(sum(value) {so_far} AS DECIMAL(20,6))").alias("value"))


def streamed_restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four deliveries of daily reports, late ones among them, each taken by a run of the stream from the same checkpoint:
    the table after the last, with how often and when each row was restated."""
    root = f"{shared_root(spark)}/streams/{uuid.uuid4().hex}"
    table = ledger.Ledger(f"{root}/table", "report_date", ("report_date", "campaign", "event_type"), ("events", "value"))
    rows = _reports(spark, sf_dir)
    rows.write.partitionBy("arrival").parquet(f"{root}/reports")
    schema = "report_date date, campaign string, event_type string, events long, value decimal(20,6)"
    for arrival in range(ARRIVALS):
        delivery = spark.read.parquet(f"{root}/reports").filter(F.col("arrival") == arrival).drop("arrival")
        delivery.write.mode("append").parquet(f"{root}/landed")
        stream = ingest.read_stream(spark, f"{root}/landed", schema, files_per_batch=1_000_000)
        ingest.merge_stream(stream, table, f"{root}/checkpoint").awaitTermination()
    after = ledger.read(spark, table, ledger.version(spark, table))
    if after is None:
        return spark.createDataFrame([], f"{schema}, generation int, restated_in long")
    return after.withColumn("value", F.col("value").cast("double"))


QUERIES["streamed_restatements"] = streamed_restatements
ORACLE["streamed_restatements"] = f"""SELECT CAST(ts AS DATE) AS report_date, 'c' || CAST(user_id % 12 AS STRING) AS campaign, event_type, count(*) AS events,
CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS value, CAST(count(DISTINCT event_id % {ARRIVALS}) - 1 AS INTEGER) AS generation,
CAST(max(event_id % {ARRIVALS}) + 1 AS BIGINT) AS restated_in FROM events GROUP BY 1, 2, 3"""

#: The attribution facts: view, day, keys, measure, and what the second write changes and leaves out.
_FACTS = (
    ("installs", "install_date", ("install_date", "campaign", "country", "platform", "media_source"), "installs", "campaign = 'a3'", "campaign = 'a5' AND country = 'DE'"),
    ("revenue", "event_date", ("event_date", "campaign", "country", "platform", "media_source", "revenue_type", "currency"), "revenue", "revenue_type = 'iap'", "campaign = 'a2' AND platform = 'ios'"),
    ("event_counts", "event_date", ("event_date", "campaign", "event_type"), "events", "event_type = 'view'", "campaign = 'c7' AND event_type = 'click'"),
)
_EVENTS = "SELECT CAST(ts AS DATE) AS event_date, 'c' || CAST(user_id % 12 AS STRING) AS campaign, event_type, count(*) AS events FROM {events} GROUP BY 1, 2, 3"


def _fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet")) if name == "event_counts" else view(spark, sf_dir, name)


def restated_fact_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installs, revenue and event counts, each written twice: a third of the days come again, some rows changed and some
    left out. Rows, sum, restated rows and rows of the second write, by fact and day."""
    out = None
    for name, day, keys, measure, changed, left_out in _FACTS:
        root = f"{shared_root(spark)}/facts/{uuid.uuid4().hex}"
        table = ledger.Ledger(root, day, keys, (measure,), scope=(day, "campaign"))
        facts = _fact(spark, sf_dir, name)
        again = facts.filter(f"day({day}) % 3 = 0 AND NOT ({left_out})").withColumn(measure, F.expr(f"CAST({measure} + CASE WHEN {changed} THEN 1 ELSE 0 END AS {facts.schema[measure].dataType.simpleString()})"))
        ledger.commit(table, facts, 1)
        rows = ledger.read(spark, table, ledger.commit(table, again, 2))
        totals = rows.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"), F.sum(measure).cast("double").alias("total"), F.sum("generation").alias("restated"), F.count_if(F.col("restated_in") == 2).alias("second"))
        one = totals.select(F.lit(name).alias("fact"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _fact_sql(name: str, day: str, keys: tuple, measure: str, changed: str, left_out: str) -> str:
    """What a write leaves: a campaign's day that is written keeps only what is written."""
    source = f"({_EVENTS.format(events='events')})" if name == "event_counts" else name
    gone = f"day({day}) % 3 = 0 AND {left_out} AND EXISTS (SELECT 1 FROM {source} o WHERE o.{day} = f.{day} AND o.campaign = f.campaign AND NOT ({left_out.replace('campaign', 'o.campaign').replace('country', 'o.country').replace('platform', 'o.platform').replace('event_type', 'o.event_type')}))"
    hit = f"(day({day}) % 3 = 0 AND {changed} AND NOT ({left_out}))"
    return f"""SELECT '{name}' AS fact, {day} AS day, count(*) AS n, CAST(sum({measure}) + count(*) FILTER ({hit}) AS DOUBLE) AS total,
count(*) FILTER ({hit}) AS restated, count(*) FILTER ({hit}) AS second FROM {source} f WHERE NOT ({gone}) GROUP BY 2"""


QUERIES["restated_fact_types"] = restated_fact_types
ORACLE["restated_fact_types"] = with_views("\nUNION ALL ".join(_fact_sql(*f) for f in _FACTS), "installs", "revenue")


def spend_in_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of each supplier's days that lie in a window of its customers' nation; some windows have open ends. Points and
    windows meet by blocks, not by comparing ranges."""
    days = view(spark, sf_dir, "big_delivery").select("account", "report_date", "campaign", "spend")
    windows = spark.sql(_WINDOWS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    met = intervals.pairs(days, windows, "report_date", "opens", "closes", ("account",))
    return met.groupBy("account", "label").agg(F.count("*").alias("n"), F.countDistinct("report_date").alias("days"), F.sum("spend").cast("double").alias("spend"))


_WINDOWS = """SELECT c_nationkey AS account, label, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE opens END AS opens, CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE closes END AS closes
FROM (SELECT c_nationkey, c_mktsegment AS label, CAST(min(o_orderdate) AS DATE) + CAST(length(c_mktsegment) * 7 AS INT) AS opens, CAST(max(o_orderdate) AS DATE) - CAST(length(c_mktsegment) * 11 AS INT) AS closes
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2) w"""
QUERIES["spend_in_open_windows"] = spend_in_open_windows
ORACLE["spend_in_open_windows"] = with_views(f"""SELECT d.account, label, count(*) AS n, count(DISTINCT report_date) AS days, CAST(sum(spend) AS DOUBLE) AS spend FROM big_delivery d
JOIN ({_WINDOWS.format(orders="orders", customer="customer")}) w ON w.account = d.account AND report_date >= coalesce(opens, report_date) AND report_date <= coalesce(closes, report_date) GROUP BY 1, 2""", "big_delivery")


def paged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports stored as pages of JSON that name their next page: a feed for each user group, two of them with broken chains.
    Rows and spend of every feed by its outcome; rows of a feed that goes past the cap are not taken."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("CAST(user_id % 8 AS INT) AS feed"), F.expr("CAST(event_id % 12 AS INT) AS page"), F.expr("CAST(value AS DECIMAL(20,6)) AS value"))
    root = f"{shared_root(spark)}/pages/{uuid.uuid4().hex}"
    body = F.to_json(F.struct(F.concat_ws("-", "feed", "page").alias("cursor"), F.collect_list(F.struct("value")).alias("data"), F.expr(_NEXT).alias("next")))
    events.groupBy("feed", "page").agg(body.alias("body")).select("body").write.text(root)
    schema = "cursor string, next string, data array<struct<value:decimal(20,6)>>"
    pages = spark.read.schema(schema).json(root)
    starts = events.select(F.col("feed").cast("string").alias("feed")).distinct().withColumn("cursor", F.concat("feed", F.lit("-0")))
    chains = paged.follow(pages.select("cursor", "next"), starts, cap=10)
    rows = chains.join(pages.drop("next"), "cursor").withColumn("taken", F.col("failure").isNull())
    return rows.groupBy("feed").agg(
        F.max("failure").alias("failure"), F.count("*").alias("pages"), F.coalesce(F.sum(F.when(F.col("taken"), F.size("data"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("taken"), F.aggregate("data", F.lit(0).cast("decimal(30,6)"), lambda a, x: (a + x["value"]).cast("decimal(30,6)")))), F.lit(0)).cast("double").alias("value"),
    )


#: The page after a page: feed 0 has all twelve in a row, feed 1 goes round, the others end after three to eight pages.
_NEXT = """CASE WHEN feed = 0 AND page < 11 THEN '0-' || CAST(page + 1 AS STRING) WHEN feed = 1 THEN '1-' || CAST((page + 1) % 3 AS STRING)
WHEN feed > 1 AND page < feed THEN CAST(feed AS STRING) || '-' || CAST(page + 1 AS STRING) END"""
QUERIES["paged_reports"] = paged_reports
ORACLE["paged_reports"] = """WITH RECURSIVE stored AS (SELECT CAST(user_id % 8 AS INTEGER) AS feed, CAST(event_id % 12 AS INTEGER) AS page, count(*) AS n, sum(CAST(value AS DECIMAL(20,6))) AS value FROM events GROUP BY 1, 2),
chain AS (SELECT feed, page, 1 AS number FROM stored WHERE page = 0 UNION ALL SELECT s.feed, s.page, number + 1 FROM chain c JOIN stored s ON s.feed = c.feed AND number <= 10
  AND s.page = CASE WHEN c.feed = 0 THEN CASE WHEN c.page < 11 THEN c.page + 1 END WHEN c.feed = 1 THEN (c.page + 1) % 3 WHEN c.page < c.feed THEN c.page + 1 END),
long AS (SELECT feed, max(number) > 10 AS failed FROM chain GROUP BY 1)
SELECT CAST(c.feed AS VARCHAR) AS feed, max(CASE WHEN failed THEN 'pagination_failure' END) AS failure, count(*) AS pages, CAST(coalesce(sum(n) FILTER (NOT failed), 0) AS BIGINT) AS n,
CAST(coalesce(sum(value) FILTER (NOT failed), 0) AS DOUBLE) AS value FROM chain c JOIN long USING (feed) JOIN stored s ON s.feed = c.feed AND s.page = c.page WHERE number <= 10 GROUP BY 1"""
