"""CSV reports, JSON insights and a watermarked stream read back from files that Spark writes from the driver's tables, and
facts under filters; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import aggregates, populations
from tidemark.plans.bridge import shared_root, view, with_views
from tidemark.sources import files
from tidemark.streaming import ingest

QUERIES: dict = {}
ORACLE: dict = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def csv_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as CSV with odd headers, names that hold quotes, commas and line breaks, and numbers with separators."""
    root = f"{shared_root(spark)}/csv/{uuid.uuid4().hex}"
    rows = _events(spark, sf_dir).select(
        F.expr("CAST(CAST(ts AS DATE) AS STRING)").alias("Report Date"),
        F.expr("'Say \"' || CAST(user_id % 12 AS STRING) || '\", again\nand again'").alias("Campaign (Name)"),
        F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.format_number(F.floor("value") * 1000, 0)).alias("Cost / USD"),
        F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_type")).alias("Type"),
    )
    rows.write.csv(root, header=True, quoteAll=True, quote='"', escape='"')
    read = files.read_csv(spark, root)
    campaign, cost = F.regexp_extract("campaign_name", r'"(\d+)"', 1), F.col("cost_usd")
    return read.groupBy(campaign.alias("campaign"), scalars.blank_to_null(F.col("type")).alias("type")).agg(
        F.count("*").alias("n"), F.count_if(scalars.iso_date(F.col("report_date")).isNotNull()).alias("dated"), F.sum(scalars.number(cost)).alias("cost"), F.count_if(scalars.optional_number(cost).isNull()).alias("unread"),
        F.count_if(F.col("campaign_name").contains("\n")).alias("broken"),
    )


QUERIES["csv_reports"] = csv_reports
ORACLE["csv_reports"] = """SELECT CAST(user_id % 12 AS VARCHAR) AS campaign, CASE WHEN event_id % 7 <> 0 THEN event_type END AS type, count(*) AS n, count(*) AS dated,
CAST(sum(CASE WHEN event_id % 10 = 0 THEN 0 ELSE floor(value) * 1000 END) AS DOUBLE) AS cost, count(*) FILTER (event_id % 10 = 0) AS unread, count(*) AS broken FROM events GROUP BY 1, 2"""


def json_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights as documents of rows: canonical facts by campaign, country and platform, and what is rejected."""
    root = f"{shared_root(spark)}/insights/{uuid.uuid4().hex}"
    text = lambda c: F.expr(c).cast("string")
    row = F.struct(
        text("CASE WHEN event_id % 11 = 0 THEN 'yesterday' ELSE CAST(CAST(ts AS DATE) AS STRING) END").alias("date_start"), text("CASE WHEN user_id % 12 = 9 THEN ' ' ELSE 'c' || CAST(user_id % 12 AS STRING) END").alias("campaign_id"),
        text("CASE user_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'GB' ELSE 'unknown' END").alias("country"), text("CASE event_id % 3 WHEN 0 THEN 'iphone' WHEN 1 THEN 'android_smartphone' ELSE 'desktop' END").alias("impression_device"),
        F.format_string("%.2f", F.floor("value").cast("double")).alias("spend"), text("user_id").alias("impressions"), text("CASE WHEN event_type = 'click' THEN '1' END").alias("clicks"),
        text("CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN '1' END").alias("inline_link_clicks"), F.lit("usd").alias("account_currency"),
    )
    body = F.to_json(F.struct(F.collect_list(row).alias("data")))
    # Documents of some hundred rows each, as pages are.
    _events(spark, sf_dir).groupBy(F.expr("CAST(floor(event_id / 200) AS BIGINT)").alias("page")).agg(body.alias("body")).select("body").write.text(root)
    facts = files.delivery_facts(files.read_insights(spark, root, lines=True))
    return facts.groupBy("campaign", "country", "platform", "currency", "rejected").agg(
        F.count("*").alias("n"), F.sum("spend").cast("double").alias("spend"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("link_clicks").alias("link_clicks")
    )


QUERIES["json_insights"] = json_insights
ORACLE["json_insights"] = """SELECT CASE WHEN user_id % 12 <> 9 THEN 'c' || CAST(user_id % 12 AS VARCHAR) END AS campaign, CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' END AS country,
CASE event_id % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE 'web' END AS platform, 'USD' AS currency, event_id % 11 = 0 OR user_id % 12 = 9 AS rejected, count(*) AS n, CAST(sum(floor(value)) AS DOUBLE) AS spend,
CAST(sum(user_id) AS BIGINT) AS impressions, count(*) FILTER (event_type = 'click') AS clicks, nullif(count(*) FILTER (event_type = 'click' AND user_id % 2 = 0), 0) AS link_clicks FROM events GROUP BY 1, 2, 3, 4, 5"""


def settled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events, some delivered twice: the days that its watermark has closed, each once and final."""
    root = f"{shared_root(spark)}/settled/{uuid.uuid4().hex}"
    rows = _events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows.unionByName(rows.filter("event_id % 5 = 0")).write.parquet(f"{root}/landed")
    stream = ingest.read_stream(spark, f"{root}/landed", "event_id long, ts timestamp, event_type string, value double", files_per_batch=1_000_000)
    counts = ingest.daily_counts(ingest.once_each(ingest.timed(stream)))
    counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("day date, event_type string, events long, value decimal(20,6)").parquet(f"{root}/out")
    return out.withColumn("value", F.col("value").cast("double"))


QUERIES["settled_days"] = settled_days
ORACLE["settled_days"] = """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS value FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2"""

#: Filters of the registered series, and the conditions that they stand for in SQL: on delivery, then on installs and revenue.
_CASES = {
    "gb": (populations.Filters(country="GB"), "country = 'GB'", "country = 'GB'"),
    "ios_week": (populations.Filters(first="2024-01-05", last="2024-01-11", platform="ios"), "platform = 'ios' AND {d} BETWEEN '2024-01-05' AND '2024-01-11'", "platform = 'ios' AND {d} BETWEEN '2024-01-05' AND '2024-01-11'"),
    "organic": (populations.Filters(channel="organic"), "FALSE", "(media_source IS NULL OR media_source = 'Organic')"),
    "social_meta": (populations.Filters(channel="paid_social", provider="meta_ads"), "TRUE", "(media_source IN ('Facebook Ads', 'tiktok_ads'))"),
    "other_provider": (populations.Filters(provider="tiktok_ads", country="US"), "FALSE", "country = 'US'"),
}


def filtered_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily spend, installs and revenue under several filters; one that contradicts its rows leaves none of a table."""
    facts = {n: view(spark, sf_dir, n) for n in ("delivery", "installs", "revenue")}
    out = None
    for name, (filters, *_) in _CASES.items():
        held = [filters.on(facts[t], d) for t, d in (("delivery", "report_date"), ("installs", "install_date"), ("revenue", "event_date"))]
        one = aggregates.timeseries(*held).select(F.lit(name).alias("filters"), "day", F.col("spend").cast("double").alias("spend"), "impressions", "clicks", "installs", F.col("revenue").cast("double").alias("revenue"))
        out = one if out is None else out.unionByName(one)
    return out


def _series_sql(name: str, on_delivery: str, on_others: str) -> str:
    return f"""SELECT '{name}' AS filters, coalesce(d.day, i.day, r.day) AS day, spend, impressions, clicks, installs, revenue FROM
(SELECT report_date AS day, CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM delivery WHERE {on_delivery.format(d="report_date")} GROUP BY 1) d
FULL JOIN (SELECT install_date AS day, CAST(sum(installs) AS BIGINT) AS installs FROM installs WHERE {on_others.format(d="install_date")} GROUP BY 1) i ON d.day = i.day
FULL JOIN (SELECT event_date AS day, CAST(sum(revenue) AS DOUBLE) AS revenue FROM revenue WHERE {on_others.format(d="event_date")} GROUP BY 1) r ON coalesce(d.day, i.day) = r.day"""


QUERIES["filtered_series"] = filtered_series
ORACLE["filtered_series"] = with_views("\nUNION ALL ".join(_series_sql(n, d, o) for n, (_, d, o) in _CASES.items()), "delivery", "installs", "revenue")
