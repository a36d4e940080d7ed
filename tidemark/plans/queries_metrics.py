"""Delivery, attribution and unified metrics over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars
from tidemark.operators import aggregates, metrics, populations
from tidemark.plans.bridge import held, view, with_views

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, *views: str):
    """Registers a query under its name, with oracle SQL over named inputs."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


OPERATIONAL = "(status IN ('matched_exact', 'matched_confident', 'manually_verified') OR (status = 'matched_fallback' AND confidence >= 0.9))"
ORGANIC = "(media_source IS NULL OR media_source = 'Organic')"
LIVE = "(spend > 0 OR impressions > 0 OR clicks > 0)"


@query("SELECT report_date AS day, CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM delivery GROUP BY 1", "delivery")
def delivery_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.daily(view(spark, sf_dir, "delivery"), "report_date", "spend", "impressions", "clicks").withColumn("spend", F.col("spend").cast("double"))


_KPIS = """, d AS (SELECT {key}, CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM {table} GROUP BY {group})
SELECT *, CASE WHEN impressions >= 1000 THEN CAST(clicks AS DOUBLE) / CAST(impressions AS DOUBLE) END AS ctr, CASE WHEN impressions >= 1000 THEN spend * 1000 / CAST(impressions AS DOUBLE) END AS cpm,
CASE WHEN clicks >= 50 THEN spend / CAST(clicks AS DOUBLE) END AS cpc FROM d"""


def _rates(sums: DataFrame) -> DataFrame:
    spend = F.col("spend").cast("double")
    return sums.withColumn("spend", spend).withColumns({
        "ctr": scalars.ratio(F.col("clicks"), F.col("impressions"), vocab.MIN_IMPRESSIONS), "cpm": scalars.ratio(F.col("spend") * 1000, F.col("impressions"), vocab.MIN_IMPRESSIONS), "cpc": scalars.ratio(F.col("spend"), F.col("clicks"), vocab.MIN_CLICKS),
    })


def _sql(text: str, *views: str) -> str:
    """Oracle SQL that goes on from the inputs' own WITH list."""
    return with_views("", *views).rstrip() + text


def delivery_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(aggregates.daily(view(spark, sf_dir, "big_delivery"), "report_date", "spend", "impressions", "clicks"))


def delivery_by_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(view(spark, sf_dir, "big_delivery").groupBy("campaign").agg(*(F.sum(m).alias(m) for m in ("spend", "impressions", "clicks"))))


QUERIES |= {"delivery_kpis": delivery_kpis, "delivery_by_campaign": delivery_by_campaign}
ORACLE["delivery_kpis"] = _sql(_KPIS.format(key="report_date AS day", table="big_delivery", group="1"), "big_delivery")
ORACLE["delivery_by_campaign"] = _sql(_KPIS.format(key="campaign", table="big_delivery", group="1"), "big_delivery")

_FLAGS = f""", link AS (SELECT * FROM mappings WHERE {OPERATIONAL}),
d AS (SELECT *, campaign IN (SELECT source FROM link) AS mapped, {LIVE} AS live FROM delivery),
hit AS (SELECT target FROM link WHERE target IS NOT NULL), near AS (SELECT target FROM link WHERE target IS NOT NULL AND source IN (SELECT campaign FROM d WHERE live)),
i AS (SELECT *, {ORGANIC} AS organic, campaign IN (SELECT target FROM hit) AS mapped, campaign IN (SELECT target FROM near) AS aligned FROM installs),
r AS (SELECT *, {ORGANIC} AS organic, campaign IN (SELECT target FROM hit) AS mapped, campaign IN (SELECT target FROM near) AS aligned FROM revenue)"""
_INPUTS = ("delivery", "installs", "revenue", "mappings")


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in _INPUTS]


def attribution_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivery, installs, _, mappings = _tables(spark, sf_dir)
    return aggregates.install_totals(installs, mappings, delivery)


ORACLE["attribution_totals"] = _sql(_FLAGS + """
SELECT *, installs - organic_installs - mapped_installs AS unmapped_installs FROM (SELECT CAST(coalesce(sum(installs), 0) AS BIGINT) AS installs, CAST(coalesce(sum(installs) FILTER (organic), 0) AS BIGINT) AS organic_installs,
CAST(coalesce(sum(installs) FILTER (NOT organic AND mapped), 0) AS BIGINT) AS mapped_installs, CAST(coalesce(sum(installs) FILTER (NOT organic AND aligned), 0) AS BIGINT) AS aligned_installs, count(*) AS install_rows FROM i) x""", *_INPUTS)  # fmt: skip


def revenue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivery, _, revenue, mappings = _tables(spark, sf_dir)
    out = aggregates.revenue_totals(revenue, mappings, delivery)
    return out.select(*(F.col(c).cast("double").alias(c) for c in out.columns if c != "revenue_currencies"), "revenue_currencies")


ORACLE["revenue_split"] = _sql(_FLAGS + """
SELECT CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(revenue) FILTER (NOT organic AND mapped) AS DOUBLE) AS mapped_revenue, CAST(sum(revenue) FILTER (NOT organic AND aligned) AS DOUBLE) AS aligned_revenue,
CAST(sum(revenue) FILTER (organic) AS DOUBLE) AS organic_revenue, CAST(sum(revenue) FILTER (revenue_type = 'iap') AS DOUBLE) AS iap_revenue, CAST(sum(revenue) FILTER (revenue_type = 'ad') AS DOUBLE) AS ad_revenue,
count(DISTINCT currency) AS revenue_currencies FROM r""", *_INPUTS)  # fmt: skip


def mapped_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend by country of mapped and all campaigns."""
    delivery, _, _, mappings = _tables(spark, sf_dir)
    rows = populations.marketing(delivery, mappings)
    return rows.groupBy("country").agg(F.sum("spend").cast("double").alias("spend"), aggregates.total("spend", F.col("mapped")).cast("double").alias("mapped_spend"))


ORACLE["mapped_spend"] = _sql(_FLAGS + "\nSELECT country, CAST(sum(spend) AS DOUBLE) AS spend, CAST(coalesce(sum(spend) FILTER (mapped), 0) AS DOUBLE) AS mapped_spend FROM d GROUP BY 1", *_INPUTS)


def mapped_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivery, installs, _, mappings = _tables(spark, sf_dir)
    rows = populations.attribution(installs, mappings, delivery)
    return rows.groupBy("country", "platform", "organic", "mapped", "aligned").agg(F.sum("installs").alias("installs"))


ORACLE["mapped_installs"] = _sql(_FLAGS + "\nSELECT country, platform, organic, mapped, aligned, CAST(sum(installs) AS BIGINT) AS installs FROM i GROUP BY 1, 2, 3, 4, 5", *_INPUTS)


def delivery_aligned_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment under filters: one country and a window reach both sides."""
    filters = populations.Filters(first="2024-01-02", last="2024-01-09", country="US")
    delivery, installs, _, mappings = _tables(spark, sf_dir)
    delivery, installs = filters.on(delivery, "report_date"), filters.on(installs, "install_date")
    return populations.attribution(installs, mappings, delivery).filter(~F.col("organic") & F.col("aligned")).groupBy("campaign").agg(F.sum("installs").alias("installs"))


ORACLE["delivery_aligned_installs"] = with_views(f"""SELECT campaign, CAST(sum(installs) AS BIGINT) AS installs FROM installs WHERE country = 'US' AND install_date BETWEEN '2024-01-02' AND '2024-01-09' AND NOT {ORGANIC}
AND campaign IN (SELECT target FROM mappings WHERE {OPERATIONAL} AND target IS NOT NULL AND source IN (SELECT campaign FROM delivery WHERE {LIVE} AND country = 'US' AND report_date BETWEEN '2024-01-02' AND '2024-01-09')) GROUP BY 1""", *_INPUTS)


def operational_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivery, installs, revenue, mappings = map(held, _tables(spark, sf_dir))
    return metrics.operational_metrics(delivery, installs, revenue, mappings)


def one_currency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the second currency: what was blocked has a value."""
    delivery, installs, revenue, mappings = map(held, _tables(spark, sf_dir))
    usd = F.col("currency") == "USD"
    return metrics.operational_metrics(delivery.filter(usd), installs, revenue.filter(usd), mappings)


def _metric_sql(key: str, top: str, below: str = "NULL", least: int = 0, scale: int = 1, mixed: str = "FALSE", partial: str = "FALSE") -> str:
    ratio = below != "NULL"
    bad = f"{below} IS NULL OR {below} <= 0 OR {below} < {least}" if ratio else "FALSE"
    return f"""SELECT '{key}' AS metric, CASE WHEN {mixed} OR {bad} THEN NULL ELSE {f"CAST({top} AS DOUBLE) * {scale} / CAST({below} AS DOUBLE)" if ratio else f"CAST({top} AS DOUBLE)"} END AS value,
    CASE WHEN {mixed} THEN NULL ELSE CAST({top} AS DOUBLE) END AS numerator, CAST({below} AS DOUBLE) AS denominator,
    CASE WHEN {mixed} THEN 'blocked' WHEN {top} IS NULL OR {bad} THEN 'unavailable' WHEN {partial} THEN 'partial' ELSE 'available' END AS availability,
    CASE WHEN {mixed} THEN 'mixed_currency' WHEN {top} IS NULL THEN 'not_reported' {f"WHEN {below} IS NULL OR {below} <= 0 THEN 'missing_denominator' WHEN {below} < {least} THEN 'below_minimum'" if ratio else ""} WHEN {partial} THEN 'population_mismatch' END AS reason FROM v"""


_S, _R = "spend_cur > 1", "revenue_cur > 1"
_METRICS = [
    ("spend", "spend", "NULL", 0, 1, _S), ("impressions", "impressions"), ("clicks", "clicks"), ("link_clicks", "link_clicks"), ("ctr", "clicks", "impressions", 1000), ("cpm", "spend", "impressions", 1000, 1000, _S), ("cpc", "spend", "clicks", 50, 1, _S),
    ("attributed_installs", "installs"), ("attributed_revenue", "revenue", "NULL", 0, 1, _R), ("paid_attributed_installs", "installs - organic_installs"), ("iap_revenue", "iap", "NULL", 0, 1, _R), ("ad_revenue", "ad", "NULL", 0, 1, _R),
    ("mapped_paid_installs", "mapped_installs"), ("organic_installs", "organic_installs"), ("mapped_attributed_revenue", "mapped_revenue", "NULL", 0, 1, _R), ("delivery_aligned_paid_installs", "aligned_installs"), ("delivery_aligned_revenue", "aligned_revenue", "NULL", 0, 1, _R),
    ("mapped_cpi", "mapped_spend", "aligned_installs", 25, 1, _S, "installs - organic_installs - mapped_installs > 0 OR mapped_installs - aligned_installs > 0"), ("blended_cpi", "spend", "installs", 25, 1, _S, "organic_installs > 0 OR installs - organic_installs - mapped_installs > 0"),
    ("mapping_coverage", "good", "known", 1), ("operational_mapping_coverage", "usable", "known", 1), ("spend_coverage", "mapped_spend", "spend", 0, 1, _S), ("attribution_coverage", "mapped_installs", "(installs - organic_installs)"), ("campaign_operational_coverage", "mapped_live", "live_campaigns", 1),
]
_VALUES = """, v AS (SELECT * FROM
(SELECT coalesce(sum(spend), 0) AS spend, coalesce(sum(spend) FILTER (mapped), 0) AS mapped_spend, sum(impressions) AS impressions, sum(clicks) AS clicks, sum(link_clicks) AS link_clicks, count(DISTINCT currency) AS spend_cur, count(DISTINCT campaign) FILTER (live) AS live_campaigns, count(DISTINCT campaign) FILTER (live AND mapped) AS mapped_live FROM d),
(SELECT sum(installs) AS installs, coalesce(sum(installs) FILTER (organic), 0) AS organic_installs, coalesce(sum(installs) FILTER (NOT organic AND mapped), 0) AS mapped_installs, coalesce(sum(installs) FILTER (NOT organic AND aligned), 0) AS aligned_installs FROM i),
(SELECT sum(revenue) AS revenue, coalesce(sum(revenue) FILTER (NOT organic AND mapped), 0) AS mapped_revenue, coalesce(sum(revenue) FILTER (NOT organic AND aligned), 0) AS aligned_revenue, coalesce(sum(revenue) FILTER (revenue_type = 'iap'), 0) AS iap, coalesce(sum(revenue) FILTER (revenue_type = 'ad'), 0) AS ad, count(DISTINCT currency) AS revenue_cur FROM r),
(SELECT count(*) AS known, count(*) FILTER (status IN ('matched_exact', 'matched_confident', 'manually_verified')) AS good, count(*) FILTER (""" + OPERATIONAL + """) AS usable FROM (SELECT DISTINCT ON (source) * FROM mappings ORDER BY source, confidence DESC, status, coalesce(target, ''))))\n"""  # fmt: skip
_BODY = "\nUNION ALL ".join(_metric_sql(*m) for m in _METRICS)
ORACLE["operational_metrics_long"] = _sql(_FLAGS + _VALUES + _BODY, *_INPUTS)
ORACLE["one_currency_metrics"] = _sql(_FLAGS.replace("FROM delivery)", "FROM delivery WHERE currency = 'USD')").replace("FROM revenue)", "FROM revenue WHERE currency = 'USD')") + _VALUES + _BODY, *_INPUTS)


@query("""SELECT coalesce(d.day, i.day, r.day) AS day, spend, impressions, clicks, installs, revenue FROM
(SELECT report_date AS day, CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM delivery GROUP BY 1) d
FULL JOIN (SELECT install_date AS day, CAST(sum(installs) AS BIGINT) AS installs FROM installs GROUP BY 1) i ON d.day = i.day
FULL JOIN (SELECT event_date AS day, CAST(sum(revenue) AS DOUBLE) AS revenue FROM revenue GROUP BY 1) r ON coalesce(d.day, i.day) = r.day""", *_INPUTS)  # fmt: skip
def timeseries_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivery, installs, revenue, _ = _tables(spark, sf_dir)
    return aggregates.timeseries(delivery, installs, revenue).withColumns({c: F.col(c).cast("double") for c in ("spend", "revenue")})


@query("""SELECT CASE media_source WHEN 'Organic' THEN 'organic' WHEN 'Facebook Ads' THEN 'paid_social' WHEN 'google adwords' THEN 'paid_search' WHEN 'tiktok_ads' THEN 'paid_social' ELSE 'unknown' END AS channel, CAST(sum(installs) AS BIGINT) AS installs FROM big_installs GROUP BY 1""", "big_installs")
def channel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.channels(view(spark, sf_dir, "big_installs"))


@query("""SELECT media_source AS raw, CASE media_source WHEN 'Organic' THEN 'organic' WHEN 'Facebook Ads' THEN 'meta' WHEN 'google adwords' THEN 'google' WHEN 'tiktok_ads' THEN 'tiktok' ELSE 'unknownnet' END AS source, CAST(sum(installs) AS BIGINT) AS installs FROM big_installs GROUP BY 1, 2""", "big_installs")
def media_source_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "big_installs")
    return rows.groupBy(F.col("media_source").alias("raw"), scalars.media_source(F.col("media_source")).alias("source")).agg(F.sum("installs").alias("installs"))


_RAW_PLATFORM = "CASE user_id % 7 WHEN 0 THEN 'iPhone' WHEN 1 THEN 'iOS 17' WHEN 2 THEN 'Android_Smartphone' WHEN 3 THEN 'desktop' WHEN 4 THEN 'mobile_web' WHEN 5 THEN NULL ELSE 'console' END"


@query(f"""SELECT CASE WHEN raw LIKE '%iphone%' OR raw LIKE 'ios%' THEN 'ios' WHEN raw LIKE '%android%' THEN 'android' WHEN raw LIKE '%web%' OR raw LIKE '%desktop%' THEN 'web' ELSE 'unknown' END AS platform, count(*) AS n
FROM (SELECT lower({_RAW_PLATFORM}) AS raw FROM events) x GROUP BY 1""")
def platform_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_RAW_PLATFORM).alias("raw"))
    return raw.groupBy(scalars.platform(F.col("raw")).alias("platform")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS missing FROM events GROUP BY 1""")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed access to stored JSON."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("missing"))


ORACLE["metric_definitions"] = "SELECT * FROM (VALUES " + ", ".join(f"('{m.key}', '{m.family}', '{m.unit}', '{m.grain}', '{m.numerator}', {repr(m.denominator) if m.denominator else 'NULL'}, CAST({m.minimum} AS DOUBLE))" for m in metrics.OPERATIONAL + metrics.COHORT) + ") AS d(metric, family, unit, grain, numerator, denominator, minimum)"


def metric_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_definitions(spark)


QUERIES |= {f.__name__: f for f in (attribution_totals, revenue_split, mapped_spend, mapped_installs, delivery_aligned_installs, operational_metrics_long, one_currency_metrics, metric_definitions)}
