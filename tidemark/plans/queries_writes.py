"""Writes, sources and checks that other queries don't reach, over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import aggregates, campaigns, decisions, merge, quality, reconcile, runs
from tidemark.plans.bridge import view, with_views
from tidemark.plans.queries_metrics import OPERATIONAL
from tidemark.sources import files

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str, *views: str):
    """Registers a query under its name with its SQL over named inputs."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Writes.
_COMPUTED = "SELECT source, target, CASE WHEN status IN ('matched_exact', 'rejected') THEN 'matched_confident' ELSE status END AS status, 'computed' AS method, CAST(0.98 AS DOUBLE) AS confidence FROM big_mappings WHERE CAST(substr(source, 2) AS INT) % 3 <> 0"


@query(
    f"""SELECT coalesce(s.source, w.source) AS source, coalesce(s.target, w.target) AS target, CASE WHEN s.status IN ('manually_verified', 'rejected') THEN s.status ELSE w.status END AS status, CASE WHEN s.status IN ('manually_verified', 'rejected') THEN s.method ELSE w.method END AS method,
CASE WHEN s.status IN ('manually_verified', 'rejected') THEN s.confidence ELSE w.confidence END AS confidence FROM big_mappings s FULL JOIN ({_COMPUTED}) w ON s.source = w.source AND s.target = w.target WHERE w.source IS NOT NULL OR s.status IN ('manually_verified', 'rejected')""",
    "big_mappings",
)
def mapping_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed edges over stored ones: what people decided stays, what is not computed again goes."""
    stored = view(spark, sf_dir, "big_mappings")
    computed = spark.sql(_COMPUTED.replace("FROM big_mappings", "FROM {stored}"), stored=stored)
    return merge.merge_mappings(stored, computed)


@query("""SELECT status, method, count(*) AS n FROM (SELECT CASE WHEN source = 'c1' AND target = 'a2' THEN 'manually_verified' ELSE status END AS status, CASE WHEN source = 'c1' AND target = 'a2' THEN 'manual' ELSE method END AS method FROM big_mappings) x GROUP BY 1, 2""", "big_mappings")
def manual_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge verified by hand."""
    return merge.decide(view(spark, sf_dir, "big_mappings"), "c1", "a2", True).groupBy("status", "method").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderstatus, max(o_orderdate) AS seen FROM orders GROUP BY o_custkey, o_orderstatus")
def upsert_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension rows of which the newest stays: even customers are stored, all are written."""
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderdate").alias("seen"))
    return merge.upsert_latest(rows.filter("o_custkey % 2 = 0"), rows, ["o_custkey", "o_orderstatus"], "seen")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN o_custkey ELSE l_suppkey END AS parent FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def parent_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent id filled from a dimension where facts lack it."""
    facts = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey")).alias("parent"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("parent"))
    return merge.backfill_parent(facts, orders, ["l_orderkey"], "parent")


@query("""SELECT check_key, severity, count(*) AS n FROM (SELECT check_key, severity FROM findings WHERE check_key <> 'marketing.negative_measure' UNION ALL SELECT 'marketing.negative_measure', 'warning' FROM findings WHERE run IS NULL) x GROUP BY 1, 2""", "findings")
def findings_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of one check replaced by those of a new pass."""
    stored = view(spark, sf_dir, "findings").select("run", "check_key", "severity")
    found = stored.filter("run IS NULL").select("run", F.lit("marketing.negative_measure").alias("check_key"), F.lit("warning").alias("severity"))
    return merge.replace_findings(stored, found, ["marketing.negative_measure"]).groupBy("check_key", "severity").agg(F.count("*").alias("n"))




@query("""SELECT coalesce(s.stream, w.stream) AS stream, coalesce(w.status, s.status) AS status, coalesce(w.last_success, s.last_success) AS last_success, CASE WHEN s.latest_day IS NULL THEN w.latest_day WHEN w.latest_day IS NULL THEN s.latest_day ELSE greatest(s.latest_day, w.latest_day) END AS latest_day
FROM (SELECT c_nationkey AS stream, 'stale' AS status, max(c_custkey) AS last_success, max(c_custkey) AS latest_day FROM customer WHERE c_nationkey < 20 GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS stream, CASE WHEN c_nationkey % 2 = 0 THEN 'fresh' END AS status, CASE WHEN c_nationkey % 3 = 0 THEN min(c_custkey) END AS last_success, min(c_custkey) AS latest_day FROM customer WHERE c_nationkey > 5 GROUP BY 1) w ON s.stream = w.stream""")
def freshness_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values where there are any; the newest day never goes back."""
    rows = _table(spark, sf_dir, "customer").withColumn("stream", F.col("c_nationkey"))
    stored = rows.filter("stream < 20").groupBy("stream").agg(F.lit("stale").alias("status"), F.max("c_custkey").alias("last_success"), F.max("c_custkey").alias("latest_day"))
    seen = rows.filter("stream > 5").groupBy("stream").agg(F.when(F.col("stream") % 2 == 0, "fresh").alias("status"), F.when(F.col("stream") % 3 == 0, F.min("c_custkey")).alias("last_success"), F.min("c_custkey").alias("latest_day"))
    return merge.merge_freshness(stored, seen, ["stream"])


@query("""SELECT run, string_agg(k, ',' ORDER BY n) AS windows, count(*) FILTER (n % 2 = 0) AS with_data FROM (SELECT o_custkey AS run, 'w' || CAST(o_orderkey AS VARCHAR) AS k, o_orderkey AS n FROM orders) x GROUP BY 1""")
def checkpoint_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that finished, in order, appended to each run's lists: a run's first one was there before."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("position"), F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("window"))
    rows = orders.withColumn("data_window", F.when(F.col("position") % 2 == 0, F.struct(F.col("window").alias("from"))))
    first = rows.groupBy("run").agg(F.min_by(F.struct("window", "data_window"), "position").alias("f"))
    held = first.select("run", F.array("f.window").alias("windows"), F.filter(F.array("f.data_window"), lambda w: w.isNotNull()).alias("data_windows"))
    return merge.append_checkpoint(held, rows).select("run", F.array_join("windows", ",").alias("windows"), F.size("data_windows").cast("long").alias("with_data"))


@query("SELECT DISTINCT media_source AS source, CASE media_source WHEN 'google adwords' THEN 'google' WHEN 'tiktok_ads' THEN 'tiktok' WHEN 'Organic' THEN 'organic' ELSE 'unknownnet' END AS normal, media_source = 'Organic' AS organic FROM big_installs WHERE media_source <> 'Facebook Ads'", "big_installs")
def source_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sources that the directory lacks."""
    facts = view(spark, sf_dir, "big_installs")
    return merge.new_sources(facts.filter("media_source = 'Facebook Ads'").select(F.col("media_source").alias("source")).distinct(), facts)


@query("SELECT n_nationkey AS app, CASE WHEN n_nationkey % 2 = 0 THEN 0.7 ELSE 0.5 END AS target FROM nation WHERE n_regionkey <> 4 AND (n_nationkey % 2 = 0 OR n_nationkey < 20)")
def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy an app: written ones replace stored ones, removed ones go."""
    apps = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("app"), "n_regionkey")
    policy = lambda rows, target: rows.select("app", F.lit(target).alias("target"))
    return merge.put_policies(policy(apps.filter("app < 20"), 0.5), policy(apps.filter("app % 2 = 0"), 0.7), apps.filter("n_regionkey = 4"))


@query("""SELECT connection, capability, account, supported, seen FROM (SELECT c_nationkey AS connection, c_mktsegment AS capability, CASE WHEN c_custkey % 5 = 0 THEN 'acc' || CAST(c_custkey % 3 AS VARCHAR) END AS account, c_custkey % 2 = 0 AS supported, c_custkey AS seen FROM customer) x
QUALIFY row_number() OVER (PARTITION BY connection, capability ORDER BY account IS NOT NULL DESC, seen DESC) = 1""")
def capability_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account's own capability before its connection's, then the newest."""
    rows = _table(spark, sf_dir, "customer")
    account = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("acc"), (F.col("c_custkey") % 3).cast("string")))
    return merge.capability_of(rows.select(F.col("c_nationkey").alias("connection"), F.col("c_mktsegment").alias("capability"), account.alias("account"), (F.col("c_custkey") % 2 == 0).alias("supported"), F.col("c_custkey").alias("seen")))


def _checksum_sql(columns: list[str], table: str) -> str:
    row = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns)
    limbs = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)::DECIMAL(38,0)) AS VARCHAR) AS s{i}" for i in range(4))
    return f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(concat_ws(':', g, n, s0, s1, s2, s3), ',' ORDER BY g)) AS digest
FROM (SELECT CAST('0x' || substr(h, 1, 3) AS BIGINT) % 4096 AS g, count(*) AS n, {limbs} FROM (SELECT sha256({row}) AS h FROM {table}) r GROUP BY 1) p"""


@query(f"""SELECT a.n_rows, a.digest, b.digest AS changed_digest, TRUE AS same_in_any_order FROM ({_checksum_sql(["l_orderkey", "l_linenumber", "CAST(l_quantity AS BIGINT)", "l_returnflag"], "lineitem")}) a,
({_checksum_sql(["l_orderkey", "l_linenumber", "CAST(l_quantity AS BIGINT)", "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END"], "lineitem")}) b""")
def table_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's digest, that of the table with one column changed in some rows, and whether order matters."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("l_quantity"), "l_returnflag")
    changed = rows.withColumn("l_returnflag", F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_returnflag")))
    a, b, c = (aggregates.checksum(t).select("n_rows", F.col("digest").alias(n)) for t, n in ((rows, "digest"), (rows.repartition(7, "l_returnflag"), "again"), (changed, "changed_digest")))
    both = a.crossJoin(b.drop("n_rows")).crossJoin(c.drop("n_rows"))
    return both.select("n_rows", "digest", "changed_digest", (F.col("digest") == F.col("again")).alias("same_in_any_order"))


# Sources.
_RAW = "CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Facebook Ads' ELSE 'tiktok_ads' END AS media_source, CASE user_id % 4 WHEN 0 THEN ' us' WHEN 1 THEN 'gb' ELSE 'usa' END AS country, CASE user_id % 2 WHEN 0 THEN 'iPhone' ELSE 'android_tv' END AS platform"


@query(f"""SELECT CAST(install_date AS DATE) AS install_date, nullif(media_source, '') AS media_source, campaign, CASE country WHEN ' us' THEN 'US' WHEN 'gb' THEN 'GB' END AS country, CASE platform WHEN 'iPhone' THEN 'ios' ELSE 'android' END AS platform, count(*) AS installs
FROM (SELECT CAST(ts AS DATE) AS install_date, {_RAW}, CAST(user_id % 12 AS VARCHAR) AS campaign FROM events WHERE event_type = 'signup') x GROUP BY ALL""")
def raw_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw report rows, one an install, as daily counts."""
    events = _table(spark, sf_dir, "events").filter("event_type = 'signup'")
    raw = spark.sql(f"SELECT date_format(ts, 'yyyy-MM-dd HH:mm') AS install_date, {_RAW}, CAST(user_id % 12 AS STRING) AS campaign_id FROM {{events}}", events=events)
    return files.install_facts(raw)


@query("""SELECT CAST(ts AS DATE) AS event_date, nullif(CASE user_id % 3 WHEN 0 THEN '' ELSE 'net' END, '') AS media_source, CAST(user_id % 12 AS VARCHAR) AS campaign, 'US' AS country, 'ios' AS platform, 'USD' AS currency, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS revenue, 'iap' AS revenue_type
FROM events WHERE CAST(value AS DECIMAL(20,6)) <> 0 GROUP BY 1, 2, 3""")
def raw_event_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-app revenue of raw events that carry an amount."""
    raw = _table(spark, sf_dir, "events").selectExpr("date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS event_time", "event_type AS event_name", "CASE user_id % 3 WHEN 0 THEN '' ELSE 'net' END AS media_source", "CAST(user_id % 12 AS STRING) AS campaign_id", "'us' AS country_code", "'iOS' AS platform", "CAST(CAST(value AS DECIMAL(20,6)) AS STRING) AS event_revenue", "'usd' AS event_revenue_currency")
    return files.event_facts(raw)[1].withColumn("revenue", F.col("revenue").cast("double"))


@query("""SELECT revenue_type, age, count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS revenue FROM (SELECT 'iap' AS revenue_type, CAST(NULL AS INT) AS age, CAST(l_extendedprice AS DECIMAL(20,6)) AS revenue FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT 'total', NULL, CAST(l_extendedprice AS DECIMAL(20,6)) FROM lineitem WHERE l_linenumber % 2 = 1
UNION ALL SELECT 'ad', 7, CAST(l_tax AS DECIMAL(20,6)) FROM lineitem WHERE l_linenumber > 1) x WHERE revenue <> 0 GROUP BY 1, 2""")
def wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide revenue report as rows: components before totals, zeros left out, cohorts only with installs."""
    wide = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber - 1 AS installs", "CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END AS iap", "l_extendedprice AS total", "l_tax AS ad_7d", "l_quantity AS total_7d")
    return files.unpivot_revenue(wide, ["l_orderkey"]).groupBy("revenue_type", "age").agg(F.count("*").alias("n"), F.sum("revenue").cast("double").alias("revenue"))


@query("""SELECT CAST(o_orderdate AS DATE) AS report_date, CAST(o_custkey AS VARCHAR) AS campaign, CAST(sum(CAST(o_totalprice AS DECIMAL(20,6))) AS DOUBLE) AS spend, count(*) AS n FROM orders GROUP BY 1, 2""")
def replayed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON pages read again as delivery rows: a page holds the rows of a day."""
    rows = _table(spark, sf_dir, "orders").select(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_start"), F.col("o_custkey").cast("string").alias("campaign_id"), F.col("o_totalprice").cast("decimal(20,6)").cast("string").alias("spend")).alias("r"))
    pages = rows.groupBy(F.col("r.date_start").alias("d")).agg(F.to_json(F.struct(F.collect_list("r").alias("data"))).alias("payload"))
    back = files.replay(pages, f"struct<{files.INSIGHT.replace(' string', ':string')}>")
    facts = files.delivery_facts(back).filter("NOT rejected")
    return facts.groupBy("report_date", "campaign").agg(F.sum("spend").cast("double").alias("spend"), F.count("*").alias("n"))


@query("""SELECT CAST(o_orderdate AS DATE) AS install_date, CASE o_orderpriority WHEN '1-URGENT' THEN NULL ELSE o_orderpriority END AS media_source, CAST(sum(o_custkey) AS BIGINT) AS installs, 'unknown' AS certainty FROM orders GROUP BY 1, 2""")
def aggregate_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installs that a report has summed by day and source: no ids, certainty unknown."""
    raw = _table(spark, sf_dir, "orders").selectExpr("date_format(o_orderdate, 'yyyy-MM-dd') AS date", "CASE o_orderpriority WHEN '1-URGENT' THEN ' ' ELSE o_orderpriority END AS media_source", "CAST(o_custkey AS STRING) AS installs")
    return files.aggregate_installs(raw).groupBy("install_date", "media_source", "certainty").agg(F.sum("installs").alias("installs"))


@query("""SELECT CAST(o_orderdate AS DATE) AS install_date, CAST(o_custkey % 50 AS VARCHAR) AS campaign, CAST(sum(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey ELSE 0 END) AS BIGINT) AS installs FROM orders GROUP BY 1, 2""")
def tracked_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved report's rows: only what was tracked is attribution, what the network reports isn't."""
    raw = _table(spark, sf_dir, "orders").selectExpr("date_format(o_orderdate, 'yyyy-MM-dd') AS date", "CAST(o_custkey % 50 AS STRING) AS campaign_id", "'net' AS ad_network_name", "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS STRING) END AS tracked_installs", "'1000' AS installs")
    return files.tracked_installs(raw).groupBy("install_date", "campaign").agg(F.sum("installs").alias("installs"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS campaign, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'r' || CAST(p_partkey AS VARCHAR) END AS remote_id, p_brand AS channel FROM part WHERE p_partkey % 7 > 0")
def campaign_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory of campaigns from JSON resources; those without an id are left out."""
    of = _table(spark, sf_dir, "part").selectExpr("to_json(named_struct('id', CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey AS STRING) END, 'attributes', named_struct('name', p_name, 'remote_campaign_id', CASE WHEN p_partkey % 3 = 0 THEN concat('r', p_partkey) ELSE '' END, 'channel_name', p_brand))) AS resource")
    return files.campaign_directory(of)


@query("""SELECT age, kind, has FROM (SELECT unnest([1, 1, 1, 7, 7, 7]) AS age, unnest(['iap', 'ad', 'total', 'iap', 'ad', 'total']) AS kind, unnest([TRUE, TRUE, TRUE, FALSE, FALSE, TRUE]) AS has) x WHERE (SELECT count(*) FROM region) > 0""")
def report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which return each age of a report's columns gives: a total from both parts, or the provider's where it has neither."""
    names = _table(spark, sf_dir, "region").agg(F.array(*map(F.lit, ("iap_1d", "ad_1d", "total_1d", "total_7d", "installs"))).alias("columns"))
    return files.cohort_coverage(names)


@query("""SELECT level, count(*) AS n, sum(spend) AS spend FROM (SELECT CASE WHEN d % 3 = 0 THEN 'country_device' WHEN d % 3 = 1 THEN 'country' ELSE 'none' END AS level, spend FROM (SELECT CAST(o_orderdate AS DATE) AS day, day(CAST(o_orderdate AS DATE)) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(20,6))) AS DOUBLE) AS spend FROM orders GROUP BY 1, 2) x) y GROUP BY 1""")
def breakdown_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one day's reads at several breakdowns the finest that was answered counts, whole."""
    rows = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(20,6)").alias("spend"))
    day = F.dayofmonth("day")
    out = None
    for level, able in (("country_device", day % 3 == 0), ("country", day % 3 <= 1), ("none", F.lit(True))):
        one = rows.filter(able).withColumn("breakdown", F.lit(level))
        out = one if out is None else out.unionByName(one)
    best = files.finest_breakdown(out, "day").groupBy("day", F.col("breakdown").alias("level")).agg(F.sum("spend").cast("double").alias("spend"))
    return best.groupBy("level").agg(F.count("*").alias("n"), F.sum("spend").alias("spend"))


# Checks and small rules.
@query("""SELECT check_key, severity, count(*) AS n FROM (SELECT 'attribution.date_outside_window' AS check_key, 'warning' AS severity FROM installs WHERE install_date NOT BETWEEN '2024-01-03' AND '2024-01-20' UNION ALL SELECT 'attribution.missing_campaign_id', 'warning' FROM installs WHERE campaign = 'a5' AND installs > 0
UNION ALL SELECT 'attribution.negative_revenue', 'warning' FROM revenue WHERE campaign = 'a2' AND revenue > 0
UNION ALL SELECT 'attribution.cohort_not_cumulative', 'error' FROM (SELECT revenue, lag(revenue) OVER (PARTITION BY install_date, campaign, country, platform, media_source, revenue_type, currency ORDER BY age) AS before FROM cohorts) c WHERE revenue < before) x GROUP BY 1, 2""", "installs", "revenue", "cohorts")
def quality_attribution_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    installs, revenue, rows = (view(spark, sf_dir, n) for n in ("installs", "revenue", "cohorts"))
    installs = installs.withColumn("campaign", F.when(F.col("campaign") != "a5", F.col("campaign")))
    revenue = revenue.withColumn("revenue", F.when(F.col("campaign") == "a2", -F.col("revenue")).otherwise(F.col("revenue")))
    found = quality.check_attribution(installs, revenue, rows, "2024-01-03", "2024-01-20", ["install_date", "campaign", "country", "platform", "media_source", "revenue_type", "currency"])
    return quality.counts(found)


@query("""SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS usual, coalesce(avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) >= 10 AND (n / avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) <= 0.25 OR n / avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) >= 4), FALSE) AS odd
FROM (SELECT CAST(ts AS DATE) AS day, CASE WHEN day(ts) % 6 = 0 THEN count(*) * 5 ELSE count(*) END AS n FROM events GROUP BY 1, day(ts)) x""")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of unusual size against the mean of the seven before."""
    sums = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    sums = sums.withColumn("n", F.when(F.dayofmonth("day") % 6 == 0, F.col("n") * 5).otherwise(F.col("n")))
    usual = F.avg("n").over(decisions.Window.orderBy("day").rowsBetween(-7, -1))
    return sums.select("day", "n", usual.alias("usual"), quality.row_count_anomaly(F.col("n"), usual).alias("odd"))


@query(f"""SELECT check_key, severity FROM (SELECT 'reconciliation.current_period_spend_unmapped' AS check_key, 'error' AS severity, cover < 80 AND spend > 0 AS hit FROM v UNION ALL SELECT 'reconciliation.ambiguous_campaigns', 'warning', doubt > 0 FROM v UNION ALL SELECT 'reconciliation.historical_campaigns_without_activity', 'info', old > 0 FROM v) x WHERE hit""".replace("FROM v", f"""FROM (SELECT sum(spend) AS spend, sum(spend) FILTER (campaign IN (SELECT source FROM mappings WHERE {OPERATIONAL})) / sum(spend) * 100 AS cover, count(DISTINCT campaign) FILTER (campaign IN (SELECT source FROM mappings WHERE status = 'ambiguous')) AS doubt,
(SELECT count(DISTINCT source) FROM mappings WHERE source NOT IN (SELECT campaign FROM delivery)) AS old FROM delivery) v"""), "delivery", "mappings")
def reconciliation_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about the account's coverage."""
    delivery, mappings = view(spark, sf_dir, "delivery"), view(spark, sf_dir, "mappings")
    states = campaigns.delivery_states(delivery, mappings)
    whole = states.agg(F.sum("spend").alias("spend"), (F.sum(F.when(F.col("state") == "mapped", F.col("spend"))) / F.sum("spend") * 100).alias("spend_coverage"), F.coalesce(F.sum(F.when(F.col("state") == "ambiguous", F.col("campaigns"))), F.lit(0)).alias("ambiguous"))
    old = mappings.select(F.col("source").alias("campaign")).distinct().join(delivery.select("campaign").distinct(), "campaign", "left_anti").agg(F.count("*").alias("historical"))
    return reconcile.health(whole.crossJoin(F.broadcast(old)).withColumn("unmapped_installs", F.lit(0)))


@query("""SELECT role, CASE role WHEN 0 THEN 'error' WHEN 1 THEN 'delayed' WHEN 2 THEN 'fresh' END AS status, latest_day, last_success, streams FROM (SELECT c_nationkey % 4 AS role, max(c_custkey) AS latest_day, min(c_custkey) AS last_success, count(*) AS streams FROM customer GROUP BY 1) x""")
def stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst state of each role's streams, their newest day, and the oldest of their last successes."""
    role, n = F.col("c_nationkey") % 4, F.col("c_custkey")
    status = F.when(role == 0, F.when(n % 3 == 0, "error").otherwise("stale")).when(role == 1, F.when(n % 2 == 0, "delayed").otherwise("not_supported")).when(role == 2, "fresh").otherwise("not_applicable")
    return runs.stream_context(_table(spark, sf_dir, "customer").select(role.alias("role"), status.alias("status"), n.alias("latest_day"), n.alias("last_success")))


@query("SELECT app, CASE WHEN zone = 'UTC' THEN DATE '2024-01-25' ELSE DATE '2024-01-24' END AS first, CASE WHEN zone = 'UTC' THEN DATE '2024-01-31' ELSE DATE '2024-01-30' END AS last FROM apps UNION ALL SELECT 'nowhere', DATE '2024-01-25', DATE '2024-01-31'", "apps")
def reporting_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days in each app's zone; an unknown zone is UTC."""
    apps = view(spark, sf_dir, "apps").unionByName(spark.sql("SELECT 'nowhere' AS app, 'Mars/Olympus' AS zone"))
    window = scalars.reporting_window(F.to_timestamp(F.lit("2024-01-31 02:00:00")), F.col("zone"))
    return apps.select("app", window["from"].alias("first"), window["to"].alias("last"))


@query("SELECT source, target, status FROM big_mappings ORDER BY status, target NULLS LAST, source LIMIT 1000", "big_mappings")
def mapping_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screen's list of mappings: by status, then name, a thousand at most."""
    return view(spark, sf_dir, "big_mappings").orderBy("status", F.col("target").asc_nulls_last(), "source").limit(1000).select("source", "target", "status")


@query("SELECT * FROM (SELECT run, data_type, status, finished_at FROM runs ORDER BY finished_at DESC, run LIMIT 20)".replace(", finished_at FROM", " , CAST(finished_at AS DATE) AS finished FROM"), "runs")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty runs."""
    return runs.recent(view(spark, sf_dir, "runs"), "finished_at", 20, "run").select("run", "data_type", "status", F.to_date("finished_at").alias("finished"))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'unconnected' WHEN c_custkey % 3 = 0 THEN 'never_synced' WHEN c_custkey % 2 = 0 THEN 'empty_range' END AS state FROM customer) x GROUP BY 1")
def empty_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").groupBy(runs.empty_state(n % 5 != 0, n % 3 != 0, n % 2).alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT app, CASE WHEN m IS NOT NULL AND a IS NOT NULL THEN m END AS marketing, CASE WHEN m IS NOT NULL AND a IS NOT NULL THEN a END AS attribution FROM (SELECT c_nationkey AS app, min(CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END) AS m, min(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name END) AS a FROM customer GROUP BY 1) x""")
def reconciliation_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The providers of an app to reconcile: none unless both roles are bound."""
    role = F.when(F.col("c_mktsegment") == "BUILDING", "marketing").when(F.col("c_mktsegment") == "MACHINERY", "attribution")
    return runs.target_of(_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("app"), role.alias("role"), F.col("c_name").alias("provider")))


@query("SELECT s_suppkey AS binding, n_name AS provider, CASE WHEN s_nationkey % 2 = 0 THEN r_name END AS account FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def bound_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings with their connection, and their account where there is one."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    bindings = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("binding"), F.col("s_nationkey").alias("connection"), F.when(F.col("s_nationkey") % 2 == 0, F.col("n_regionkey")).alias("account"))
    accounts = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("connection"), F.col("n_regionkey").alias("account"), F.col("r_name").alias("account_name"))
    out = runs.bound(bindings, nation.select(F.col("n_nationkey").alias("connection"), F.col("n_name").alias("provider")), accounts)
    return out.select("binding", "provider", F.col("account_name").alias("account"))


@query("""SELECT campaign, floor(sum(clicks) / sum(impressions) * 100 * 10 + 0.5) / 10 AS pct, left(sha256(campaign || '|'), 32) AS id, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies FROM (SELECT campaign, CAST(clicks AS DOUBLE) AS clicks, impressions, currency FROM delivery UNION ALL SELECT campaign, 0, 0, 'GBP' FROM delivery WHERE campaign = 'c1') x GROUP BY 1""", "delivery")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages to one place, stable ids and united currency sets."""
    rows = view(spark, sf_dir, "delivery").groupBy("campaign").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.collect_set("currency").alias("own"))
    extra = F.when(F.col("campaign") == "c1", F.array(F.lit("GBP")))
    return rows.select("campaign", scalars.pct(F.col("clicks"), F.col("impressions")).alias("pct"), scalars.stable_id(F.col("campaign"), F.lit(None)).alias("id"), F.array_join(scalars.merged_set(F.col("own"), extra), ",").alias("currencies"))


@query("SELECT c_custkey AS campaign, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) WHEN n > 0 THEN CAST(below AS DOUBLE) END AS daily, CASE WHEN c_acctbal > 0 THEN 'campaign' WHEN n > 0 THEN 'ad_groups' END AS source FROM customer LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS below, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def daily_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A campaign's own daily budget, else the sum of its ad groups'; sources hold them in hundredths."""
    cents = lambda c: (F.col(c).cast("decimal(20,2)") * 100).cast("decimal(20,0)").cast("string").alias("daily_budget")
    own = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("campaign"), cents("c_acctbal"))
    return files.budgets(own, _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("campaign"), cents("o_totalprice"))).withColumn("daily", F.col("daily").cast("double"))


@query("""SELECT 'order to customer' AS edge, count(c_custkey) AS linked, count(*) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
UNION ALL SELECT 'customer to nation', count(CASE WHEN c_nationkey % 4 > 0 THEN 1 END), count(*) FROM customer""")
def hierarchy_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows know their parent, for each edge of the hierarchy."""
    customer = _table(spark, sf_dir, "customer")
    orders = _table(spark, sf_dir, "orders").join(customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("parent"), F.col("c_custkey").alias("o_custkey")), "o_custkey", "left")
    return campaigns.hierarchy_completeness(("order to customer", orders, "parent"), ("customer to nation", customer.withColumn("up", F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey"))), "up"))


@query(f"""SELECT count(*) FILTER (status IN ('matched_exact', 'matched_confident', 'manually_verified')) / CAST(count(*) AS DOUBLE) AS authoritative, count(*) FILTER ({OPERATIONAL}) / CAST(count(*) AS DOUBLE) AS operational
FROM (SELECT DISTINCT ON (source) * FROM big_mappings ORDER BY source, confidence DESC, status, coalesce(target, '')) b""", "big_mappings")
def mapping_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of campaigns whose best mapping is authoritative, and operational."""
    return reconcile.authoritative_share(view(spark, sf_dir, "big_mappings"))


@query("SELECT app, CAST(timezone(zone, timezone('UTC', CAST(day AS TIMESTAMP) + INTERVAL 2 HOUR)) AS DATE) AS local_day, count(*) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d, apps GROUP BY 1, 2", "apps")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local date of instants in each app's zone."""
    instants = _table(spark, sf_dir, "events").select(F.to_timestamp(F.to_date("ts")).alias("at")).distinct().select((F.col("at") + F.expr("INTERVAL 2 HOUR")).alias("at"))
    rows = instants.join(F.broadcast(view(spark, sf_dir, "apps")), F.lit(True))
    return rows.groupBy("app", scalars.local_date(F.col("at"), F.col("zone")).alias("local_day")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER (near) AS near FROM (SELECT starts_with(a, substr(b, 1, CAST(greatest(8, floor(length(b) * 0.75)) AS INT))) OR starts_with(b, substr(a, 1, CAST(greatest(8, floor(length(a) * 0.75)) AS INT))) AS near
FROM (SELECT lower(p_name) AS a, lower(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' and some more words of it' WHEN p_partkey % 3 = 1 THEN 'x' ELSE '' END AS b FROM part) p) x""")
def near_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin alike, a diagnosis beside the deterministic rules."""
    n = F.col("p_partkey") % 3
    tail = F.when(n == 0, " and some more words of it").when(n == 1, "x").otherwise("")
    rows = _table(spark, sf_dir, "part").select(F.lower("p_name").alias("a"), F.concat(F.lower("p_name"), tail).alias("b"))
    return rows.agg(F.count("*").alias("n"), F.count_if(scalars.near_names(F.col("a"), F.col("b"))).alias("near"))


@query("SELECT count(*) FILTER (d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS n, count(*) FILTER (d NOT BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS skipped, min(d) FILTER (d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS from_date, max(d) FILTER (d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS to_date FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) x")
def covered_report_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report covers of the window that it was asked for."""
    return files.covered_window(_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")), "day", "1996-01-01", "1997-12-31")


@query("SELECT s_suppkey AS report FROM supplier WHERE s_nationkey % 3 > 0 ORDER BY s_nationkey % 5 DESC, s_acctbal > 0 DESC, s_suppkey % 2 = 0 DESC, s_suppkey % 3 = 0 DESC, s_nationkey DESC, s_acctbal DESC, s_suppkey LIMIT 1")
def chosen_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved report to use, by six keys."""
    s = _table(spark, sf_dir, "supplier")
    able, k = F.col("s_nationkey") % 3 > 0, F.col("s_suppkey")
    rows = s.select(k.alias("report"), able.alias("able"), (F.col("s_nationkey") % 5).alias("cohort_columns"), (F.col("s_acctbal") > 0).alias("has_revenue"), (k % 2 == 0).alias("by_campaign"), (k % 3 == 0).alias("by_country"), F.col("s_nationkey").alias("by_platform"), F.col("s_acctbal").alias("updated"))
    return files.best_report(rows).select("report")


@query("""SELECT channel, paid, count(*) AS n FROM (SELECT CASE media_source WHEN 'Organic' THEN 'organic' WHEN 'Facebook Ads' THEN 'paid_social' WHEN 'google adwords' THEN 'paid_search' WHEN 'tiktok_ads' THEN 'paid_social' ELSE 'unknown' END AS channel, media_source IN ('Facebook Ads', 'google adwords', 'tiktok_ads') AS paid FROM big_installs) x GROUP BY 1, 2""", "big_installs")
def paid_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which channels are paid, and that the list of sources of each channel agrees with the channel of each source."""
    rows = view(spark, sf_dir, "big_installs").withColumn("channel", scalars.media_channel(F.col("media_source")))
    return rows.groupBy("channel", scalars.is_paid_channel(F.col("channel")).alias("paid")).agg(F.count("*").alias("n"))
