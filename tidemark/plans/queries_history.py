"""Cohorts, merges, quality and decisions over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import cohorts, decisions, merge, quality
from tidemark.plans.bridge import held, view, with_views
from tidemark.plans.queries_metrics import OPERATIONAL, ORGANIC

QUERIES: dict = {}
ORACLE: dict = {}


def _views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def _as_of(spark: SparkSession, sf_dir: str):
    return cohorts.horizon(*_views(spark, sf_dir, "installs", "revenue")).scalar()


# Cohorts.
def data_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.horizon(*_views(spark, sf_dir, "installs", "revenue"))


ORACLE["data_horizon"] = with_views("SELECT CASE WHEN (SELECT count(*) FROM installs) > 0 AND (SELECT count(*) FROM revenue) > 0 THEN least((SELECT max(install_date) FROM installs), (SELECT max(event_date) FROM revenue)) END AS as_of", "installs", "revenue")


def revenue_covered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.covered_days(view(spark, sf_dir, "coverage"))


_DAYS = "SELECT day, max(finished) AS finished FROM (SELECT CAST(unnest(generate_series(from_date, to_date, INTERVAL 1 DAY)) AS DATE) AS day, finished FROM coverage) x GROUP BY 1"
ORACLE["revenue_covered_days"] = with_views(_DAYS, "coverage")
_FACTS = ("cohorts", "installs", "revenue", "delivery", "mappings", "coverage")
_MATURE = f""", days AS ({_DAYS}), h AS (SELECT least((SELECT max(install_date) FROM installs), (SELECT max(event_date) FROM revenue)) AS as_of), ages AS (SELECT 1 AS age UNION ALL SELECT 7), link AS (SELECT * FROM mappings WHERE {OPERATIONAL}),
spent AS (SELECT DISTINCT target, report_date FROM delivery JOIN link ON campaign = source WHERE spend > 0 AND target IS NOT NULL)"""
#: The window that rules judge.
WINDOW = ("2024-01-10", "2024-01-27")
_STATE = "install_date + age < as_of AS matured, coalesce(finished > install_date + age, FALSE) AS covered"
_ONCE = """(SELECT * FROM cohorts WHERE revenue_type <> 'total' UNION ALL SELECT * FROM cohorts t WHERE revenue_type = 'total' AND NOT EXISTS (SELECT 1 FROM cohorts p WHERE p.revenue_type IN ('iap', 'ad') AND p.install_date = t.install_date AND p.age = t.age AND p.media_source IS NOT DISTINCT FROM t.media_source
 AND p.campaign IS NOT DISTINCT FROM t.campaign AND p.country IS NOT DISTINCT FROM t.country AND p.platform = t.platform AND p.currency = t.currency))"""


def cohort_revenue_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, delivery, mappings, windows = _views(spark, sf_dir, "cohorts", "delivery", "mappings", "coverage")
    return cohorts.slices(rows, windows, mappings, delivery, _as_of(spark, sf_dir))


_SUM = "CAST(coalesce(sum(revenue) FILTER ({}), 0) AS DOUBLE) AS {}"
_RIPE = "matured AND covered AND read_after"
_SLICES = f"""x AS (SELECT c.*, {_STATE}, read_on > install_date + age AS read_after, {ORGANIC} AS organic, campaign IN (SELECT target FROM link WHERE target IS NOT NULL) AS mapped, s.target IS NOT NULL AS aligned
 FROM {_ONCE} c LEFT JOIN days ON install_date = day LEFT JOIN spent s ON s.target = c.campaign AND s.report_date = c.install_date, h),
y AS (SELECT *, revenue_type AS slice FROM x UNION ALL SELECT *, 'total' FROM x WHERE revenue_type <> 'total'),
z AS (SELECT age, slice, {", ".join(_SUM.format(*p) for p in ((_RIPE, "mature"), (f"{_RIPE} AND organic", "mature_organic"), (f"{_RIPE} AND NOT organic AND mapped", "mature_mapped"), (f"{_RIPE} AND NOT organic AND NOT mapped", "mature_unmapped"), (f"{_RIPE} AND NOT organic AND aligned", "aligned"), ("NOT matured", "immature"), ("matured AND NOT read_after", "early_read")))},
 count(DISTINCT currency) FILTER ({_RIPE}) AS currencies, count(DISTINCT currency) FILTER ({_RIPE} AND NOT organic AND aligned) AS aligned_currencies, count(*) FILTER (matured AND NOT read_after) AS early_read_rows FROM y GROUP BY 1, 2)"""
ORACLE["cohort_revenue_slices"] = with_views("", *_FACTS).rstrip() + _MATURE + ",\n" + _SLICES + "\nSELECT * FROM z"


def cohort_installs_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    installs, windows = _views(spark, sf_dir, "installs", "coverage")
    return cohorts.install_maturity(installs, windows, _as_of(spark, sf_dir))


_TAKEN = f"""q AS (SELECT *, {_STATE}, {ORGANIC} AS organic FROM installs, ages, h LEFT JOIN days ON install_date = day),
n AS (SELECT age, CAST(coalesce(sum(installs) FILTER (matured AND covered), 0) AS BIGINT) AS mature_installs, CAST(coalesce(sum(installs) FILTER (matured AND covered AND NOT organic), 0) AS BIGINT) AS paid_installs, CAST(coalesce(sum(installs) FILTER (matured AND covered AND organic), 0) AS BIGINT) AS organic_installs,
 count(DISTINCT install_date) FILTER (matured AND covered) AS mature_days, count(DISTINCT install_date) FILTER (NOT matured) AS immature_days, count(DISTINCT install_date) FILTER (matured AND NOT covered) AS uncovered_days FROM q GROUP BY 1)"""
ORACLE["cohort_installs_maturity"] = with_views("", *_FACTS).rstrip() + _MATURE + ",\n" + _TAKEN + "\nSELECT * FROM n"


def cohort_aligned_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivery, mappings, windows = _views(spark, sf_dir, "delivery", "mappings", "coverage")
    return cohorts.aligned_spend(delivery, mappings, windows, _as_of(spark, sf_dir))


_PAID = f"""p AS (SELECT age, CAST(sum(spend) AS DOUBLE) AS aligned_spend, count(DISTINCT currency) AS currencies, count(DISTINCT (campaign, install_date)) AS campaign_days FROM
 (SELECT *, {_STATE} FROM (SELECT *, report_date AS install_date FROM delivery WHERE campaign IN (SELECT source FROM link)) d, ages, h LEFT JOIN days ON install_date = day) w WHERE matured AND covered GROUP BY 1)"""
ORACLE["cohort_aligned_spend"] = with_views("", *_FACTS).rstrip() + _MATURE + ",\n" + _PAID + "\nSELECT * FROM p"


def cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, installs, delivery, mappings, windows = map(held, _views(spark, sf_dir, "cohorts", "installs", "delivery", "mappings", "coverage"))
    return cohorts.cohort_metrics(rows, installs, delivery, mappings, windows, _as_of(spark, sf_dir))


_RATIO = """SELECT 'cohort_' || CASE slice WHEN 'total' THEN '' ELSE slice || '_' END || '{kind}_d' || CAST(age AS STRING) AS metric, CASE WHEN blocked IS NULL AND {cur} <= 1 {good} THEN {value} END AS value,
CASE WHEN blocked IN ('provider_stale', 'immature_cohort') OR (blocked IS NULL AND {cur} > 1) THEN 'blocked' WHEN blocked IS NOT NULL OR NOT (TRUE {good}) THEN 'unavailable' WHEN {left} THEN 'partial' ELSE 'available' END AS availability,
CASE WHEN blocked IS NOT NULL THEN blocked WHEN {cur} > 1 THEN 'mixed_currency' {why} WHEN {left} THEN 'left_out' END AS reason FROM f"""
_GOOD = "AND {0} > 0 AND {0} >= {1}"
_WHY = "WHEN {0} <= 0 THEN 'missing_denominator' WHEN {0} < {1} THEN 'below_minimum'"
_OUT = "(young > 0 OR unread > 0 OR early > 0)"
ORACLE["cohort_metrics"] = (
    with_views("", *_FACTS).rstrip() + _MATURE + ",\n" + ",\n".join((_SLICES, _TAKEN, _PAID))
    + f""", rc AS (SELECT age, slice, count(DISTINCT currency) AS n FROM (SELECT age, slice, currency FROM y WHERE {_RIPE} AND NOT organic AND aligned UNION ALL SELECT age, slice, currency FROM
 (SELECT *, {_STATE} FROM (SELECT *, report_date AS install_date FROM delivery WHERE campaign IN (SELECT source FROM link)) d, ages, h LEFT JOIN days ON install_date = day) w, (SELECT unnest(['iap', 'ad', 'total']) AS slice) WHERE matured AND covered) u GROUP BY 1, 2),
f AS (SELECT g.slice, ages.age, coalesce(mature, 0) AS mature, coalesce(aligned, 0) AS aligned, coalesce(z.currencies, 0) AS currencies, coalesce(rc.n, 0) AS roas_currencies, CAST(coalesce(mature_installs, 0) AS DOUBLE) AS taken, coalesce(aligned_spend, 0) AS paid, coalesce(immature_days, 0) AS young, coalesce(uncovered_days, 0) AS unread,
 coalesce(early_read_rows, 0) AS early, coalesce(mature_unmapped, 0) AS unmapped, coalesce(mature_mapped, 0) AS mapped, CASE WHEN coalesce(mature_days + immature_days + uncovered_days, 0) = 0 THEN 'no_cohorts' WHEN mature_days = 0 AND uncovered_days > 0 THEN 'provider_stale' WHEN mature_days = 0 THEN 'immature_cohort' END AS blocked
 FROM ages CROSS JOIN (SELECT unnest(['iap', 'ad', 'total']) AS slice) g LEFT JOIN z ON z.age = ages.age AND z.slice = g.slice LEFT JOIN n ON n.age = ages.age LEFT JOIN p ON p.age = ages.age LEFT JOIN rc ON rc.age = ages.age AND rc.slice = g.slice)\n"""
    + "\nUNION ALL ".join((
        _RATIO.format(kind="revenue", value="mature", cur="currencies", good="", why="", left=_OUT),
        _RATIO.format(kind="rpi", value="mature / taken", cur="currencies", good=_GOOD.format("taken", 25), why=_WHY.format("taken", 25), left=_OUT),
        _RATIO.format(kind="roas", value="aligned / paid", cur="roas_currencies", good=_GOOD.format("paid", 1), why=_WHY.format("paid", 1), left=f"({_OUT} OR unmapped > 0 OR mapped > aligned)"),
    ))
)


def total_without_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider totals stay only where no component of the same cohort is there."""
    kept = cohorts.without_doubled_totals(view(spark, sf_dir, "cohorts"), cohorts.IDENTITY)
    return kept.groupBy("revenue_type", "country").agg(F.count("*").alias("n"), F.sum("revenue").cast("double").alias("revenue"))


ORACLE["total_without_components"] = with_views(f"SELECT revenue_type, country, count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS revenue FROM {_ONCE} x GROUP BY 1, 2", "cohorts")

# Merges.
_KEYS, _MEASURES = ["campaign", "report_date", "country"], ["spend", "clicks"]


def fact_merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, written = _views(spark, sf_dir, "stored", "written")
    return merge.outcomes(merge.merge_facts(stored, written, _KEYS, _MEASURES))


_ON = "s.campaign = w.campaign AND s.report_date = w.report_date AND s.country = w.country"
ORACLE["fact_merge_outcomes"] = with_views(f"""SELECT CASE WHEN w.campaign IS NULL THEN 'kept' WHEN s.campaign IS NULL THEN 'inserted' WHEN s.spend <> w.spend OR s.clicks <> w.clicks THEN 'restated' ELSE 'unchanged' END AS outcome, count(*) AS n
FROM stored s FULL JOIN written w ON {_ON} GROUP BY 1""", "stored", "written")


def supersede_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, written = _views(spark, sf_dir, "stored", "written")
    gone = merge.superseded(stored, written, ["campaign", "report_date"], _KEYS)
    return gone.groupBy("campaign").agg(F.count("*").alias("n"), F.sum("spend").cast("double").alias("spend"))


ORACLE["supersede_dimensions"] = with_views("""SELECT campaign, count(*) AS n, CAST(sum(spend) AS DOUBLE) AS spend FROM stored s WHERE EXISTS (SELECT 1 FROM written w WHERE w.campaign = s.campaign AND w.report_date = s.report_date)
AND NOT EXISTS (SELECT 1 FROM written w WHERE w.campaign = s.campaign AND w.report_date = s.report_date AND w.country = s.country) GROUP BY 1""", "stored", "written")


def restated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, written = _views(spark, sf_dir, "stored", "written")
    after = merge.restate(stored, written, ["campaign", "report_date"], _KEYS, _MEASURES)
    return after.groupBy("campaign").agg(F.count("*").alias("n"), F.sum("spend").cast("double").alias("spend"), F.sum("clicks").alias("clicks"))


ORACLE["restated_table"] = with_views("""SELECT campaign, count(*) AS n, CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(clicks) AS BIGINT) AS clicks FROM (SELECT * FROM written UNION ALL
SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM written w WHERE w.campaign = s.campaign AND w.report_date = s.report_date)) x GROUP BY 1""", "stored", "written")


def raw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by digest of their payload: those not stored yet, each once."""
    pages = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.sha2("props", 256).alias("payload_hash"), F.col("user_id").alias("page"))
    stored = pages.filter("event_type = 'view'").select("payload_hash")
    return merge.append_new(stored, pages.filter("event_type <> 'view'"), ["payload_hash"]).agg(F.count("*").alias("n"), F.count_distinct("payload_hash").alias("hashes"))


ORACLE["raw_dedup"] = "SELECT count(DISTINCT props) AS n, count(DISTINCT props) AS hashes FROM events WHERE event_type <> 'view' AND props NOT IN (SELECT props FROM events WHERE event_type = 'view')"


def dimension_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "cohorts")
    return rows.select(scalars.dimension_hash({c: F.col(c) for c in ("install_date", "campaign", "country", "platform", "media_source", "revenue_type", "currency")}, {"age": F.when(F.col("age") == 7, F.col("age"))}).alias("hash"))


ORACLE["dimension_hash"] = with_views("""SELECT sha256(CASE WHEN age = 7 THEN 'age=7|' ELSE '' END || 'campaign=' || campaign || '|country=' || country || '|currency=' || currency || '|install_date=' || CAST(install_date AS STRING) || '|media_source=' || coalesce(media_source, '')
|| '|platform=' || platform || '|revenue_type=' || revenue_type) AS hash FROM cohorts""", "cohorts")

_ERRORS = """SELECT event_id AS error, CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'invalid_request' END AS error_class, CAST(ts AS DATE) AS from_date, CAST(ts AS DATE) + CAST(event_id % 3 AS INT) AS to_date, CAST(ts AS DATE) AS occurred FROM events WHERE event_type = 'error'"""
_RUNS = """SELECT CAST(a AS DATE) AS from_date, CAST(b AS DATE) AS to_date, CAST(c AS DATE) AS finished FROM (VALUES ('2024-01-01', '2024-01-07', '2024-01-05'), ('2024-01-05', '2024-01-06', '2024-01-20'), ('2024-01-08', '2024-01-20', '2024-01-31')) AS w(a, b, c)"""


def error_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = spark.sql(_ERRORS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return merge.open_errors(errors, spark.sql(_RUNS)).groupBy("error_class", "from_date").agg(F.count("*").alias("n"))


ORACLE["error_supersession"] = f"""SELECT error_class, from_date, count(*) AS n FROM ({_ERRORS}) e WHERE NOT EXISTS (SELECT 1 FROM ({_RUNS}) r WHERE r.finished > e.occurred AND CASE WHEN error_class = 'timeout' THEN r.from_date <= e.from_date AND r.to_date >= e.to_date
ELSE r.from_date = e.from_date AND r.to_date = e.to_date END) GROUP BY 1, 2"""


def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each event type's stream at a fixed instant."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    streams = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    minutes = F.floor(scalars.minutes_since(F.col("last"), now)).cast("long")
    age = F.date_diff(F.to_date(now), F.to_date("last"))
    return streams.select("event_type", minutes.alias("minutes"), scalars.freshness(F.lit(True), F.col("event_type") == "error", minutes, F.lit(240), age).alias("status"))


ORACLE["freshness_status"] = """SELECT event_type, minutes, CASE WHEN event_type = 'error' THEN 'error' WHEN minutes > 720 OR age >= 3 THEN 'stale' WHEN age = 2 OR minutes > 240 THEN 'delayed' ELSE 'fresh' END AS status
FROM (SELECT event_type, CAST(floor(epoch(TIMESTAMP '2024-01-30 12:00:00' - date_trunc('second', max(ts))) / 60) AS BIGINT) AS minutes, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-30') AS age FROM events GROUP BY 1) x"""


# Quality.
def quality_marketing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = view(spark, sf_dir, "delivery").withColumn("currency", F.when(F.col("campaign") == "c1", "usd").otherwise(F.col("currency")))
    found = quality.check_marketing(batch, "2024-01-02", "2024-01-28", ["report_date", "campaign", "country", "platform"])
    return found.groupBy("check_key", "severity", "day").agg(F.count("*").alias("n"))


ORACLE["quality_marketing_checks"] = with_views("""SELECT k AS check_key, CASE WHEN k = 'marketing.negative_measure' THEN 'error' ELSE 'warning' END AS severity, report_date AS day, count(*) AS n FROM (
SELECT 'marketing.date_outside_window' AS k, report_date FROM delivery WHERE report_date NOT BETWEEN '2024-01-02' AND '2024-01-28' UNION ALL SELECT 'marketing.negative_measure', report_date FROM delivery WHERE spend < 0
UNION ALL SELECT 'marketing.clicks_exceed_impressions', report_date FROM delivery WHERE impressions > 0 AND clicks > impressions * 2 UNION ALL SELECT 'marketing.spend_without_delivery', report_date FROM delivery WHERE spend > 0 AND impressions = 0 AND clicks = 0
UNION ALL SELECT 'marketing.invalid_currency', report_date FROM delivery WHERE campaign = 'c1') x GROUP BY 1, 2, 3""", "delivery")


def quality_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]).groupBy("extra").agg(F.count("*").alias("n"))


ORACLE["quality_duplicates"] = "SELECT extra, count(*) AS n FROM (SELECT count(*) - 1 AS extra FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x GROUP BY 1"


def quality_cohort_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts after one age-seven row in three lost half its revenue."""
    rows = view(spark, sf_dir, "cohorts")
    cut = F.when((F.col("age") == 7) & (F.dayofmonth("install_date") % 3 == 0), F.col("revenue") / 2).otherwise(F.col("revenue")).cast("decimal(20,6)")
    found = quality.not_cumulative(rows.withColumn("revenue", cut), ["install_date", "campaign", "country", "platform", "media_source", "revenue_type", "currency"])
    return found.groupBy("install_date").agg(F.count("*").alias("n"))


ORACLE["quality_cohort_monotone"] = with_views("""SELECT install_date, count(*) AS n FROM (SELECT install_date, revenue, lag(revenue) OVER (PARTITION BY install_date, campaign, country, platform, media_source, revenue_type, currency ORDER BY age) AS before
FROM (SELECT * REPLACE (CAST(CASE WHEN age = 7 AND day(install_date) % 3 = 0 THEN revenue / 2 ELSE revenue END AS DECIMAL(20,6)) AS revenue) FROM cohorts) c) x WHERE revenue < before GROUP BY 1""", "cohorts")


# Decisions.
def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, metric, day, value: dense spend, installs and revenue by campaign (attribution ids under their campaign's number)."""
    delivery, installs, revenue = _views(spark, sf_dir, "delivery", "installs", "revenue")
    last = delivery.agg(F.max("report_date")).scalar()
    own = lambda c: F.concat(F.lit("c"), F.substr(c, F.lit(2)))
    out = None
    for metric, rows in (
        ("spend", delivery.select("campaign", F.col("report_date").alias("day"), F.col("spend").alias("value"))),
        ("installs", installs.select(own("campaign").alias("campaign"), F.col("install_date").alias("day"), F.col("installs").cast("decimal(20,6)").alias("value"))),
        ("revenue", revenue.select(own("campaign").alias("campaign"), F.col("event_date").alias("day"), F.col("revenue").alias("value"))),
    ):
        sums = rows.groupBy("campaign", "day").agg(F.sum("value").cast("decimal(20,6)").alias("value"))
        one = decisions.dense_days(sums, ["value"], last).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return out


_SERIES = """, raw AS (SELECT campaign, 'spend' AS metric, report_date AS day, sum(spend) AS value FROM delivery GROUP BY 1, 3 UNION ALL SELECT 'c' || substr(campaign, 2), 'installs', install_date, sum(installs) FROM installs GROUP BY 1, 3
UNION ALL SELECT 'c' || substr(campaign, 2), 'revenue', event_date, sum(revenue) FROM revenue GROUP BY 1, 3),
span AS (SELECT campaign, metric, min(day) AS first FROM raw WHERE value > 0 GROUP BY 1, 2),
s AS (SELECT g.campaign, g.metric, g.day, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM (SELECT campaign, metric, CAST(unnest(generate_series(first, (SELECT max(report_date) FROM delivery), INTERVAL 1 DAY)) AS DATE) AS day FROM span) g LEFT JOIN raw r ON r.campaign = g.campaign AND r.metric = g.metric AND r.day = g.day)"""
_DELIVERED = ("delivery", "installs", "revenue")


def dense_campaign_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("campaign", "metric", "day", F.col("value").cast("double").alias("value"))


ORACLE["dense_campaign_days"] = with_views("", *_DELIVERED).rstrip() + _SERIES + "\nSELECT * FROM s"


def anomaly_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the window only; those before it are history."""
    return decisions.anomalies(_series(spark, sf_dir), first=F.lit(WINDOW[0]).cast("date"), last=F.lit(WINDOW[1]).cast("date"))


_FOUND = """, h AS (SELECT a.campaign, a.metric, a.day, any_value(a.value) AS v, median(b.value) AS c, count(*) AS points, list(b.value) AS l FROM s a JOIN s b ON a.campaign = b.campaign AND a.metric = b.metric AND b.day BETWEEN a.day - 14 AND a.day - 1 GROUP BY 1, 2, 3 HAVING count(*) >= 7),
k AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - c)), 'median') AS m, abs(v - c) AS size FROM h),
found AS (SELECT campaign, metric, day, floor(v * 1e6 + 0.5) / 1e6 AS value, floor(c * 1e6 + 0.5) / 1e6 AS center, floor(m * 1e6 + 0.5) / 1e6 AS mad, CAST(points AS INT) AS points, CASE WHEN m > 0 THEN floor(size / (1.4826::DOUBLE * m) * 1e3 + 0.5) / 1e3 END AS z,
 CASE WHEN c > 0 THEN floor((v - c) / c * 100 * 1e4 + 0.5) / 1e4 END AS deviation_pct, CASE WHEN v > c THEN 'up' ELSE 'down' END AS direction FROM k WHERE size >= 20 AND (c <= 0 OR size >= 0.3::DOUBLE * c) AND (m = 0 OR size / (1.4826::DOUBLE * m) >= 3.5))"""
ORACLE["anomaly_detect"] = with_views("", *_DELIVERED).rstrip() + _SERIES + _FOUND + f"\nSELECT * FROM found WHERE day BETWEEN '{WINDOW[0]}' AND '{WINDOW[1]}'"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some days that a sync error, a gap or a finding touches."""
    days = view(spark, sf_dir, "delivery").select(F.col("report_date").alias("day")).distinct()
    n = F.dayofmonth("day")
    return days.select("day", (n % 7 == 0).alias("sync_error"), (n % 11 == 0).alias("uncovered"), (n % 5 == 0).alias("finding"))


def anomaly_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions.classify(decisions.anomalies(_series(spark, sf_dir), floor=5), _signals(spark, sf_dir), "fresh")
    return rows.select("campaign", "metric", "day", "direction", "class")


_CLASSES = """, marked AS (SELECT f.*, day(day) % 7 = 0 OR day(day) % 11 = 0 AS gap, day(day) % 5 = 0 AS finding, bool_or(metric = 'spend') OVER w AS sm, bool_or(metric = 'installs') OVER w AS im FROM found f WINDOW w AS (PARTITION BY campaign, day, direction))
SELECT campaign, metric, day, direction, CASE WHEN metric = 'spend' THEN 'delivery' WHEN gap THEN 'data_gap' WHEN metric = 'installs' THEN CASE WHEN sm THEN 'delivery' WHEN finding THEN 'attribution' ELSE 'undetermined' END
WHEN im THEN CASE WHEN sm THEN 'delivery' WHEN finding THEN 'attribution' ELSE 'undetermined' END WHEN sm THEN 'delivery' WHEN finding THEN 'attribution' ELSE 'monetization' END AS class FROM marked"""
ORACLE["anomaly_classify"] = with_views("", *_DELIVERED).rstrip() + _SERIES + _FOUND.replace("size >= 20", "size >= 5") + _CLASSES


def pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = view(spark, sf_dir, "delivery").select("campaign", F.col("report_date").alias("day"), "spend", "currency")
    number = F.substr("campaign", F.lit(2)).cast("int")
    budgets = days.select("campaign").distinct().filter(number != 7).select("campaign", (number * 40 + 10).cast("decimal(20,6)").alias("daily"), F.lit("USD").alias("budget_currency"))
    return decisions.pacing(days, budgets)


ORACLE["pacing"] = with_views("""SELECT campaign, spend, delivered_days, average_spend, ratio, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio < 0.5 THEN 'under' WHEN ratio > 1.25 THEN 'over' ELSE 'on' END AS status, reason FROM (
SELECT *, CASE WHEN reason IS NULL THEN floor(average_spend / daily * 1e4 + 0.5) / 1e4 END AS ratio FROM (SELECT *, CASE WHEN delivered_days = 0 THEN 'not_delivered' WHEN daily IS NULL THEN 'no_budget' WHEN currencies > 1 OR cur <> 'USD' THEN 'mixed_currency' END AS reason FROM (
SELECT campaign, CAST(sum(spend) AS DOUBLE) AS spend, count(DISTINCT report_date) FILTER (spend > 0) AS delivered_days, count(DISTINCT currency) FILTER (spend > 0) AS currencies, min(currency) FILTER (spend > 0) AS cur,
CASE WHEN count(*) FILTER (spend > 0) > 0 THEN floor(CAST(sum(spend) AS DOUBLE) / count(DISTINCT report_date) FILTER (spend > 0) * 1e6 + 0.5) / 1e6 END AS average_spend,
CASE WHEN campaign <> 'c7' THEN CAST(CAST(substr(campaign, 2) AS INT) * 40 + 10 AS DOUBLE) END AS daily FROM delivery GROUP BY campaign) a) b) c""", "delivery")


def _trend_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivery, revenue = _views(spark, sf_dir, "delivery", "revenue")
    earned = revenue.groupBy(F.concat(F.lit("c"), F.substr("campaign", F.lit(2))).alias("campaign"), F.col("event_date").alias("day")).agg(F.sum("revenue").alias("numerator"))
    spent = delivery.groupBy("campaign", F.col("report_date").alias("day")).agg(F.sum("spend").alias("denominator"), F.sum("clicks").alias("installs"))
    return spent.join(earned, ["campaign", "day"], "left").select("campaign", "day", F.coalesce("numerator", F.lit(0)).alias("numerator"), "denominator", "installs", (F.col("denominator") > 0).alias("eligible"))


def trend_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.trend(_trend_days(spark, sf_dir))


_TREND = """, t AS (SELECT d.campaign, d.day, coalesce(numerator, 0) AS numerator, denominator, installs, row_number() OVER (PARTITION BY d.campaign ORDER BY d.day DESC) AS place FROM (SELECT campaign, report_date AS day, sum(spend) AS denominator, sum(clicks) AS installs FROM delivery GROUP BY 1, 2 HAVING sum(spend) > 0) d
LEFT JOIN (SELECT 'c' || substr(campaign, 2) AS campaign, event_date AS day, sum(revenue) AS numerator FROM revenue GROUP BY 1, 2) r ON r.campaign = d.campaign AND r.day = d.day),
hv AS (SELECT campaign, CASE WHEN place <= 7 THEN 1 ELSE 2 END AS half, count(*) AS n, CASE WHEN count(*) = 7 AND sum(denominator) >= 50 AND sum(installs) >= 25 THEN floor(CAST(sum(numerator) AS DOUBLE) / CAST(sum(denominator) AS DOUBLE) * 1e6 + 0.5) / 1e6 END AS v FROM t WHERE place <= 14 GROUP BY 1, 2),
tr AS (SELECT campaign, coalesce(max(n) FILTER (half = 1), 0) AS now_days, coalesce(max(n) FILTER (half = 2), 0) AS before_days, max(v) FILTER (half = 1) AS now, max(v) FILTER (half = 2) AS before FROM hv GROUP BY 1),
tc AS (SELECT *, CASE WHEN before > 0 THEN floor((now - before) / before * 100 * 1e4 + 0.5) / 1e4 END AS change_pct FROM tr),
td AS (SELECT *, CASE WHEN change_pct IS NULL THEN 'unknown' WHEN abs(change_pct) < 20 THEN 'stable' WHEN change_pct > 0 THEN 'improving' ELSE 'deteriorating' END AS direction FROM tc)"""
ORACLE["trend_halves"] = with_views("", "delivery", "revenue").rstrip() + _TREND + "\nSELECT * FROM td"


covered_sql, once_sql = _DAYS, _ONCE

QUERIES |= {f.__name__: f for f in (
    data_horizon, revenue_covered_days, cohort_revenue_slices, cohort_installs_maturity, cohort_aligned_spend, cohort_metrics, total_without_components, fact_merge_outcomes, supersede_dimensions, restated_table, raw_dedup, dimension_hash,
    error_supersession, freshness_status, quality_marketing_checks, quality_duplicates, quality_cohort_monotone, dense_campaign_days, anomaly_detect, anomaly_classify, pacing, trend_halves,
)}
