"""Campaign-day facts, run windows, anomalies of linked series and the decision set, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import cohorts, decisions, facts, metrics, runs
from tidemark.plans.bridge import held, view, with_views
from tidemark.plans.queries_history import WINDOW, covered_sql, once_sql
from tidemark.plans.queries_metrics import LIVE, OPERATIONAL, ORGANIC

QUERIES: dict = {}
ORACLE: dict = {}
_IN = f"BETWEEN '{WINDOW[0]}' AND '{WINDOW[1]}'"
_INPUTS = ("delivery", "installs", "revenue", "cohorts", "mappings", "coverage", "apps", "runs", "run_errors", "findings")
TYPES = ("marketing_performance", "attribution_installs", "attribution_revenue")
#: Targets of the registered readings: a return at age seven, and a ceiling of cost alone.
RETURN = decisions.Policy(target_d7=0.6, target_d1=0.3, currency="USD", capabilities=frozenset({("total", 7), ("iap", 7), ("iap", 1)}))
COST = decisions.Policy(max_cpi=60.0, currency="USD")


def _inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) for n in _INPUTS}


def _window():
    return tuple(F.lit(d).cast("date") for d in WINDOW)


def _as_of(t: dict[str, DataFrame]):
    return cohorts.horizon(t["installs"], t["revenue"]).scalar()


def _days(t: dict[str, DataFrame], age: int = 7) -> DataFrame:
    return facts.campaign_days(t["delivery"], t["installs"], t["cohorts"], t["mappings"], t["coverage"], _as_of(t), age)


def _shown(days: DataFrame, *keys: str) -> DataFrame:
    money = [F.col(c).cast("double").alias(c) for c in ("spend", "revenue_iap", "revenue_ad", "revenue_total")]
    sets = [F.array_join(c, ",").alias(c) for c in ("spend_currencies", "currencies_total")]
    return days.select(*keys, *money, "impressions", "clicks", "installs", "aligned_installs", "early_rows", *sets, "old_enough", "covered")


def campaign_day_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_days(_inputs(spark, sf_dir)), "campaign", "day")


def app_day_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _inputs(spark, sf_dir)
    return _shown(facts.app_days(_days(t), facts.mapping_state(t["mappings"]), t["coverage"], _as_of(t), 7), "day")


_LINKS = f"""cov AS ({covered_sql}), h AS (SELECT least((SELECT max(install_date) FROM installs), (SELECT max(event_date) FROM revenue)) AS as_of),
lk AS (SELECT DISTINCT ON (target) target AS attribution, source AS campaign FROM mappings WHERE {OPERATIONAL} AND target IS NOT NULL ORDER BY target, confidence DESC, source),
st AS (SELECT source AS campaign, first(status ORDER BY ({OPERATIONAL} AND target IS NOT NULL) DESC, confidence DESC, status, coalesce(target, '')) AS mapping_status, first(method ORDER BY ({OPERATIONAL} AND target IS NOT NULL) DESC, confidence DESC, status, coalesce(target, '')) AS mapping_method,
 first(confidence ORDER BY ({OPERATIONAL} AND target IS NOT NULL) DESC, confidence DESC, status, coalesce(target, '')) AS mapping_confidence, bool_or({OPERATIONAL} AND target IS NOT NULL) AS operational, bool_or(status = 'ambiguous') AND NOT bool_or({OPERATIONAL} AND target IS NOT NULL) AS ambiguous FROM mappings GROUP BY 1),
dd AS (SELECT campaign, report_date AS day, sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks, coalesce(list_sort(list(DISTINCT currency) FILTER (spend > 0)), []) AS spend_currencies FROM delivery GROUP BY 1, 2),
li AS (SELECT lk.campaign, install_date AS day, sum(installs) AS installs FROM installs i JOIN lk ON attribution = i.campaign WHERE NOT {ORGANIC} GROUP BY 1, 2),
lr AS (SELECT lk.campaign, event_date AS day, sum(revenue) AS revenue FROM revenue r JOIN lk ON attribution = r.campaign WHERE NOT {ORGANIC} GROUP BY 1, 2),
lc AS (SELECT lk.campaign, install_date AS day, age, coalesce(sum(revenue) FILTER (ripe AND revenue_type = 'iap'), 0) AS revenue_iap, coalesce(sum(revenue) FILTER (ripe AND revenue_type = 'ad'), 0) AS revenue_ad, coalesce(sum(revenue) FILTER (ripe), 0) AS revenue_total,
 coalesce(list_sort(list(DISTINCT currency) FILTER (ripe)), []) AS currencies_total, count(*) FILTER (early) AS early_rows FROM (SELECT c.*, install_date + age < as_of AND coalesce(finished > install_date + age, FALSE) AND read_on > install_date + age AS ripe, install_date + age < as_of AND read_on <= install_date + age AS early
 FROM {once_sql} c LEFT JOIN cov ON install_date = cov.day, h) c JOIN lk ON attribution = c.campaign WHERE NOT {ORGANIC} AND age = 7 GROUP BY 1, 2, 3),
f0 AS (SELECT campaign, day, coalesce(spend, 0) AS spend, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks, coalesce(installs, 0) AS installs, coalesce(revenue_iap, 0) AS revenue_iap, coalesce(revenue_ad, 0) AS revenue_ad, coalesce(revenue_total, 0) AS revenue_total, coalesce(early_rows, 0) AS early_rows,
 coalesce(spend_currencies, []) AS spend_currencies, coalesce(currencies_total, []) AS currencies_total FROM dd FULL JOIN li USING (campaign, day) FULL JOIN lc USING (campaign, day)),
fd AS (SELECT f0.*, CASE WHEN spend > 0 THEN installs ELSE 0 END AS aligned_installs, coalesce(day + 7 < as_of, FALSE) AS old_enough, coalesce(finished > day + 7, FALSE) AS covered FROM f0 LEFT JOIN cov USING (day), h),
ad AS (SELECT day, sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks, sum(installs) AS installs, sum(aligned_installs) AS aligned_installs, coalesce(sum(revenue_iap) FILTER (spend > 0), 0) AS revenue_iap, coalesce(sum(revenue_ad) FILTER (spend > 0), 0) AS revenue_ad, coalesce(sum(revenue_total) FILTER (spend > 0), 0) AS revenue_total,
 coalesce(sum(early_rows) FILTER (spend > 0), 0) AS early_rows, list_sort(list_distinct(flatten(list(spend_currencies)))) AS spend_currencies, coalesce(list_sort(list_distinct(flatten(list(currencies_total) FILTER (spend > 0)))), []) AS currencies_total, any_value(old_enough) AS old_enough, any_value(covered) AS covered FROM fd JOIN st USING (campaign) WHERE operational GROUP BY 1)"""
_SHOWN = "CAST(spend AS DOUBLE) AS spend, CAST(revenue_iap AS DOUBLE) AS revenue_iap, CAST(revenue_ad AS DOUBLE) AS revenue_ad, CAST(revenue_total AS DOUBLE) AS revenue_total, CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks, CAST(installs AS BIGINT) AS installs, CAST(aligned_installs AS BIGINT) AS aligned_installs, CAST(early_rows AS BIGINT) AS early_rows, array_to_string(spend_currencies, ',') AS spend_currencies, array_to_string(currencies_total, ',') AS currencies_total, old_enough, covered"
_BASE = ("delivery", "installs", "revenue", "cohorts", "mappings", "coverage")


def _sql(text: str, *views: str) -> str:
    return with_views("", *views).rstrip() + ", " + text


ORACLE["campaign_day_facts"] = _sql(_LINKS + f"\nSELECT campaign, day, {_SHOWN} FROM fd", *_BASE)
ORACLE["app_day_rollup"] = _sql(_LINKS + f"\nSELECT day, {_SHOWN} FROM ad", *_BASE)


def linked_daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.linked_revenue(view(spark, sf_dir, "revenue"), view(spark, sf_dir, "mappings")).withColumn("revenue", F.col("revenue").cast("double"))


ORACLE["linked_daily_revenue"] = _sql(_LINKS + "\nSELECT campaign, day, CAST(revenue AS DOUBLE) AS revenue FROM lr", *_BASE)


def lifetime_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.lifetime_spend(view(spark, sf_dir, "big_delivery")).withColumn("spent_to_date", F.col("spent_to_date").cast("double"))


ORACLE["lifetime_spend"] = with_views("SELECT campaign, CAST(sum(spend) AS DOUBLE) AS spent_to_date FROM big_delivery GROUP BY 1", "big_delivery")


def mapping_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts.mapping_state(view(spark, sf_dir, "mappings"))
    return out.withColumn("targets", F.array_join("targets", ","))


ORACLE["mapping_states"] = with_views(f"""SELECT source AS campaign, first(status ORDER BY u DESC, confidence DESC, status) AS mapping_status, first(method ORDER BY u DESC, confidence DESC, status) AS mapping_method, first(confidence ORDER BY u DESC, confidence DESC, status) AS mapping_confidence,
bool_or(u) AS operational, bool_or(status = 'ambiguous') AND NOT bool_or(u) AS ambiguous, coalesce(string_agg(target, ',' ORDER BY target) FILTER (u), '') AS targets FROM (SELECT *, {OPERATIONAL} AND target IS NOT NULL AS u FROM mappings) m GROUP BY 1""", "mappings")


# Runs.
def run_data_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.data_windows(view(spark, sf_dir, "runs"), view(spark, sf_dir, "apps"))


_DONE = "status IN ('completed', 'partially_completed')"
_RUNS = f"""dw AS (SELECT run, r.app, data_type, CAST(w->>'from' AS DATE) AS from_date, CAST(w->>'to' AS DATE) AS to_date, CAST(timezone(zone, timezone('UTC', finished_at)) AS DATE) AS finished
 FROM (SELECT *, unnest(CAST(json_extract(checkpoint, '$.dataWindows') AS JSON[])) AS w FROM runs WHERE {_DONE}) r JOIN apps a ON a.app = r.app),
cw AS (SELECT run, app, connection, data_type, finished_at, CAST(split_part(k, '..', 1) AS DATE) AS from_date, CAST(split_part(k, '..', 2) AS DATE) AS to_date FROM (SELECT *, unnest(CAST(json_extract(checkpoint, '$.completedWindows') AS VARCHAR[])) AS k FROM runs WHERE {_DONE}) r
 UNION ALL SELECT run, app, connection, data_type, finished_at, window_start, window_end FROM runs WHERE status = 'completed'),
cf AS (SELECT f.*, r.connection, r.data_type FROM findings f LEFT JOIN runs r ON r.run = f.run WHERE NOT EXISTS (SELECT 1 FROM runs l WHERE l.connection = r.connection AND l.data_type = r.data_type AND l.{_DONE} AND l.finished_at > f.created_at
 AND (f.observed IS NULL OR EXISTS (SELECT 1 FROM cw WHERE cw.run = l.run AND f.observed BETWEEN cw.from_date AND cw.to_date)))),
oe AS (SELECT e.*, r.app, r.data_type, r.status FROM run_errors e JOIN runs r ON r.run = e.run WHERE resolved_at IS NULL),
sg AS (SELECT day, EXISTS (SELECT 1 FROM oe WHERE (window_start IS NULL OR window_start <= day) AND (window_end IS NULL OR day <= window_end)) AS sync_error, NOT EXISTS (SELECT 1 FROM cw WHERE data_type = 'attribution_installs' AND day BETWEEN from_date AND to_date) AS uncovered,
 EXISTS (SELECT 1 FROM cf WHERE observed = day AND severity <> 'info' AND check_key NOT IN ('attribution.missing_campaign_id', 'marketing.missing_campaign_id') AND check_key NOT LIKE 'reconciliation.%') AS finding FROM (SELECT DISTINCT report_date AS day FROM delivery) d)"""
_RUN_VIEWS = ("delivery", "runs", "apps", "run_errors", "findings")
ORACLE["run_data_windows"] = _sql(_RUNS + "\nSELECT * FROM dw", *_RUN_VIEWS)


def run_completed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.completed_windows(view(spark, sf_dir, "runs")).drop("finished_at")


ORACLE["run_completed_windows"] = _sql(_RUNS + "\nSELECT run, app, connection, data_type, from_date, to_date FROM cw", *_RUN_VIEWS)


def current_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.current_findings(view(spark, sf_dir, "findings"), view(spark, sf_dir, "runs")).select("run", "check_key", "severity", "observed", "connection", "data_type")


ORACLE["current_findings"] = _sql(_RUNS + "\nSELECT run, check_key, severity, observed, connection, data_type FROM cf", *_RUN_VIEWS)


def open_run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_errors(view(spark, sf_dir, "run_errors"), view(spark, sf_dir, "runs"), TYPES).drop("resolved_at")


ORACLE["open_run_errors"] = _sql(_RUNS + "\nSELECT run, window_start, window_end, app, data_type, status FROM oe", *_RUN_VIEWS)


def _signals(t: dict[str, DataFrame]) -> DataFrame:
    days = t["delivery"].select(F.col("report_date").alias("day")).distinct()
    read = runs.completed_windows(t["runs"]).filter("data_type = 'attribution_installs'")
    return runs.day_signals(days, runs.run_errors(t["run_errors"], t["runs"], TYPES), read, runs.current_findings(t["findings"], t["runs"]))


def day_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(_inputs(spark, sf_dir))


ORACLE["day_signals"] = _sql(_RUNS + "\nSELECT * FROM sg", *_RUN_VIEWS)


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.current_findings(view(spark, sf_dir, "findings"), view(spark, sf_dir, "runs"))
    return runs.finding_counts(found, *_window())


ORACLE["finding_counts"] = _sql(_RUNS + f"\nSELECT check_key, severity, count(*) AS n FROM cf WHERE (observed IS NULL OR observed {_IN}) AND check_key NOT IN ('attribution.missing_campaign_id', 'marketing.missing_campaign_id') GROUP BY 1, 2", *_RUN_VIEWS)


# Anomalies of linked series, and decisions.
def _scopes(t: dict[str, DataFrame], age: int) -> tuple[DataFrame, DataFrame]:
    """The days of all scopes (the app is called app), and their event revenue by day."""
    # Both are used many times from here on.
    days, state = held(_days(t, age)), facts.mapping_state(t["mappings"])
    app = facts.app_days(days, state, t["coverage"], _as_of(t), age).withColumn("campaign", F.lit("app"))
    earned = held(facts.linked_revenue(t["revenue"], t["mappings"]))
    whole = earned.join(state.filter("operational").select("campaign"), "campaign").groupBy("day").agg(F.sum("revenue").alias("revenue")).withColumn("campaign", F.lit("app"))
    return days.unionByName(app), earned.unionByName(whole)


def _anomalies(t: dict[str, DataFrame], days: DataFrame, earned: DataFrame, freshness: str | None = "fresh") -> DataFrame:
    ends = {"spend": t["delivery"].agg(F.max("report_date")).scalar(), "installs": t["installs"].agg(F.max("install_date")).scalar(), "revenue": t["revenue"].agg(F.max("event_date")).scalar()}
    found = decisions.anomalies(facts.series(days, earned, "campaign", ends), first=_window()[0], last=_window()[1])
    return decisions.classify(found, _signals(t), freshness)


def decision_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _inputs(spark, sf_dir)
    return _anomalies(t, *_scopes(t, 7)).select("campaign", "metric", "day", "value", "center", "direction", "class")


_SERIES = f"""sd AS (SELECT campaign, day, spend, impressions, clicks, installs FROM fd UNION ALL SELECT 'app', day, spend, impressions, clicks, installs FROM ad),
er AS (SELECT campaign, day, revenue FROM lr UNION ALL SELECT 'app', day, sum(revenue) FROM lr JOIN st USING (campaign) WHERE operational GROUP BY 2),
sp AS (SELECT campaign, min(day) AS first FROM sd WHERE {LIVE} OR installs > 0 GROUP BY 1), ed AS (SELECT (SELECT max(report_date) FROM delivery) AS spend, (SELECT max(install_date) FROM installs) AS installs, (SELECT max(event_date) FROM revenue) AS revenue),
dn AS (SELECT campaign, CAST(unnest(generate_series(first, greatest(spend, installs, revenue), INTERVAL 1 DAY)) AS DATE) AS day FROM sp, ed),
sx AS (SELECT dn.campaign, dn.day, coalesce(sd.spend, 0) AS spend, coalesce(sd.installs, 0) AS installs, coalesce(er.revenue, 0) AS revenue FROM dn LEFT JOIN sd USING (campaign, day) LEFT JOIN er USING (campaign, day)),
sv AS (SELECT campaign, 'spend' AS metric, day, CAST(sx.spend AS DOUBLE) AS value FROM sx, ed WHERE day <= ed.spend UNION ALL SELECT campaign, 'installs', day, CAST(sx.installs AS DOUBLE) FROM sx, ed WHERE day <= ed.installs UNION ALL SELECT campaign, 'revenue', day, CAST(sx.revenue AS DOUBLE) FROM sx, ed WHERE day <= ed.revenue),
hh AS (SELECT a.campaign, a.metric, a.day, any_value(a.value) AS v, median(b.value) AS c, list(b.value) AS l FROM sv a JOIN sv b ON a.campaign = b.campaign AND a.metric = b.metric AND b.day BETWEEN a.day - 14 AND a.day - 1 WHERE a.day {_IN} GROUP BY 1, 2, 3 HAVING count(*) >= 7),
hk AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - c)), 'median') AS m, abs(v - c) AS size FROM hh),
fo AS (SELECT campaign, metric, day, floor(v * 1e6 + 0.5) / 1e6 AS value, floor(c * 1e6 + 0.5) / 1e6 AS center, CASE WHEN v > c THEN 'up' ELSE 'down' END AS direction FROM hk WHERE size >= 20 AND (c <= 0 OR size >= 0.3::DOUBLE * c) AND (m = 0 OR size / (1.4826::DOUBLE * m) >= 3.5)),
mk AS (SELECT fo.*, coalesce(sync_error OR uncovered, FALSE) AS gap, coalesce(finding, FALSE) AS noted, bool_or(metric = 'spend') OVER w AS sm, bool_or(metric = 'installs') OVER w AS im FROM fo LEFT JOIN sg USING (day) WINDOW w AS (PARTITION BY campaign, day, direction)),
an AS (SELECT campaign, metric, day, value, center, direction, CASE WHEN metric = 'spend' THEN 'delivery' WHEN gap THEN 'data_gap' WHEN metric = 'installs' OR im THEN CASE WHEN sm THEN 'delivery' WHEN noted THEN 'attribution' ELSE 'undetermined' END WHEN sm THEN 'delivery' WHEN noted THEN 'attribution' ELSE 'monetization' END AS class FROM mk)"""
_ALL = (*_BASE, "runs", "apps", "run_errors", "findings")
ORACLE["decision_anomalies"] = _sql(", ".join((_LINKS, _RUNS, _SERIES)) + "\nSELECT * FROM an", *_ALL)


#: The app whose recorded feeds the readings take.
_FEEDS_OF = "GB-ios"


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the recorded states of the app's feeds, and whether a role has no provider."""
    log, bindings = (view(spark, sf_dir, n).filter(F.col("app") == _FEEDS_OF) for n in ("app_runs", "app_bindings"))
    checked = log.groupBy("app").agg((F.max("finished_at") + F.expr("INTERVAL 10 MINUTES")).alias("checked_at"))
    states = metrics.feed_states(bindings, runs.stream_states(log, checked), F.lit(None).cast("timestamp"))
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("status"))).alias(f"{role}_status")
    return states.agg(of("marketing"), of("attribution"), (F.count_distinct("role") < 2).alias("provider_missing"))


def _decide(spark: SparkSession, sf_dir: str, policy: decisions.Policy, quiet: bool) -> tuple[DataFrame, DataFrame]:
    """A reading for each campaign that delivered in the window, and the app; and the anomalies behind them. quiet leaves
    anomalies, findings and errors out of the readings."""
    t, feeds = _inputs(spark, sf_dir), held(_feeds(spark, sf_dir))
    measure = decisions.return_measure(policy)
    kind, age = (measure.kind, measure.age) if measure else ("total", 7)
    days, earned = _scopes(t, age)
    first, last = _window()
    inside, as_of = days.filter(F.col("day").between(first, last)), _as_of(t)
    sums = facts.scope_summary(inside, "campaign", kind, as_of)
    mature = (F.col("spend") > 0) & F.col("old_enough") & F.col("covered")
    halves = decisions.trend(inside.select("campaign", "day", F.col(f"revenue_{kind}").alias("numerator"), F.col("spend").alias("denominator"), F.col("aligned_installs").alias("installs"), mature.alias("eligible"))).select("campaign", "direction")
    strange = held(_anomalies(t, days, earned, feeds.first()["attribution_status"]))
    moved = strange.groupBy("campaign").agg(F.count_if(F.col("class").isin("data_gap", "attribution")).alias("data_anomalies"), F.count_if(F.col("class").isin("undetermined", "monetization")).alias("open_anomalies"))
    found = runs.finding_counts(runs.current_findings(t["findings"], t["runs"]), first, last).filter("severity = 'error'")
    findings = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("app_findings"), F.coalesce(F.sum(F.when(~F.col("check_key").startswith("reconciliation."), F.col("n"))), F.lit(0)).alias("own_findings"))
    errors = runs.run_errors(t["run_errors"], t["runs"], TYPES).agg(F.count("*").alias("sync_errors"))
    share = facts.app_coverage(inside.filter("campaign <> 'app'"), facts.mapping_state(t["mappings"]))
    is_app = F.col("campaign") == "app"
    scopes = sums.join(facts.mapping_state(t["mappings"]), "campaign", "left").join(halves, "campaign", "left").join(moved, "campaign", "left").filter(is_app | F.col("delivered"))
    # One-row aggregates.
    scopes = scopes.crossJoin(F.broadcast(findings)).crossJoin(F.broadcast(errors)).crossJoin(F.broadcast(share)).crossJoin(F.broadcast(feeds))
    none = lambda c: F.lit(0) if quiet else F.coalesce(c, F.lit(0))
    ready = scopes.withColumns({
        "is_app": is_app, "operational": is_app | F.coalesce("operational", F.lit(False)), "ambiguous": F.coalesce("ambiguous", F.lit(False)), "as_of": as_of,
        "direction": F.coalesce("direction", F.lit("unknown")), "error_findings": none(F.when(is_app, F.col("app_findings")).otherwise(F.col("own_findings"))), "sync_errors": none(F.col("sync_errors")), "data_anomalies": none(F.col("data_anomalies")), "open_anomalies": none(F.col("open_anomalies")),
        "spend_coverage": F.when(is_app, F.col("spend_coverage")), "ambiguous_spend": F.when(is_app, F.col("ambiguous_spend")),
    })
    out = decisions.evaluate(ready, policy)
    return out.select("campaign", "signal", "category", "blocker", "roas", "cpi", "direction", "mature_days", "immature_days", "uncovered_days", "confidence", "confidence_level", F.col("spend").cast("double").alias("spend")), strange


def decision_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return at age seven against its target, with whatever the feeds and anomalies say first."""
    return _decide(spark, sf_dir, RETURN, False)[0]


def return_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on figures alone."""
    return _decide(spark, sf_dir, RETURN, True)[0]


def cost_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of an install against a ceiling."""
    return _decide(spark, sf_dir, COST, True)[0]


def _set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The readings with their places (the app, then campaigns by spend), stable ids, anomalies and pacing; and the anomalies."""
    rows, strange = (held(x) for x in _decide(spark, sf_dir, RETURN, False))
    place = F.count_if(F.lit(True)).over(decisions.Window.orderBy((F.col("campaign") != "app").cast("int"), F.col("spend").desc(), "campaign"))
    identity = scalars.stable_id(F.lit("rules-1"), F.when(F.col("campaign") == "app", "app").otherwise("campaign"), F.col("campaign"), *map(F.lit, WINDOW))
    entry = F.struct("day", "metric", "direction", "class")
    noted = strange.groupBy("campaign").agg(F.array_sort(F.collect_list(entry)).alias("anomalies"))
    first, last = _window()
    spent = view(spark, sf_dir, "delivery").filter(F.col("report_date").between(first, last)).withColumnRenamed("report_date", "day")
    paced = decisions.pacing(spent, _budgets(spark, sf_dir)).select("campaign", F.col("status").alias("pace"))
    # The places of one app's campaigns: as many rows as it has campaigns.
    out = rows.withColumns({"place": place, "id": identity}).join(noted, "campaign", "left").join(paced, "campaign", "left")
    return out, strange


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily budget of every third campaign, by what it spent."""
    sums = view(spark, sf_dir, "delivery").filter("CAST(substr(campaign, 2) AS INT) % 3 <> 1").groupBy("campaign")
    return sums.agg(F.round(F.sum("spend").cast("double") / 20).alias("daily"), F.lit("USD").alias("budget_currency"))


_NONE = "array<struct<day:date,metric:string,direction:string,class:string>>"


def _size(entries: str) -> F.Column:
    return F.when(F.col(entries).isNull(), 0).otherwise(F.size(entries))


def _listed(entries: F.Column) -> F.Column:
    return F.array_join(F.transform(F.coalesce(entries, F.array().cast(_NONE)), lambda a: F.concat_ws(":", a["day"].cast("string"), a["metric"], a["direction"], a["class"])), ",")


def decision_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings in the order in which they're shown, with all that speaks against their figures: errors, findings,
    anomalies by date and metric; and each campaign's pace."""
    rows, _ = _set(spark, sf_dir)
    return rows.select("campaign", "signal", "blocker", "spend", "place", "id", F.lit("none").alias("automation"), _listed(F.col("anomalies")).alias("anomalies"), F.when(F.col("campaign") != "app", F.coalesce("pace", F.lit("unknown"))).alias("pace"))


def decision_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set as one row: the app's reading, campaigns in order, their anomalies and paces. Lists are as long as the account."""
    rows, _ = _set(spark, sf_dir)
    entry = F.struct("place", "campaign", "signal", "blocker", "pace", _size("anomalies").alias("n"))
    one = rows.agg(
        F.max(F.when(F.col("campaign") == "app", F.col("signal"))).alias("app_signal"), F.max(F.when(F.col("campaign") == "app", F.col("blocker"))).alias("app_blocker"),
        F.array_sort(F.collect_list(F.when(F.col("campaign") != "app", entry))).alias("campaigns"), F.sum(_size("anomalies")).alias("anomalies"),
    )
    shown = F.array_join(F.transform("campaigns", lambda c: F.concat_ws(":", c["campaign"], c["signal"], F.coalesce(c["blocker"], F.lit("-")), F.coalesce(c["pace"], F.lit("unknown")), c["n"].cast("string"))), ",")
    return one.select("app_signal", "app_blocker", F.size("campaigns").cast("long").alias("n_campaigns"), shown.alias("campaigns"), F.col("anomalies").cast("long").alias("anomalies"))


def anomalies_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many scopes moved on each day in each metric, by class, and the strongest movement's scope of each."""
    t = _inputs(spark, sf_dir)
    found = _anomalies(t, *_scopes(t, 7))
    return found.groupBy("day", "metric").agg(F.count("*").alias("scopes"), F.count_if(F.col("direction") == "up").alias("up"), F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"), F.min("campaign").alias("first"))


def _decision_sql(quiet: bool, cost: bool = False) -> str:
    noise = "FALSE" if quiet else None
    verdict = (
        """WHEN spend_currencies[1] <> 'USD' THEN 'hold|data_quality|mixed_currency' WHEN exact_cpi IS NULL THEN 'insufficient_data|coverage|missing_denominator'
 WHEN exact_cpi <= 60 * 0.85::DOUBLE THEN 'scale|performance|' WHEN exact_cpi >= 60 * 1.15::DOUBLE THEN 'reduce|performance|' ELSE 'hold|performance|'"""
        if cost
        else """WHEN mature_days = 0 AND uncovered_days > 0 THEN 'insufficient_data|data_quality|provider_stale' WHEN mature_days = 0 THEN 'insufficient_data|coverage|immature_cohort'
 WHEN exact IS NULL THEN CASE WHEN mature_days < 3 THEN 'insufficient_data|coverage|immature_cohort' ELSE 'insufficient_data|coverage|missing_denominator' END
 WHEN exact >= 0.6::DOUBLE * 1.15::DOUBLE THEN CASE WHEN direction = 'deteriorating' THEN 'hold|performance|trend_contradicts' ELSE 'scale|performance|' END
 WHEN exact <= 0.6::DOUBLE * 0.85::DOUBLE THEN CASE WHEN direction = 'improving' THEN 'hold|performance|trend_contradicts' ELSE 'reduce|performance|' END ELSE 'hold|performance|'"""
    )
    return f""", wd AS (SELECT * FROM (SELECT campaign, day, spend, impressions, clicks, installs, aligned_installs, revenue_total, spend_currencies, currencies_total, old_enough, covered FROM fd UNION ALL SELECT 'app', day, spend, impressions, clicks, installs, aligned_installs, revenue_total, spend_currencies, currencies_total, old_enough, covered FROM ad) x WHERE day {_IN}),
wt AS (SELECT campaign, day, revenue_total AS n, spend AS d, aligned_installs AS i, row_number() OVER (PARTITION BY campaign ORDER BY day DESC) AS place FROM wd WHERE spend > 0 AND old_enough AND covered),
wh AS (SELECT campaign, place <= 7 AS now, CASE WHEN count(*) = 7 AND sum(d) >= 50 AND sum(i) >= 25 THEN floor(CAST(sum(n) AS DOUBLE) / CAST(sum(d) AS DOUBLE) * 1e6 + 0.5) / 1e6 END AS v FROM wt WHERE place <= 14 GROUP BY 1, 2),
wc AS (SELECT campaign, max(v) FILTER (now) AS a, max(v) FILTER (NOT now) AS b FROM wh GROUP BY 1), wp AS (SELECT campaign, CASE WHEN b > 0 THEN floor((a - b) / b * 100 * 1e4 + 0.5) / 1e4 END AS change FROM wc),
ws AS (SELECT campaign, coalesce(sum(spend) FILTER (spend > 0), 0) AS spend, bool_or({LIVE}) AS delivered, count(*) FILTER (spend > 0 AND old_enough AND covered) AS mature_days, count(*) FILTER (spend > 0 AND NOT old_enough) AS immature_days, count(*) FILTER (spend > 0 AND old_enough AND NOT covered) AS uncovered_days,
 coalesce(sum(spend) FILTER (spend > 0 AND old_enough AND covered), 0) AS ms, coalesce(sum(aligned_installs) FILTER (spend > 0 AND old_enough AND covered), 0) AS mi, coalesce(sum(revenue_total) FILTER (spend > 0 AND old_enough AND covered), 0) AS mr, coalesce(sum(spend) FILTER (spend > 0 AND day < as_of), 0) AS ss, coalesce(sum(aligned_installs) FILTER (spend > 0 AND day < as_of), 0) AS si,
 list_sort(list_distinct(flatten(list(spend_currencies)))) AS spend_currencies, coalesce(list_sort(list_distinct(flatten(list(currencies_total) FILTER (spend > 0 AND old_enough AND covered)))), []) AS revenue_currencies FROM wd, h GROUP BY 1),
wv AS (SELECT sum(spend) FILTER (operational) / sum(spend) * 100 AS cover, coalesce(sum(spend) FILTER (ambiguous), 0) / sum(spend) * 100 AS doubt FROM wd LEFT JOIN st USING (campaign) WHERE campaign <> 'app'),
wf AS (SELECT count(*) AS app_f, count(*) FILTER (check_key NOT LIKE 'reconciliation.%') AS own_f FROM cf WHERE severity = 'error' AND (observed IS NULL OR observed {_IN}) AND check_key NOT IN ('attribution.missing_campaign_id', 'marketing.missing_campaign_id')),
wz AS (SELECT ws.*, campaign = 'app' AS is_app, campaign = 'app' OR coalesce(operational, FALSE) AS op, coalesce(ambiguous, FALSE) AS amb, mapping_status, mapping_confidence, CASE WHEN change IS NULL THEN 'unknown' WHEN abs(change) < 20 THEN 'stable' WHEN change > 0 THEN 'improving' ELSE 'deteriorating' END AS direction, CAST(cover AS DOUBLE) AS cover, CAST(doubt AS DOUBLE) AS doubt,
 CASE WHEN mature_days >= 3 AND ms >= 50 AND mi >= 25 THEN CAST(mr AS DOUBLE) / CAST(ms AS DOUBLE) END AS exact, CASE WHEN ss >= 50 AND si >= 25 THEN CAST(ss AS DOUBLE) / CAST(si AS DOUBLE) END AS exact_cpi, {noise or "(SELECT count(*) FROM oe) > 0"} AS bad_sync,
 {noise or "CASE WHEN campaign = 'app' THEN app_f ELSE own_f END > 0"} AS bad_rows, {noise or "campaign IN (SELECT campaign FROM an WHERE class IN ('data_gap', 'attribution'))"} AS bad_days, {noise or "campaign IN (SELECT campaign FROM an WHERE class IN ('undetermined', 'monetization'))"} AS odd_days
 FROM ws LEFT JOIN st USING (campaign) LEFT JOIN wp USING (campaign), wv, wf WHERE campaign = 'app' OR delivered),
wr AS (SELECT *, CASE WHEN NOT op AND amb THEN 'investigate|coverage|ambiguous_mapping' WHEN NOT op THEN 'insufficient_data|coverage|insufficient_coverage' WHEN is_app AND cover < 80 THEN 'insufficient_data|coverage|insufficient_coverage' WHEN is_app AND doubt > 10 THEN 'investigate|coverage|ambiguous_mapping'
 WHEN bad_sync THEN 'investigate|data_quality|provider_stale' WHEN len(spend_currencies) > 1 OR len(revenue_currencies) > 1 OR (len(spend_currencies) = 1 AND len(revenue_currencies) = 1 AND spend_currencies[1] <> revenue_currencies[1]) THEN 'investigate|data_quality|mixed_currency'
 WHEN bad_rows THEN 'investigate|data_quality|data_quality_finding' WHEN bad_days THEN 'investigate|data_quality|anomalous_data' WHEN odd_days THEN 'investigate|undetermined|anomalous_data' {verdict} END AS verdict,
 0.7::DOUBLE * least(1.0::DOUBLE, mi / 25.0::DOUBLE) * CASE WHEN is_app THEN cover / 100 * (1 - doubt / 100) ELSE CASE WHEN NOT op THEN 0 WHEN mapping_status = 'matched_fallback' THEN mapping_confidence ELSE 1 END END * CASE WHEN mature_days + immature_days + uncovered_days > 0 THEN CAST(mature_days AS DOUBLE) / (mature_days + immature_days + uncovered_days) ELSE 0 END AS score FROM wz),
wy AS (SELECT campaign, split_part(verdict, '|', 1) AS signal, split_part(verdict, '|', 2) AS category, nullif(split_part(verdict, '|', 3), '') AS blocker, floor(exact * 1e6 + 0.5) / 1e6 AS roas, floor(exact_cpi * 1e6 + 0.5) / 1e6 AS cpi, direction, mature_days, immature_days, uncovered_days, floor(score * 1e4 + 0.5) / 1e4 AS confidence,
 CASE WHEN floor(score * 1e4 + 0.5) / 1e4 >= 0.8 THEN 'high' WHEN floor(score * 1e4 + 0.5) / 1e4 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level, CAST(spend AS DOUBLE) AS spend FROM wr)"""


_PARTS = ", ".join((_LINKS, _RUNS, _SERIES))
ORACLE["decision_signals"] = _sql(_PARTS + _decision_sql(False) + "\nSELECT * FROM wy", *_ALL)
ORACLE["return_decisions"] = _sql(_PARTS + _decision_sql(True) + "\nSELECT * FROM wy", *_ALL)
ORACLE["cost_decisions"] = _sql(_PARTS + _decision_sql(True, True) + "\nSELECT * FROM wy", *_ALL)
_SET = f""", ax AS (SELECT campaign, string_agg(CAST(day AS VARCHAR) || ':' || metric || ':' || direction || ':' || class, ',' ORDER BY day, metric, direction) AS anomalies, count(*) AS n FROM an GROUP BY 1),
bg AS (SELECT campaign, round(CAST(sum(spend) AS DOUBLE) / 20) AS daily FROM delivery WHERE CAST(substr(campaign, 2) AS INTEGER) % 3 <> 1 GROUP BY 1),
pa AS (SELECT campaign, count(DISTINCT report_date) FILTER (spend > 0) AS live_days, count(DISTINCT currency) FILTER (spend > 0) AS cur, min(currency) FILTER (spend > 0) AS money, CAST(sum(spend) AS DOUBLE) AS total FROM delivery WHERE report_date {_IN} GROUP BY 1),
pc AS (SELECT campaign, CASE WHEN live_days = 0 OR coalesce(daily, 0) <= 0 OR cur > 1 OR money <> 'USD' THEN 'unknown' WHEN ratio < 0.5 THEN 'under' WHEN ratio > 1.25 THEN 'over' ELSE 'on' END AS pace
  FROM (SELECT *, floor(floor(total / live_days * 1e6 + 0.5) / 1e6 / daily * 1e4 + 0.5) / 1e4 AS ratio FROM pa LEFT JOIN bg USING (campaign)) x),
ds AS (SELECT campaign, signal, blocker, wy.spend, count(*) OVER (ORDER BY campaign <> 'app', wy.spend DESC, campaign) AS place, left(sha256('rules-1|' || CASE WHEN campaign = 'app' THEN 'app' ELSE 'campaign' END || '|' || campaign || '|{WINDOW[0]}|{WINDOW[1]}'), 32) AS id,
  coalesce(anomalies, '') AS anomalies, coalesce(n, 0) AS n, CASE WHEN campaign <> 'app' THEN coalesce(pace, 'unknown') END AS pace FROM wy LEFT JOIN ax USING (campaign) LEFT JOIN pc USING (campaign))
"""
ORACLE["decision_set"] = _sql(_PARTS + _decision_sql(False) + _SET + "SELECT campaign, signal, blocker, spend, place, id, 'none' AS automation, anomalies, pace FROM ds", *_ALL)
ORACLE["decision_document"] = _sql(_PARTS + _decision_sql(False) + _SET + """SELECT max(signal) FILTER (campaign = 'app') AS app_signal, max(blocker) FILTER (campaign = 'app') AS app_blocker, count(*) FILTER (campaign <> 'app') AS n_campaigns,
coalesce(string_agg(campaign || ':' || signal || ':' || coalesce(blocker, '-') || ':' || pace || ':' || n, ',' ORDER BY place) FILTER (campaign <> 'app'), '') AS campaigns, CAST(sum(n) AS BIGINT) AS anomalies FROM ds""", *_ALL)
ORACLE["anomalies_by_day"] = _sql(", ".join((_LINKS, _RUNS, _SERIES)) + "\nSELECT day, metric, count(*) AS scopes, count(*) FILTER (direction = 'up') AS up, string_agg(DISTINCT class, ',' ORDER BY class) AS classes, min(campaign) AS first FROM an GROUP BY 1, 2", *_ALL)

QUERIES |= {f.__name__: f for f in (
    campaign_day_facts, app_day_rollup, linked_daily_revenue, lifetime_spend, mapping_states, run_data_windows, run_completed_windows, current_findings, open_run_errors, day_signals, finding_counts, decision_anomalies, decision_signals,
    return_decisions, cost_decisions, decision_set, decision_document, anomalies_by_day,
)}
