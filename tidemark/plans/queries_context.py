"""Metrics of many scopes in one pass, and under the context of each app: feeds, capabilities, coverage; with their SQL.

The SQL takes what metrics rest on from a table of its own (RESTS), written out here and not from the engine's catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import command, metrics, populations, runs
from tidemark.plans import queries_history as history
from tidemark.plans import queries_metrics
from tidemark.plans.bridge import held, view, with_views
from tidemark.plans.queries_metrics import _METRICS, LIVE, OPERATIONAL, ORGANIC, _metric_sql

QUERIES: dict = {}
ORACLE: dict = {}

_INPUTS = ("delivery", "installs", "revenue", "mappings")
DIMENSIONS = ("country", "platform", "channel")
_CHANNEL = "CASE WHEN media_source IS NULL OR media_source = 'Organic' THEN 'organic' ELSE 'paid_social' END"


def _cells(facts: DataFrame, channel: F.Column, by: tuple, *sums: str) -> DataFrame:
    """Facts summed to what scopes and populations tell apart, so that each scope takes sums and not rows."""
    cells = facts.withColumn("channel", channel).groupBy("country", "platform", "channel", *by).agg(*(F.sum(c).alias(c) for c in sums))
    return populations.in_scopes(cells, DIMENSIONS)


def scoped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 metrics for every choice of country, platform and channel, and of none, in one aggregate of each fact table."""
    delivery, installs, revenue, mappings = (view(spark, sf_dir, n) for n in _INPUTS)
    spent = _cells(delivery, scalars.provider_channel(F.col("provider")), ("campaign", "currency", "report_date"), "spend", "impressions", "clicks", "link_clicks")
    source = scalars.media_channel(F.col("media_source"))
    taken = _cells(installs, source, ("campaign", "media_source"), "installs")
    earned = _cells(revenue, source, ("campaign", "media_source", "revenue_type", "currency"), "revenue")
    return metrics.scoped_metrics(spent, taken, earned, mappings)


def _scoped(scopes: str, match: str, out: str) -> str:
    """Oracle's rows of d, i and r by scope, the values v of each scope, and the metrics."""
    body = "\nUNION ALL ".join(_metric_sql(*m).replace("SELECT '", f"SELECT {out}, '", 1) for m in _METRICS)
    return f""", link AS (SELECT * FROM mappings WHERE {OPERATIONAL}), scopes AS ({scopes}),
d AS (SELECT s.scope, x.*, campaign IN (SELECT source FROM link) AS mapped, {LIVE} AS live FROM spent x JOIN scopes s ON {match}),
hit AS (SELECT DISTINCT target FROM link WHERE target IS NOT NULL),
near AS (SELECT DISTINCT d.scope, target FROM link JOIN d ON d.campaign = link.source AND d.live WHERE target IS NOT NULL),
i AS (SELECT s.scope, x.*, {ORGANIC} AS organic, x.campaign IN (SELECT target FROM hit) AS mapped, n.target IS NOT NULL AS aligned
  FROM taken x JOIN scopes s ON {match} LEFT JOIN near n ON n.scope = s.scope AND n.target = x.campaign),
r AS (SELECT s.scope, x.*, {ORGANIC} AS organic, x.campaign IN (SELECT target FROM hit) AS mapped, n.target IS NOT NULL AS aligned
  FROM earned x JOIN scopes s ON {match} LEFT JOIN near n ON n.scope = s.scope AND n.target = x.campaign),
v AS (SELECT a.scope, coalesce(spend, 0) AS spend, coalesce(mapped_spend, 0) AS mapped_spend, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks, link_clicks,
  coalesce(spend_cur, 0) AS spend_cur, coalesce(live_campaigns, 0) AS live_campaigns, coalesce(mapped_live, 0) AS mapped_live, coalesce(installs, 0) AS installs,
  coalesce(organic_installs, 0) AS organic_installs, coalesce(mapped_installs, 0) AS mapped_installs, coalesce(aligned_installs, 0) AS aligned_installs, coalesce(revenue, 0) AS revenue,
  coalesce(mapped_revenue, 0) AS mapped_revenue, coalesce(aligned_revenue, 0) AS aligned_revenue, coalesce(iap, 0) AS iap, coalesce(ad, 0) AS ad, coalesce(revenue_cur, 0) AS revenue_cur, known, good, usable
  FROM (SELECT scope FROM d UNION SELECT scope FROM i UNION SELECT scope FROM r) a
  LEFT JOIN (SELECT scope, sum(spend) AS spend, sum(spend) FILTER (mapped) AS mapped_spend, sum(impressions) AS impressions, sum(clicks) AS clicks, sum(link_clicks) AS link_clicks,
    count(DISTINCT currency) AS spend_cur, count(DISTINCT campaign) FILTER (live) AS live_campaigns, count(DISTINCT campaign) FILTER (live AND mapped) AS mapped_live FROM d GROUP BY 1) dd USING (scope)
  LEFT JOIN (SELECT scope, sum(installs) AS installs, sum(installs) FILTER (organic) AS organic_installs, sum(installs) FILTER (NOT organic AND mapped) AS mapped_installs,
    sum(installs) FILTER (NOT organic AND aligned) AS aligned_installs FROM i GROUP BY 1) ii USING (scope)
  LEFT JOIN (SELECT scope, sum(revenue) AS revenue, sum(revenue) FILTER (NOT organic AND mapped) AS mapped_revenue, sum(revenue) FILTER (NOT organic AND aligned) AS aligned_revenue,
    sum(revenue) FILTER (revenue_type = 'iap') AS iap, sum(revenue) FILTER (revenue_type = 'ad') AS ad, count(DISTINCT currency) AS revenue_cur FROM r GROUP BY 1) rr USING (scope),
  (SELECT count(*) AS known, count(*) FILTER (status IN ('matched_exact', 'matched_confident', 'manually_verified')) AS good, count(*) FILTER ({OPERATIONAL}) AS usable
    FROM (SELECT DISTINCT ON (source) * FROM mappings ORDER BY source, confidence DESC, status, coalesce(target, '')) m)),
ev AS ({body})
"""  # noqa: S608


_ALL_SCOPES = """SELECT 'country=' || coalesce(c, '*') || '|platform=' || coalesce(p, '*') || '|channel=' || coalesce(h, '*') AS scope, c, p, h FROM
(SELECT DISTINCT country AS c FROM taken UNION SELECT country FROM spent UNION SELECT NULL) x, (SELECT DISTINCT platform AS p FROM taken UNION SELECT platform FROM spent UNION SELECT NULL) y,
(SELECT 'paid_social' AS h UNION SELECT 'organic' UNION SELECT NULL) z"""
_WITHIN = "(s.c IS NULL OR s.c = x.country) AND (s.p IS NULL OR s.p = x.platform) AND (s.h IS NULL OR s.h = x.channel)"
_FACTS = f""", spent AS (SELECT *, 'paid_social' AS channel FROM delivery), taken AS (SELECT *, {_CHANNEL} AS channel FROM installs), earned AS (SELECT *, {_CHANNEL} AS channel FROM revenue)"""
QUERIES["scoped_metrics"] = scoped_metrics
ORACLE["scoped_metrics"] = with_views("", *_INPUTS).rstrip() + _FACTS + _scoped(_ALL_SCOPES, _WITHIN, "scope") + "SELECT * FROM ev"

#: Two apps have an account of some campaigns only; the filter of account reaches delivery, not installs or revenue.
ACCOUNT = """(app NOT IN ('US-ios', 'DE-android') OR (app = 'US-ios' AND campaign IN ('c0', 'c1', 'c2', 'c3'))
OR (app = 'DE-android' AND campaign IN ('c0', 'c1', 'c2', 'c3', 'c5', 'c8', 'c10')))"""
_APP = "country || '-' || platform"


def _context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Metrics of every app, its feeds and capabilities as recorded, and the coverage of its spend."""
    delivery, installs, revenue, mappings = (view(spark, sf_dir, n) for n in _INPUTS)
    of = F.concat_ws("-", "country", "platform")
    spent = held(delivery.withColumn("app", of).filter(ACCOUNT))
    evaluated = held(metrics.scoped_metrics(spent, installs.withColumn("app", of), revenue.withColumn("app", of), mappings, ("app",)))
    log = held(view(spark, sf_dir, "app_runs"))
    checked = log.groupBy("app").agg((F.max("finished_at") + F.expr("INTERVAL 10 MINUTES")).alias("checked_at"))
    streams = runs.stream_states(log, checked)
    now = log.agg((F.max("finished_at") + F.expr("INTERVAL 3 HOURS")).alias("now")).first()["now"]
    feeds = held(metrics.feed_states(view(spark, sf_dir, "app_bindings"), streams, F.lit(now)))
    live = populations.marketing(spent, mappings).filter(populations.delivered())
    unsure = mappings.filter("status = 'ambiguous'").select(F.col("source").alias("campaign"))
    rows = populations.flag(live, unsure, "unsure")
    spend = lambda c: F.coalesce(F.sum(F.when(c, F.col("spend"))), F.lit(0)).cast("double")
    coverage = rows.groupBy("app").agg(
        F.sum("spend").cast("double").alias("total_spend"), spend(F.col("mapped")).alias("mapped_spend"), spend(F.col("unsure") & ~F.col("mapped")).alias("ambiguous_spend")
    )
    return evaluated, feeds, view(spark, sf_dir, "app_capabilities"), held(coverage)


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    evaluated, feeds, capabilities, coverage = _context(spark, sf_dir)
    apps = view(spark, sf_dir, "app_capabilities")
    gated = metrics.gates(apps, metrics.OPERATIONAL, feeds, capabilities, coverage)
    return metrics.in_context(evaluated, gated), feeds, coverage, evaluated


def metrics_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operational metric of every app under the gates of its feeds, capabilities and coverage."""
    return _gated(spark, sf_dir)[0].select("app", "metric", "family", "value", "availability", "blocker")


def cohort_metrics_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 cohort metrics under the gates of every app."""
    _, feeds, capabilities, coverage = _context(spark, sf_dir)
    found = held(history.QUERIES["cohort_metrics"](spark, sf_dir))
    gated = metrics.gates(view(spark, sf_dir, "app_capabilities"), metrics.COHORT, feeds, capabilities, coverage)
    return metrics.in_context(found, gated).select("app", "metric", "value", "availability", "blocker")


def performance_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each app: metrics by family, what is qualified and why, feed states and confidence."""
    gated, feeds, coverage, evaluated = _gated(spark, sf_dir)
    sample = evaluated.filter("metric = 'delivery_aligned_paid_installs'").select("app", F.col("numerator").alias("sample"))
    out = metrics.documents(gated, feeds, coverage.join(sample, "app", "full_outer"))
    flat = lambda family: F.array_join(F.transform(F.col("groups")[family], lambda m: F.concat_ws(":", m["metric"], m["availability"])), ",").alias(family)
    shown = F.aggregate(F.map_values("groups"), F.lit(0), lambda a, g: a + F.size(F.filter(g, lambda m: m["value"].isNotNull())))
    qualified = F.array_join(F.transform("qualified", lambda q: F.concat_ws(":", q["metric"], q["availability"], q["blocker"])), ",")
    return out.select("app", *map(flat, ("delivery", "attribution", "revenue", "efficiency", "coverage")), shown.cast("long").alias("shown"), qualified.alias("qualified"), F.array_join("blockers", ",").alias("blockers"), "marketing", "attribution_status", "confidence", "confidence_level")


# What each metric rests on, for the SQL: metric, family, class, sources (m, a, p: marketing, attribution, mapping), capabilities, hours.
RESTS = """spend delivery operational m cost_data 24; impressions delivery operational m delivery_metrics 24; clicks delivery operational m delivery_metrics 24;
link_clicks delivery operational m link_clicks 24; ctr delivery operational m delivery_metrics 24; cpm delivery operational m cost_data,delivery_metrics 24;
cpc delivery operational m cost_data,delivery_metrics 24; attributed_installs attribution operational a attributed_installs 24; attributed_revenue revenue operational a attributed_revenue 48;
paid_attributed_installs attribution operational a - 24; iap_revenue revenue operational a - 24; ad_revenue revenue operational a - 24;
mapped_paid_installs attribution mapping ap attributed_installs 24; organic_installs attribution operational a attributed_installs 24;
mapped_attributed_revenue revenue mapping ap attributed_revenue 48; delivery_aligned_paid_installs attribution operational map attributed_installs 24;
delivery_aligned_revenue revenue operational map attributed_revenue 48; mapped_cpi efficiency operational map cost_data,attributed_installs 24;
blended_cpi efficiency operational ma cost_data,attributed_installs 24; mapping_coverage coverage mapping p - 24; operational_mapping_coverage coverage mapping p - 24;
spend_coverage coverage mapping mp cost_data 24; attribution_coverage coverage mapping ap attributed_installs 24; campaign_operational_coverage coverage mapping mp - 24"""
COHORT_RESTS = "; ".join(
    f"cohort_{a}{kind}_d{age} cohort cohort {feeds} cohort_reporting,{more}cohort_{b}_revenue_d{age} 24"
    for a, b in (("", "total"), ("iap_", "iap"), ("ad_", "ad")) for age in (1, 7) for kind, feeds, more in (("revenue", "a", ""), ("rpi", "a", "attributed_installs,"), ("roas", "map", "cost_data,"))
)


def _rests(text: str) -> str:
    rows = [r.split() for r in text.split(";")]
    return ", ".join(f"('{k}', '{f}', '{c}', '{s}', [{', '.join(repr(x) for x in n.split(',') if x != '-')}]::VARCHAR[], {h} * 60)" for k, f, c, s, n, h in rows)


_STATE = """, checked AS (SELECT app, max(finished_at) + INTERVAL 10 MINUTE AS checked_at FROM app_runs GROUP BY 1),
stream AS (SELECT r.app, data_type, split_part(data_type, '_', 1) AS role, max(finished_at) FILTER (status = 'completed') AS last_success, arg_max(status, finished_at) AS newest, max(latest_day) AS latest_day,
  CASE data_type WHEN 'marketing_performance' THEN 180 WHEN 'attribution_installs' THEN 240 ELSE 480 END AS expected, any_value(c.checked_at) AS checked_at FROM app_runs r JOIN checked c ON c.app = r.app GROUP BY r.app, data_type),
judged AS (SELECT *, CASE WHEN newest = 'failed' THEN 0 WHEN last_success IS NULL THEN 2 WHEN date_diff('second', last_success, checked_at) / 60.0 > expected * 3 THEN 1
  WHEN CAST(checked_at AS DATE) - latest_day >= 3 THEN 1 WHEN CAST(checked_at AS DATE) - latest_day = 2 THEN 3 WHEN date_diff('second', last_success, checked_at) / 60.0 > expected THEN 3 ELSE 4 END AS place FROM stream),
feed AS (SELECT b.app, b.role, ['error', 'stale', 'unknown', 'delayed', 'fresh'][min(place) + 1] AS status,
  floor(date_diff('second', min(last_success), (SELECT max(finished_at) + INTERVAL 3 HOUR FROM app_runs)) / 60.0) AS minutes FROM app_bindings b LEFT JOIN judged j ON j.app = b.app AND j.role = b.role GROUP BY 1, 2),
cover AS (SELECT app, sum(spend) AS total, coalesce(sum(spend) FILTER (mapped), 0) AS mapped, coalesce(sum(spend) FILTER (NOT mapped AND campaign IN (SELECT source FROM mappings WHERE status = 'ambiguous')), 0) AS unsure FROM d WHERE live GROUP BY 1),
"""


def _gate_sql(rests: str, values: str) -> str:
    both = "kind = 'operational' AND on_ LIKE '%m%' AND on_ LIKE '%a%'"
    return f"""{_STATE}rest(metric, family, kind, on_, needs, tolerated) AS (VALUES {_rests(rests)}),
asked AS (SELECT a.app, t.*, m.status AS ms, m.minutes AS mm, m.app IS NOT NULL AS has_m, n.status AS ns, n.minutes AS nm, n.app IS NOT NULL AS has_a, total, mapped, unsure,
  EXISTS (SELECT 1 FROM unnest(t.needs) u(need) WHERE need NOT IN (SELECT capability FROM app_capabilities k WHERE k.app = a.app AND supported)) AS lacks
  FROM (SELECT DISTINCT app FROM app_capabilities) a, rest t LEFT JOIN feed m ON m.app = a.app AND m.role = 'marketing' AND on_ LIKE '%m%' LEFT JOIN feed n ON n.app = a.app AND n.role = 'attribution' AND on_ LIKE '%a%' LEFT JOIN cover c ON c.app = a.app),
gate AS (SELECT *, CASE WHEN (on_ LIKE '%m%' AND NOT has_m) OR (on_ LIKE '%a%' AND NOT has_a) THEN 'unavailable|missing_provider' WHEN lacks THEN 'unavailable|unsupported_metric'
  WHEN coalesce(ms IN ('stale', 'error'), FALSE) OR coalesce(ns IN ('stale', 'error'), FALSE) OR coalesce(mm > tolerated, FALSE) OR coalesce(nm > tolerated, FALSE) THEN 'stale|provider_stale'
  WHEN coalesce(ms = 'delayed', FALSE) OR coalesce(ns = 'delayed', FALSE) THEN 'partial|provider_stale' WHEN {both} AND total > 0 AND mapped / total * 100 < 80 THEN 'partial|insufficient_coverage'
  WHEN {both} AND total > 0 AND unsure / total * 100 > 10 THEN 'partial|ambiguous_mapping' ELSE 'available|' END AS g FROM asked),
met AS (SELECT gate.app, gate.metric, family, e.value, numerator, availability AS own, reason, split_part(g, '|', 1) AS ga, nullif(split_part(g, '|', 2), '') AS gb,
  list_position(['available', 'partial', 'stale', 'unavailable', 'blocked'], split_part(g, '|', 1)) AS gp, list_position(['available', 'partial', 'stale', 'unavailable', 'blocked'], availability) AS op FROM gate JOIN {values}),
gx AS (SELECT app, metric, family, numerator, CASE WHEN ga <> 'unavailable' THEN value END AS value, CASE WHEN ga = 'unavailable' OR gp >= op THEN ga ELSE own END AS availability,
  CASE WHEN (ga = 'unavailable' OR gp >= op) AND gb IS NOT NULL THEN gb ELSE reason END AS blocker FROM met)
"""


_VIEWS = (*_INPUTS, "app_runs", "app_bindings", "app_capabilities")
_BY_APP = f""", spent AS (SELECT * FROM (SELECT *, {_APP} AS app FROM delivery) a WHERE {ACCOUNT}), taken AS (SELECT *, {_APP} AS app FROM installs), earned AS (SELECT *, {_APP} AS app FROM revenue)"""
_BASE = with_views("", *_VIEWS).rstrip() + _BY_APP + _scoped(f"SELECT DISTINCT {_APP} AS scope FROM installs UNION SELECT DISTINCT {_APP} FROM delivery", "s.scope = x.app", "scope AS app").rstrip()
_CONTEXT = _BASE + _gate_sql(RESTS, "ev e ON e.app = gate.app AND e.metric = gate.metric")
ORACLE["metrics_in_context"] = _CONTEXT + "SELECT app, metric, family, value, availability, blocker FROM gx"
_DOCUMENT = """, sure AS (SELECT c.app, CASE status WHEN 'fresh' THEN 1.0 WHEN 'delayed' THEN 0.7 WHEN 'unknown' THEN 0.6 ELSE 0.4 END * greatest(0, least(1, mapped / total)) * greatest(0, least(1, 1 - unsure / total))
  * greatest(0, least(1, aligned_installs / 25.0)) AS score FROM cover c JOIN v ON v.scope = c.app JOIN (SELECT app, coalesce(max(status) FILTER (role = 'marketing'), max(status) FILTER (role = 'attribution')) AS status FROM feed GROUP BY 1) f ON f.app = c.app)
SELECT gx.app, {families}, count(value) AS shown, coalesce(string_agg(metric || ':' || availability || coalesce(':' || blocker, ''), ',' ORDER BY metric) FILTER (availability <> 'available'), '') AS qualified,
  (SELECT coalesce(string_agg(DISTINCT blocker, ',' ORDER BY blocker), '') FROM gx b WHERE b.app = gx.app) AS blockers, (SELECT status FROM feed WHERE feed.app = gx.app AND role = 'marketing') AS marketing,
  (SELECT status FROM feed WHERE feed.app = gx.app AND role = 'attribution') AS attribution_status, floor(any_value(score) * 10000 + 0.5) / 10000 AS confidence,
  CASE WHEN floor(any_value(score) * 10000 + 0.5) / 10000 >= 0.8 THEN 'high' WHEN floor(any_value(score) * 10000 + 0.5) / 10000 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level FROM gx JOIN sure USING (app) GROUP BY gx.app"""
ORACLE["performance_document"] = _CONTEXT + _DOCUMENT.format(families=", ".join(f"string_agg(metric || ':' || availability, ',' ORDER BY metric) FILTER (family = '{f}') AS {f}" for f in ("delivery", "attribution", "revenue", "efficiency", "coverage")))
_OF_COHORTS = f""", coh AS (SELECT *, NULL AS numerator FROM ({history.ORACLE["cohort_metrics"]}) c)"""
ORACLE["cohort_metrics_in_context"] = _BASE + _OF_COHORTS + _gate_sql(COHORT_RESTS, "coh e ON e.metric = gate.metric") + "SELECT app, metric, value, availability, blocker FROM gx"
QUERIES |= {f.__name__: f for f in (metrics_in_context, cohort_metrics_in_context, performance_document)}


def command_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot over cells of the facts that are written once: metrics, series, campaigns, gaps, feeds, runs, findings."""
    delivery, installs, revenue, mappings, log, findings = (view(spark, sf_dir, n) for n in (*_INPUTS, "runs", "findings"))
    recorded = view(spark, sf_dir, "app_runs").filter("app = 'GB-ios'")
    checked = recorded.groupBy("app").agg((F.max("finished_at") + F.expr("INTERVAL 10 MINUTES")).alias("checked_at"))
    bindings = view(spark, sf_dir, "app_bindings").filter("app = 'GB-ios' AND role = 'marketing'")
    return command.snapshot(*command.cells(delivery, installs, revenue, held), held(mappings), held(runs.stream_states(recorded, checked)), log, findings, bindings)


_PICK = "SELECT '{}' AS section, CAST({} AS VARCHAR) AS label, CAST({} AS DOUBLE) AS amount, CAST({} AS VARCHAR) AS state FROM "
ORACLE["command_centre"] = with_views("", *_INPUTS, "runs", "findings", "app_runs").rstrip() + f""", tot AS (SELECT campaign, sum(spend) AS spend FROM delivery WHERE campaign IS NOT NULL GROUP BY 1),
best AS (SELECT DISTINCT ON (source) * FROM mappings ORDER BY source, confidence DESC, status, coalesce(target, ''))
{_PICK.format("metric", "metric", "value", "availability")} ({queries_metrics.ORACLE["operational_metrics_long"]}) m
UNION ALL {_PICK.format("spend_by_day", "report_date", "sum(spend)", "NULL")} delivery GROUP BY report_date
UNION ALL {_PICK.format("installs_by_day", "install_date", "sum(installs)", "NULL")} installs GROUP BY install_date
UNION ALL {_PICK.format("revenue_by_day", "event_date", "sum(revenue)", "NULL")} revenue GROUP BY event_date
UNION ALL {_PICK.format("campaign", "campaign", "spend", "coalesce(status, 'not_computed')")} (SELECT * FROM tot ORDER BY spend DESC, campaign LIMIT 25) t LEFT JOIN best ON source = campaign
UNION ALL {_PICK.format("unlinked", "campaign", "spend", "NULL")} (SELECT * FROM tot WHERE spend > 0 AND campaign NOT IN (SELECT source FROM mappings WHERE {OPERATIONAL}) ORDER BY spend DESC, campaign LIMIT 10) u
UNION ALL {_PICK.format("ambiguous", "source", "confidence", "NULL")} mappings WHERE status = 'ambiguous'
UNION ALL {_PICK.format("feed", "data_type", "NULL", "CASE WHEN newest = 'failed' THEN 'error' WHEN data_type = 'attribution_installs' THEN 'delayed' ELSE 'fresh' END")} (SELECT data_type, arg_max(status, finished_at) AS newest FROM app_runs WHERE app = 'GB-ios' GROUP BY 1) f
UNION ALL {_PICK.format("run", "run", "NULL", "status")} (SELECT * FROM runs ORDER BY finished_at DESC NULLS LAST, run LIMIT 5) g
UNION ALL {_PICK.format("finding", "check_key", "n", "severity")} (SELECT check_key, severity, count(*) AS n FROM findings GROUP BY 1, 2 ORDER BY n DESC, check_key LIMIT 10) h
UNION ALL SELECT 'empty', 'attribution', NULL, 'unconnected'"""
QUERIES["command_centre"] = command_centre
