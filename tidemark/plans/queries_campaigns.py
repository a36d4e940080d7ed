"""Campaign table, discrepancies, coverage and reconciliation over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import campaigns, populations, reconcile
from tidemark.plans.bridge import view, with_views
from tidemark.plans.queries_metrics import LIVE, OPERATIONAL, ORGANIC

QUERIES: dict = {}
ORACLE: dict = {}
_BEST = "(SELECT DISTINCT ON (source) * FROM mappings ORDER BY source, confidence DESC, status, coalesce(target, ''))"
_TABLE = f"""SELECT d.campaign, name, campaign_status, CAST(d.spend AS DOUBLE) AS spend, impressions, clicks, last_day, coalesce(b.status, 'not_computed') AS mapping_status, method AS mapping_method, confidence AS mapping_confidence, target AS attribution_campaign,
coalesce(children, 0) AS children, coalesce(targets, '') AS targets, last_install_day, count(*) OVER () AS total_count,
CASE WHEN shown THEN CAST(installs AS BIGINT) END AS installs, CASE WHEN shown THEN CAST(revenue AS DOUBLE) END AS revenue,
CASE WHEN impressions >= 1000 THEN CAST(clicks AS DOUBLE) / CAST(impressions AS DOUBLE) END AS ctr, CASE WHEN impressions >= 1000 THEN CAST(d.spend AS DOUBLE) * 1000 / CAST(impressions AS DOUBLE) END AS cpm,
CASE WHEN clicks >= 50 THEN CAST(d.spend AS DOUBLE) / CAST(clicks AS DOUBLE) END AS cpc, CASE WHEN shown AND installs >= 25 THEN CAST(d.spend AS DOUBLE) / CAST(installs AS DOUBLE) END AS cpi,
CASE WHEN b.status IN ('matched_exact', 'matched_confident', 'manually_verified') THEN CASE WHEN children > 1 THEN 'several_children' END WHEN b.status = 'matched_fallback' AND confidence < 0.9 THEN 'low_confidence'
WHEN b.status = 'matched_fallback' AND children > 1 THEN 'embedded_name_several_children' WHEN b.status = 'matched_fallback' THEN 'embedded_name' ELSE coalesce(b.status, 'not_computed') END AS note
FROM (SELECT campaign, sum(spend) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, max(report_date) AS last_day FROM delivery WHERE NOT (campaign = 'c8' AND country = 'DE') GROUP BY 1) d
LEFT JOIN (SELECT campaign, max(name) AS name, max(status) AS campaign_status FROM directory GROUP BY 1) n ON n.campaign = d.campaign
LEFT JOIN (SELECT *, {OPERATIONAL} AS shown FROM {_BEST}) b ON d.campaign = b.source
LEFT JOIN (SELECT source, count(*) AS children, string_agg(target, ',' ORDER BY target) AS targets, sum(installs) AS installs, sum(revenue) AS revenue, max(last_install_day) AS last_install_day FROM
(SELECT DISTINCT source, target FROM mappings WHERE target IS NOT NULL AND status IN ('matched_exact', 'matched_confident', 'manually_verified', 'matched_fallback')) l
LEFT JOIN (SELECT campaign, sum(installs) AS installs, max(install_date) AS last_install_day FROM installs WHERE NOT {ORGANIC} GROUP BY 1) i ON target = i.campaign
LEFT JOIN (SELECT campaign, sum(revenue) AS revenue FROM revenue WHERE NOT {ORGANIC} GROUP BY 1) r ON target = r.campaign GROUP BY 1) c ON d.campaign = c.source"""
_INPUTS = ("delivery", "installs", "revenue", "mappings", "directory")


def _table_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    delivery, installs, revenue, mappings, directory = (view(spark, sf_dir, n) for n in _INPUTS)
    unnamed = F.when((F.col("campaign") == "c8") & (F.col("country") == "DE"), None).otherwise(F.col("campaign"))
    return delivery.withColumn("campaign", unnamed), mappings, installs, revenue, directory


def campaign_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every campaign; some delivery rows name none."""
    return campaigns.campaign_table(*_table_inputs(spark, sf_dir))


def campaign_table_of_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The campaigns without a match, those without a mapping among them."""
    return campaigns.campaign_table(*_table_inputs(spark, sf_dir), status="unmatched")


def campaign_table_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five, by spend."""
    return campaigns.page(campaign_table(spark, sf_dir), "spend", limit=5, offset=5)


ORACLE["campaign_table"] = with_views(_TABLE, *_INPUTS)
ORACLE["campaign_table_of_status"] = with_views(_TABLE + " WHERE coalesce(b.status, 'unmatched') = 'unmatched'", *_INPUTS)
ORACLE["campaign_table_top_k"] = with_views(_TABLE + " ORDER BY spend DESC NULLS LAST, d.campaign LIMIT 5 OFFSET 5", *_INPUTS)


def delivery_without_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 largest campaigns that spend without a usable mapping."""
    out = campaigns.delivery_without_attribution(view(spark, sf_dir, "big_delivery"), view(spark, sf_dir, "mappings"))
    return out.orderBy(F.col("spend").desc(), "campaign").limit(25).withColumn("spend", F.col("spend").cast("double"))


ORACLE["delivery_without_attribution"] = with_views(f"""SELECT campaign, CAST(spend AS DOUBLE) AS spend FROM (SELECT campaign, sum(spend) AS spend FROM big_delivery GROUP BY 1) d
WHERE spend > 0 AND campaign NOT IN (SELECT source FROM mappings WHERE {OPERATIONAL}) ORDER BY d.spend DESC, campaign LIMIT 25""", "big_delivery", "mappings")


def attribution_without_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.attribution_without_mapping(view(spark, sf_dir, "installs"), view(spark, sf_dir, "mappings"))


ORACLE["attribution_without_mapping"] = with_views(f"""SELECT campaign, CAST(sum(installs) AS BIGINT) AS installs, 'not_mapped' AS kind FROM installs
WHERE campaign NOT IN (SELECT target FROM mappings WHERE {OPERATIONAL} AND target IS NOT NULL) GROUP BY 1 HAVING sum(installs) > 0""", "installs", "mappings")


def filter_options_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.filter_options(view(spark, sf_dir, "delivery"), view(spark, sf_dir, "installs"))


ORACLE["filter_options_union"] = with_views("SELECT 'country' AS filter, country AS value FROM delivery UNION SELECT 'country', country FROM installs UNION SELECT 'platform', platform FROM delivery UNION SELECT 'platform', platform FROM installs", "delivery", "installs")


def mapping_best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return populations.best_mapping(view(spark, sf_dir, "big_mappings"))


def strongest_link_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return populations.best_mapping(view(spark, sf_dir, "big_mappings").filter(populations.operational()), "target")


_BIG = _BEST.replace("FROM mappings", "FROM big_mappings")
ORACLE["mapping_best_link"] = with_views(f"SELECT * FROM {_BIG}", "big_mappings")
ORACLE["strongest_link_per_target"] = with_views(f"SELECT DISTINCT ON (target) * FROM big_mappings WHERE {OPERATIONAL} AND target IS NOT NULL ORDER BY target, confidence DESC, status, source", "big_mappings")


def structure_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.structure_coverage(view(spark, sf_dir, "big_mappings"))


ORACLE["structure_coverage"] = with_views(f"SELECT status, method, {OPERATIONAL} AS operational, count(*) AS campaigns FROM {_BIG} GROUP BY 1, 2, 3", "big_mappings")


def eligible_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.delivery_states(view(spark, sf_dir, "delivery"), view(spark, sf_dir, "mappings"))


ORACLE["eligible_coverage"] = with_views(f"""SELECT CASE WHEN campaign IN (SELECT source FROM mappings WHERE {OPERATIONAL}) THEN 'mapped' WHEN campaign IN (SELECT source FROM mappings WHERE status = 'ambiguous') THEN 'ambiguous' ELSE 'unmapped' END AS state,
count(DISTINCT campaign) AS campaigns, CAST(sum(spend) AS DOUBLE) AS spend FROM delivery WHERE {LIVE} GROUP BY 1""", "delivery", "mappings")


def install_state_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.install_states(view(spark, sf_dir, "installs"), view(spark, sf_dir, "mappings"))


ORACLE["install_state_split"] = with_views(f"""SELECT CASE WHEN {ORGANIC} THEN 'organic' WHEN campaign IN (SELECT target FROM mappings WHERE {OPERATIONAL} AND target IS NOT NULL) THEN 'mapped'
WHEN campaign IN (SELECT target FROM mappings WHERE status = 'ambiguous') THEN 'ambiguous' ELSE 'unmapped' END AS state, CAST(sum(installs) AS BIGINT) AS installs, count(DISTINCT campaign) AS campaigns FROM installs GROUP BY 1""", "installs", "mappings")

_SIDES = ("names_marketing", "names_attribution")


def name_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name key is used on either side."""
    out = None
    for side in _SIDES:
        one = view(spark, sf_dir, side).select(F.lit(side).alias("side"), scalars.name_key(F.col("name")).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("key").agg(F.count_if(F.col("side") == _SIDES[0]).alias("marketing"), F.count_if(F.col("side") == _SIDES[1]).alias("attribution"))


#: The compatibility forms that the inputs hold: full-width l, digits and brackets, and a letter with a combining accent.
_KEY = "nullif(trim(regexp_replace(lower(translate(replace({}, 'e\u0301', 'é'), 'ｌ０１２３４５６７８９（）', 'l0123456789()')), '[^a-z0-9]+', ' ', 'g')), '')"
ORACLE["name_key_match"] = with_views(f"SELECT key, count(*) FILTER (side = 1) AS marketing, count(*) FILTER (side = 2) AS attribution FROM (SELECT 1 AS side, {_KEY.format('name')} AS key FROM names_marketing UNION ALL SELECT 2, {_KEY.format('name')} FROM names_attribution) x GROUP BY 1", *_SIDES)


def embedded_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution campaigns by the name in their brackets."""
    rows = view(spark, sf_dir, "names_attribution").select("campaign", F.explode(scalars.embedded_names(F.col("name"))).alias("inner"))
    return rows.groupBy(scalars.name_key(F.col("inner")).alias("key")).agg(F.count("*").alias("n"), F.min("campaign").alias("first"))


ORACLE["embedded_name_match"] = with_views(f"SELECT {_KEY.format('inner_name')} AS key, count(*) AS n, min(campaign) AS first FROM (SELECT campaign, unnest(regexp_extract_all(name, '\\(([^()]+)\\)', 1)) AS inner_name FROM names_attribution) x GROUP BY 1", "names_attribution")


def reconcile_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(*(view(spark, sf_dir, n) for n in _SIDES))


_PAID_NAMES = "(SELECT * FROM names_attribution WHERE coalesce(media_source, 'Organic') <> 'Organic')"
ORACLE["reconcile_precedence"] = with_views("", *_SIDES).rstrip() + f""", m AS (SELECT campaign AS source, {_KEY.format('name')} AS key FROM names_marketing), u AS (SELECT key, count(*) AS uses FROM m WHERE key IS NOT NULL GROUP BY 1),
t AS (SELECT campaign AS target, {_KEY.format('name')} AS whole, {_KEY.format("unnest(list_concat([NULL], regexp_extract_all(name, '[(]([^()]+)[)]', 1)))")} AS inside FROM {_PAID_NAMES} pn
  WHERE campaign NOT IN (SELECT source FROM m) AND coalesce(remote_id, '') NOT IN (SELECT source FROM m)),
k AS (SELECT DISTINCT target, key, embedded FROM (SELECT target, whole AS key, FALSE AS embedded FROM t UNION ALL SELECT target, inside, TRUE FROM t WHERE inside IS DISTINCT FROM whole) x WHERE key IS NOT NULL),
c AS (SELECT key, count(*) FILTER (embedded) AS inside, count(*) FILTER (NOT embedded) AS bare, min(target) FILTER (NOT embedded) AS bare_target FROM k GROUP BY 1),
e AS (SELECT remote_id AS source, campaign AS target, 'matched_exact' AS status, 'remote_id' AS method, 1.0 AS confidence, 1 AS priority FROM {_PAID_NAMES} pn WHERE remote_id IN (SELECT source FROM m)
  UNION ALL SELECT DISTINCT source, source, 'matched_exact', 'stable_id', 1.0, 2 FROM m WHERE source IN (SELECT campaign FROM {_PAID_NAMES} pn)
  UNION ALL SELECT source, NULL, 'ambiguous', 'name', 0.25, 3 FROM m JOIN u USING (key) JOIN c USING (key) WHERE uses > 1
  UNION ALL SELECT source, target, 'matched_fallback', 'embedded_name', 0.9, 4 FROM m JOIN u USING (key) JOIN k USING (key) WHERE uses = 1 AND embedded
  UNION ALL SELECT source, bare_target, 'matched_fallback', 'name', 0.5, 5 FROM m JOIN u USING (key) JOIN c USING (key) WHERE uses = 1 AND inside = 0 AND bare = 1
  UNION ALL SELECT source, NULL, 'ambiguous', 'name', 0.25, 6 FROM m JOIN u USING (key) JOIN c USING (key) WHERE uses = 1 AND inside = 0 AND bare > 1
  UNION ALL SELECT source, NULL, 'unmatched', 'none', 0.0, 7 FROM m)
SELECT DISTINCT source, target, status, method, CAST(confidence AS DOUBLE) AS confidence FROM e QUALIFY priority = min(priority) OVER (PARTITION BY source)"""


def remote_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each remote id leads: at the levels of its pair of providers, in their order."""
    return reconcile.resolve_levels(*(view(spark, sf_dir, n) for n in ("remote_ids", "names_marketing", "ad_groups")))


ORACLE["remote_resolution"] = with_views("""SELECT target, remote_id, attribution_provider, marketing_provider, CASE WHEN by_group THEN 'ad_group' ELSE 'campaign' END AS entity_type, CASE WHEN by_group THEN g.campaign ELSE m.campaign END AS source,
CASE WHEN by_group THEN 'remote_ad_group' ELSE 'remote_campaign' END AS method, CAST(1 AS DOUBLE) AS confidence, CASE WHEN by_group THEN p.name ELSE m.name END AS source_name
FROM (SELECT r.*, attribution_provider = 'tenjin' AND marketing_provider = 'meta_ads' AND remote_id IN (SELECT ad_group FROM ad_groups WHERE campaign IS NOT NULL) AS by_group FROM remote_ids r WHERE remote_id IS NOT NULL) r
LEFT JOIN ad_groups g ON g.ad_group = remote_id LEFT JOIN names_marketing p ON p.campaign = g.campaign LEFT JOIN names_marketing m ON m.campaign = remote_id WHERE by_group OR m.campaign IS NOT NULL""", "remote_ids", "names_marketing", "ad_groups")


def reconcile_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution campaigns by how they find a marketing campaign, those that an identifier has linked left out; every
    thirteenth is settled by a human."""
    marketing, attribution = (view(spark, sf_dir, n) for n in _SIDES)
    decided = attribution.filter("CAST(substr(campaign, 2) AS BIGINT) % 13 = 5").select(F.col("campaign").alias("target"))
    return reconcile.reverse(attribution, marketing, decided)


ORACLE["reconcile_reverse"] = with_views("", *_SIDES).rstrip() + f""", u AS (SELECT {_KEY.format('name')} AS key, count(*) AS uses, min(campaign) AS named FROM names_marketing GROUP BY 1),
a AS (SELECT campaign, media_source, name, coalesce(media_source, 'Organic') = 'Organic' AS organic FROM names_attribution WHERE coalesce(media_source, 'Organic') = 'Organic'
  OR (coalesce(remote_id, '') NOT IN (SELECT campaign FROM names_marketing) AND CAST(substr(campaign, 2) AS BIGINT) % 13 <> 5)),
l AS (SELECT campaign, list_filter(list_distinct(list_concat([{_KEY.format('name')}], list_transform(regexp_extract_all(name, '[(]([^()]+)[)]', 1), lambda x: {_KEY.format('x')}))), lambda k: k IS NOT NULL) AS keys,
  {_KEY.format('name')} AS whole FROM a WHERE NOT organic),
k AS (SELECT campaign, whole, unnest(keys) AS key FROM l),
f AS (SELECT campaign, sum(uses) AS matches, min(named) AS named, max((key <> whole AND uses = 1)::INT) AS embedded FROM k JOIN u USING (key) GROUP BY 1),
r AS (SELECT a.campaign, organic, a.campaign IN (SELECT campaign FROM names_marketing) AS same, coalesce(matches, 0) AS matches, named, coalesce(embedded, 0) = 1 AS embedded FROM a LEFT JOIN f USING (campaign))
SELECT campaign AS target, CASE WHEN organic THEN NULL WHEN same THEN campaign WHEN matches = 1 THEN named END AS source,
CASE WHEN organic THEN 'not_applicable' WHEN same THEN 'matched_exact' WHEN matches = 1 THEN 'matched_fallback' ELSE 'unmatched' END AS status,
CASE WHEN organic THEN 'none' WHEN same THEN 'stable_id' WHEN embedded THEN 'embedded_name' ELSE 'name' END AS method,
CAST(CASE WHEN organic THEN 0 WHEN same THEN 1 WHEN matches = 1 AND embedded THEN 0.9 WHEN matches = 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence FROM r"""

QUERIES |= {f.__name__: f for f in (
    campaign_table, campaign_table_of_status, campaign_table_top_k, delivery_without_attribution, attribution_without_mapping, filter_options_union, mapping_best_link, strongest_link_per_target, structure_coverage, eligible_coverage,
    install_state_split, name_key_match, embedded_name_match, reconcile_precedence, reconcile_reverse, remote_resolution,
)}
