"""Domain inputs as views over the driver's tables, in SQL that Spark and DuckDB both read.

Everything is deterministic and has no clock. Money is DECIMAL(20,6), counts are BIGINT, dates are DATE.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PLACE = """CASE CAST(floor(user_id / 12) AS BIGINT) % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' ELSE 'DE' END AS country,
    CASE WHEN CAST(floor(user_id / 36) AS BIGINT) % 2 = 0 THEN 'ios' ELSE 'android' END AS platform"""
_SOURCE = "CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 'Organic' WHEN user_id % 2 = 0 THEN 'Facebook Ads' ELSE 'tiktok_ads' END AS media_source"
_FIRST = "SELECT user_id AS id, min(CAST(ts AS DATE)) AS install_date FROM events WHERE event_type = 'signup' GROUP BY user_id"

#: SQL by name; marketing and attribution names share the whole of part between them.
VIEWS: dict[str, str] = {
    "delivery": f"""SELECT CAST(ts AS DATE) AS report_date, 'c' || CAST(user_id % 12 AS STRING) AS campaign, {_PLACE},
    'meta_ads' AS provider, CASE WHEN user_id % 12 = 11 THEN 'EUR' ELSE 'USD' END AS currency,
    CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(20,6)) ELSE 0 END) AS DECIMAL(20,6)) AS spend,
    count(CASE WHEN event_type = 'view' THEN 1 END) AS impressions, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks,
    CAST(sum(CASE WHEN user_id % 4 <> 0 THEN NULL WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS link_clicks
    FROM events GROUP BY 1, 2, 3, 4, 6""",
    "installs": f"""SELECT install_date, 'a' || CAST(user_id % 12 AS STRING) AS campaign, {_PLACE}, {_SOURCE}, count(*) AS installs
    FROM (SELECT id AS user_id, install_date FROM ({_FIRST}) f) i GROUP BY 1, 2, 3, 4, 5""",
    "revenue": f"""SELECT CAST(ts AS DATE) AS event_date, 'a' || CAST(user_id % 12 AS STRING) AS campaign, {_PLACE}, {_SOURCE},
    CASE WHEN event_type = 'purchase' THEN 'iap' ELSE 'ad' END AS revenue_type, CASE WHEN user_id % 12 = 11 THEN 'EUR' ELSE 'USD' END AS currency,
    CAST(sum(CAST(value AS DECIMAL(20,6))) AS DECIMAL(20,6)) AS revenue
    FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "cohorts": f"""WITH base AS (SELECT install_date, 'a' || CAST(user_id % 12 AS STRING) AS campaign, {_PLACE}, {_SOURCE}, CAST(age AS INT) AS age,
    CASE WHEN event_type = 'purchase' THEN 'iap' ELSE 'ad' END AS revenue_type, CASE WHEN user_id % 12 = 11 THEN 'EUR' ELSE 'USD' END AS currency,
    CAST(sum(CAST(value AS DECIMAL(20,6))) AS DECIMAL(20,6)) AS revenue
    FROM events JOIN ({_FIRST}) f ON user_id = id JOIN (SELECT 1 AS age UNION ALL SELECT 7) g ON CAST(ts AS DATE) BETWEEN install_date AND install_date + age
    WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
    whole AS (SELECT install_date, campaign, country, platform, media_source, age, 'total' AS revenue_type, currency, CAST(sum(revenue) AS DECIMAL(20,6)) AS revenue
    FROM base WHERE country = 'GB' OR (campaign = 'a3' AND country = 'DE') GROUP BY 1, 2, 3, 4, 5, 6, 8)
    SELECT *, CAST(install_date + age + CASE WHEN CAST(day(install_date) AS INT) % 9 = 0 THEN 0 ELSE 2 END AS DATE) AS read_on
    FROM (SELECT * FROM base WHERE NOT (campaign = 'a3' AND country = 'DE') UNION ALL SELECT * FROM whole) x""",
    "mappings": """SELECT 'c' || CAST(n AS STRING) AS source, CASE WHEN n <> 7 THEN 'a' || CAST(n AS STRING) END AS target,
    CASE n WHEN 1 THEN 'matched_confident' WHEN 2 THEN 'manually_verified' WHEN 3 THEN 'matched_fallback' WHEN 4 THEN 'matched_fallback' WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'rejected' WHEN 7 THEN 'unmatched' WHEN 11 THEN 'matched_confident' ELSE 'matched_exact' END AS status,
    CASE n WHEN 1 THEN 'remote_id' WHEN 2 THEN 'manual' WHEN 3 THEN 'name' WHEN 4 THEN 'name' WHEN 5 THEN 'name' WHEN 6 THEN 'manual' WHEN 7 THEN 'none' WHEN 11 THEN 'remote_id' ELSE 'stable_id' END AS method,
    CAST(CASE n WHEN 1 THEN 0.98 WHEN 3 THEN 0.9 WHEN 4 THEN 0.5 WHEN 5 THEN 0.25 WHEN 6 THEN 0 WHEN 7 THEN 0 WHEN 11 THEN 0.98 ELSE 1 END AS DOUBLE) AS confidence
    FROM (SELECT DISTINCT user_id % 12 AS n FROM events WHERE user_id % 12 <> 9) x
    UNION ALL SELECT 'c' || CAST(n AS STRING), CASE n WHEN 0 THEN 'a9' ELSE 'a8' END, 'matched_fallback', 'name', CAST(0.9 AS DOUBLE) FROM (SELECT DISTINCT user_id % 12 AS n FROM events WHERE user_id % 12 IN (0, 10)) y""",
    "big_mappings": """SELECT 'c' || CAST(l_suppkey AS STRING) AS source, 'a' || CAST(l_partkey AS STRING) AS target,
    CASE (l_partkey + l_suppkey) % 7 WHEN 0 THEN 'matched_exact' WHEN 1 THEN 'matched_confident' WHEN 2 THEN 'manually_verified' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'rejected' ELSE 'matched_fallback' END AS status,
    CASE (l_partkey + l_suppkey) % 7 WHEN 0 THEN 'stable_id' WHEN 1 THEN 'remote_id' WHEN 2 THEN 'manual' WHEN 4 THEN 'manual' ELSE 'name' END AS method, CAST(l_partkey % 11 AS DOUBLE) / 10 AS confidence
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 10 <> 3) x""",
    "app_runs": f"""WITH seen AS (SELECT country || '-' || platform AS app, day, max(ts) AS seen_at FROM (SELECT {_PLACE}, CAST(ts AS DATE) AS day, CAST(ts AS TIMESTAMP) AS ts FROM events) e GROUP BY 1, 2),
    types AS (SELECT 'marketing_performance' AS data_type UNION ALL SELECT 'attribution_installs' UNION ALL SELECT 'attribution_revenue')
    SELECT app, data_type, 'completed' AS status, seen_at AS finished_at, CASE WHEN app = 'GB-ios' AND data_type = 'attribution_installs' THEN CAST(day - CAST(2 AS INT) AS DATE) ELSE day END AS latest_day
    FROM seen CROSS JOIN types WHERE app <> 'GB-android' OR day < (SELECT max(day) FROM seen)
    UNION ALL SELECT app, 'marketing_performance', 'failed', max(seen_at) + INTERVAL 1 MINUTE, NULL FROM seen WHERE app = 'DE-ios' GROUP BY 1""",
    "app_bindings": f"""SELECT app, role FROM (SELECT DISTINCT country || '-' || platform AS app FROM (SELECT {_PLACE} FROM events) e) a
    CROSS JOIN (SELECT 'marketing' AS role UNION ALL SELECT 'attribution') r WHERE app <> 'US-android' OR role <> 'marketing'""",
    "app_capabilities": f"""SELECT app, capability, NOT (capability = 'link_clicks' AND app LIKE '%-ios') AND NOT (capability = 'cohort_ad_revenue_d7' AND app LIKE 'DE-%') AS supported
    FROM (SELECT DISTINCT country || '-' || platform AS app FROM (SELECT {_PLACE} FROM events) e) a CROSS JOIN (SELECT 'cost_data' AS capability UNION ALL SELECT 'delivery_metrics' UNION ALL SELECT 'link_clicks'
    UNION ALL SELECT 'attributed_installs' UNION ALL SELECT 'attributed_revenue' UNION ALL SELECT 'cohort_reporting' UNION ALL SELECT 'cohort_total_revenue_d1' UNION ALL SELECT 'cohort_total_revenue_d7'
    UNION ALL SELECT 'cohort_iap_revenue_d1' UNION ALL SELECT 'cohort_iap_revenue_d7' UNION ALL SELECT 'cohort_ad_revenue_d1' UNION ALL SELECT 'cohort_ad_revenue_d7') k""",
    "apps": "SELECT 'app' || CAST(n AS STRING) AS app, CASE n WHEN 0 THEN 'America/New_York' ELSE 'UTC' END AS zone FROM (SELECT DISTINCT user_id % 2 AS n FROM events) x",
    "runs": """SELECT data_type || '-' || CAST(day AS STRING) AS run, 'app' || CAST(n % 2 AS STRING) AS app, 'k' || CAST(n % 3 AS STRING) AS connection, data_type,
    CASE WHEN n % 13 = 0 THEN 'failed' WHEN n % 4 = 0 THEN 'partially_completed' ELSE 'completed' END AS status, day AS window_start, CAST(day + CAST(2 AS INT) AS DATE) AS window_end,
    CAST(day + CAST(4 + n % 9 AS INT) AS TIMESTAMP) + INTERVAL 3 HOUR AS finished_at,
    '{"dataWindows":[{"from":"' || CAST(day AS STRING) || '","to":"' || CAST(CAST(day + CAST(1 AS INT) AS DATE) AS STRING) || '"},{"from":"' || CAST(CAST(day + CAST(2 AS INT) AS DATE) AS STRING) || '","to":"' || CAST(CAST(day + CAST(2 AS INT) AS DATE) AS STRING)
     || '"}],"completedWindows":["' || CAST(day AS STRING) || '..' || CAST(CAST(day + CAST(1 AS INT) AS DATE) AS STRING) || '"]}' AS checkpoint
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(day(ts) AS INT) AS n FROM events) d JOIN (SELECT 'attribution_installs' AS data_type UNION ALL SELECT 'attribution_revenue') t ON TRUE""",
    "run_errors": """SELECT 'attribution_installs-' || CAST(day AS STRING) AS run, CASE WHEN n % 3 = 0 THEN NULL ELSE day END AS window_start, CASE WHEN n % 5 = 0 THEN NULL ELSE CAST(day + CAST(1 AS INT) AS DATE) END AS window_end,
    CASE WHEN n % 2 = 0 THEN CAST(day AS TIMESTAMP) END AS resolved_at FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(day(ts) AS INT) AS n FROM events WHERE day(ts) % 7 = 0) d""",
    "findings": """SELECT CASE WHEN n % 6 <> 0 THEN 'attribution_installs-' || CAST(day AS STRING) END AS run, CASE n % 4 WHEN 0 THEN 'attribution.negative_installs' WHEN 1 THEN 'attribution.missing_campaign_id' WHEN 2 THEN 'marketing.negative_measure' ELSE 'reconciliation.paid_installs_unmapped' END AS check_key,
    CASE n % 4 WHEN 0 THEN 'error' WHEN 2 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN n % 10 <> 0 THEN day END AS observed, CAST(day + CAST(CASE WHEN n % 2 = 0 THEN 30 ELSE 1 END AS INT) AS TIMESTAMP) AS created_at
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(day(ts) AS INT) AS n FROM events WHERE day(ts) % 5 < 2) d""",
    "coverage": """SELECT day AS from_date, CAST(day + CAST(n % 3 AS INT) AS DATE) AS to_date, CAST(day + CAST(3 + n % 10 AS INT) AS DATE) AS finished
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(day(ts) AS INT) AS n FROM events WHERE day(ts) % 5 <> 4) d""",
    "directory": """SELECT 'c' || CAST(user_id % 12 AS STRING) AS campaign, 'Campaign ' || CAST(user_id % 12 AS STRING) AS name, CASE WHEN user_id % 12 > 8 THEN 'PAUSED' ELSE 'ACTIVE' END AS status FROM events WHERE user_id % 12 <> 4 GROUP BY 1, 2, 3""",
    "big_delivery": """SELECT CAST(l_shipdate AS DATE) AS report_date, 'c' || CAST(l_suppkey AS STRING) AS campaign, s_nationkey AS account,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(20,6)) * CAST(1 - l_discount AS DECIMAL(6,2))) AS DECIMAL(20,6)) AS spend,
    CAST(sum(l_quantity * 100) AS BIGINT) AS impressions, CAST(sum(l_quantity) AS BIGINT) AS clicks
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
    "big_installs": """SELECT CAST(o_orderdate AS DATE) AS install_date, 'c' || CAST(o_custkey % 100 AS STRING) AS campaign, c_mktsegment AS segment,
    CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'Organic' WHEN '1-URGENT' THEN 'Facebook Ads' WHEN '2-HIGH' THEN 'google adwords' WHEN '3-MEDIUM' THEN 'tiktok_ads' ELSE 'unknown_net' END AS media_source, count(*) AS installs
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""",
    "stored": """SELECT l_suppkey AS campaign, CAST(l_shipdate AS DATE) AS report_date, l_returnflag AS country, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,6))) AS DECIMAL(20,6)) AS spend, CAST(sum(l_quantity) AS BIGINT) AS clicks
    FROM lineitem WHERE l_suppkey % 4 < 3 GROUP BY 1, 2, 3""",
    "written": """SELECT l_suppkey AS campaign, CAST(l_shipdate AS DATE) AS report_date, l_returnflag AS country, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,6))) AS DECIMAL(20,6)) AS spend, CAST(sum(l_quantity) + CASE WHEN l_suppkey % 8 = 2 THEN 1 ELSE 0 END AS BIGINT) AS clicks
    FROM lineitem WHERE l_suppkey % 4 >= 1 AND (l_returnflag <> 'R' OR l_suppkey % 3 > 0) GROUP BY 1, 2, 3""",
    "names_marketing": """SELECT 'm' || CAST(p_partkey AS STRING) AS campaign, CASE p_partkey % 9 WHEN 0 THEN translate(p_name, 'l0123456789', 'ｌ０１２３４５６７８９') WHEN 1 THEN p_name || ' é' ELSE p_name END AS name
    FROM part WHERE p_partkey % 2 = 0""",
    "ad_groups": """SELECT CASE WHEN p_partkey % 6 = 1 THEN 'm' ELSE 'g' END || CAST(p_partkey + 1 AS STRING) AS ad_group, CASE WHEN p_partkey % 10 <> 3 THEN 'm' || CAST(p_partkey + 3 AS STRING) END AS campaign
    FROM part WHERE p_partkey % 2 = 1""",
    "remote_ids": """SELECT 't' || CAST(p_partkey AS STRING) AS target, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'g' || CAST(p_partkey + 1 AS STRING) ELSE 'm' || CAST(p_partkey + p_partkey % 2 AS STRING) END AS remote_id,
    CASE WHEN p_partkey % 3 = 0 THEN 'appsflyer' ELSE 'tenjin' END AS attribution_provider, CASE WHEN p_partkey % 5 = 0 THEN 'google_ads' ELSE 'meta_ads' END AS marketing_provider FROM part""",
    "names_attribution": """SELECT CASE WHEN p_partkey % 11 = 0 THEN 'm' || CAST(p_partkey + 1 AS STRING) ELSE 't' || CAST(p_partkey AS STRING) END AS campaign,
    CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 9 = 1 THEN '（' || p_name || '） e\u0301' WHEN p_partkey % 9 = 2 THEN '(' || p_name || ') & (' || p_name || ' 2)' ELSE 'Creative_' || CAST(p_partkey AS STRING) || ' (' || p_name || ')' END AS name,
    CASE WHEN p_partkey % 7 = 0 THEN 'm' || CAST(p_partkey + 1 AS STRING) END AS remote_id, CASE p_partkey % 13 WHEN 0 THEN 'Organic' WHEN 1 THEN NULL ELSE 'Facebook Ads' END AS media_source FROM part WHERE p_partkey % 2 = 1""",
}
_TABLES = ("events", "lineitem", "orders", "customer", "supplier", "part")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain input as a DataFrame; only the tables it names are read."""
    # Braces of literals are doubled, for spark.sql puts tables where single ones name them.
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(_TABLES)})\b", r"\1 {\2}", sql), **used)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where none is configured and all runs in one process."""
    jsc = spark.sparkContext._jsc.sc()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-shared-"))
    return f"{root or jsc.getCheckpointDir().get()}/tidemark-tables"


def held(df: DataFrame) -> DataFrame:
    """df computed once and written as Parquet to the shared folder, for facts that a query uses many times: later readers
    prune columns and rows, and lost executors cost nothing."""
    path = f"{shared_root(df.sparkSession)}/held/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL over the named inputs."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
