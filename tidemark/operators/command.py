"""The command centre: one snapshot of metrics, series, campaigns, gaps, feeds, runs and findings over shared facts.

Each fact table is summed once to cells (day, campaign and what populations tell apart) and written; every section reads the
cells, so all of them describe the same rows and no section scans facts again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates, campaigns, metrics, runs

#: Rows that the lists of the snapshot show.
TOP_CAMPAIGNS, TOP_GAPS, TOP_RUNS, TOP_FINDINGS = 25, 10, 5, 10


def cells(delivery: DataFrame, installs: DataFrame, revenue: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three fact tables as cells, each kept (written once) by what is given."""
    spent = delivery.groupBy("report_date", "campaign", "provider", "currency").agg(*(F.sum(c).alias(c) for c in ("spend", "impressions", "clicks", "link_clicks")))
    taken = installs.groupBy("install_date", "campaign", "media_source").agg(F.sum("installs").alias("installs"))
    earned = revenue.groupBy("event_date", "campaign", "media_source", "revenue_type", "currency").agg(F.sum("revenue").alias("revenue"))
    return keep(spent), keep(taken), keep(earned)


def _section(name: str, rows: DataFrame, label: Column, amount: Column | None = None, state: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        F.lit(name).alias("section"), label.cast("string").alias("label"), (none if amount is None else amount).cast("double").alias("amount"), (none if state is None else state).cast("string").alias("state")
    )


def snapshot(spent: DataFrame, taken: DataFrame, earned: DataFrame, mappings: DataFrame, streams: DataFrame, log: DataFrame, findings: DataFrame, bindings: DataFrame) -> DataFrame:
    """section, label, amount, state. streams: data_type, status, last_success; log: run, status, finished_at; findings:
    check_key, severity, observed; bindings: role."""
    c = F.col
    days = aggregates.timeseries(spent, taken, earned)
    table = campaigns.page(campaigns.campaign_table(spent, mappings, taken, earned), "spend", limit=TOP_CAMPAIGNS)
    gaps = campaigns.delivery_without_attribution(spent, mappings).orderBy(c("spend").desc(), "campaign").limit(TOP_GAPS)
    noted = findings.groupBy("check_key", "severity").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "check_key").limit(TOP_FINDINGS)
    seen = streams.groupBy(F.split_part("data_type", F.lit("_"), F.lit(1)).alias("role")).agg(F.count("last_success").alias("succeeded"))
    n_rows = spent.agg(F.lit("marketing").alias("role"), F.count("*").alias("n")).unionByName(taken.agg(F.lit("attribution").alias("role"), F.count("*").alias("n")))
    roles = n_rows.join(bindings.groupBy("role").agg(F.count("*").alias("bound")), "role", "left").join(seen, "role", "left")
    empty = runs.empty_state(F.coalesce("bound", F.lit(0)) > 0, F.coalesce("succeeded", F.lit(0)) > 0, c("n"))
    parts = [
        _section("metric", metrics.operational_metrics(spent, taken, earned, mappings), c("metric"), c("value"), c("availability")),
        *(_section(f"{m}_by_day", days.filter(c(m).isNotNull()), c("day"), c(m)) for m in ("spend", "installs", "revenue")),
        _section("campaign", table, c("campaign"), c("spend"), c("mapping_status")),
        _section("unlinked", gaps, c("campaign"), c("spend")),
        _section("ambiguous", mappings.filter("status = 'ambiguous'"), c("source"), c("confidence")),
        _section("feed", streams, c("data_type"), None, c("status")),
        _section("run", runs.recent(log, "finished_at", TOP_RUNS, "run"), c("run"), None, c("status")),
        _section("finding", noted, c("check_key"), c("n"), c("severity")),
        _section("empty", roles.filter(empty.isNotNull()), c("role"), None, empty),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
