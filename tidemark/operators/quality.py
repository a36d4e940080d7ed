"""Data-quality checks as one pass over a batch: every row yields the findings whose predicate it meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Check = tuple[Column, str, str]


def findings(rows: DataFrame, checks: list[Check], entity: str, day: str) -> DataFrame:
    """check_key, severity, entity, day: one row for each check that a row fails."""
    made = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("check_key"), F.lit(s).alias("severity"))) for c, k, s in checks)))
    return rows.select(F.col(entity).alias("entity"), F.col(day).alias("day"), F.explode(made).alias("f")).select("f.*", "entity", "day")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and extra: how many rows beyond the first each repeated key has."""
    return rows.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def check_marketing(batch: DataFrame, first: str, last: str, keys: list[str]) -> DataFrame:
    """The seven checks of a delivery batch over the window it was asked for."""
    day = F.col("report_date")
    some = lambda f: f(F.col("spend"), F.col("impressions"), F.col("clicks"))
    checks: list[Check] = [
        (~day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), "marketing.date_outside_window", "warning"),
        (some(lambda s, i, c: (s < 0) | (i < 0) | (c < 0)), "marketing.negative_measure", "error"),
        (some(lambda s, i, c: (i > 0) & (c > i * 2)), "marketing.clicks_exceed_impressions", "warning"),
        (some(lambda s, i, c: (s > 0) & (i == 0) & (c == 0)), "marketing.spend_without_delivery", "warning"),
        (F.coalesce("campaign", F.lit("")) == "", "marketing.missing_campaign_id", "error"),
        (~F.coalesce("currency", F.lit("")).rlike("^[A-Z]{3}$"), "marketing.invalid_currency", "warning"),
    ]
    twice = duplicates(batch, keys).select(F.lit("marketing.duplicate_dimension_tuple").alias("check_key"), F.lit("warning").alias("severity"), F.col("campaign").alias("entity"), day.alias("day"), F.explode(F.sequence(F.lit(1), F.col("extra").cast("int"))).alias("n")).drop("n")
    return findings(batch, checks, "campaign", "report_date").unionByName(twice)


def check_attribution(installs: DataFrame, revenue: DataFrame, cohorts: DataFrame, first: str, last: str, identity: list[str]) -> DataFrame:
    """The five checks of an attribution batch."""
    day = F.col("install_date")
    checks: list[Check] = [
        (~day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), "attribution.date_outside_window", "warning"),
        (F.col("installs") < 0, "attribution.negative_installs", "error"),
        ((F.coalesce("campaign", F.lit("")) == "") & (F.col("installs") > 0), "attribution.missing_campaign_id", "warning"),
    ]
    out = findings(installs, checks, "campaign", "install_date")
    out = out.unionByName(findings(revenue, [(F.col("revenue") < 0, "attribution.negative_revenue", "warning")], "campaign", "event_date"))
    return out.unionByName(findings(not_cumulative(cohorts, identity), [(F.lit(True), "attribution.cohort_not_cumulative", "error")], "campaign", "install_date"))


def not_cumulative(cohorts: DataFrame, identity: list[str]) -> DataFrame:
    """Cohort rows whose revenue is below that of the age before."""
    before = F.lag("revenue").over(Window.partitionBy(*identity).orderBy("age"))
    return cohorts.withColumn("before", before).filter("revenue < before")


def row_count_anomaly(n: Column, trailing: Column) -> Column:
    """Whether a batch has a quarter or less, or four times or more, of the rows that were usual (ten at least)."""
    return F.coalesce((trailing >= 10) & ~((n / trailing > 0.25) & (n / trailing < 4)), F.lit(False))


def current(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings that no run completed later has read anew."""
    days = runs.select(F.explode(F.sequence("from_date", "to_date")).alias("day"), "finished").groupBy("day").agg(F.max("finished").alias("finished"))
    return found.join(days, (found["day"] == days["day"]) & (days["finished"] > found["found_at"]), "left_anti")


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("check_key", "severity").agg(F.count("*").alias("n"))
