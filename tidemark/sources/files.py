"""File sources: CSV reports and JSON pages turned into canonical facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars


def header_name(raw: str) -> str:
    """A header in snake case."""
    return re.sub(r"[^a-z0-9]+", "_", raw.strip().lstrip("﻿").lower()).strip("_")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with quotes, doubled quotes and line breaks in fields; all columns are strings under normal names."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return raw.toDF(*map(header_name, raw.columns))


def capabilities(table: DataFrame, wanted: dict[str, str]) -> dict[str, bool]:
    """Which capabilities a report's columns serve: {capability: column}."""
    return {name: column in table.columns for name, column in wanted.items()}


def optional(table: DataFrame, *names: str):
    """The first of the named columns that the table has and that isn't blank, else null."""
    there = [F.col(n) for n in names if n in table.columns]
    return scalars.first_present(*there) if there else F.lit(None).cast("string")


INSIGHT = "date_start string, campaign_id string, campaign_name string, country string, impression_device string, spend string, impressions string, clicks string, inline_link_clicks string, account_currency string"


def read_insights(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of paged JSON insights: {"data": [...]} documents, one a file, or one a line."""
    return spark.read.schema(f"data array<struct<{re.sub(r'(\w+) string', r'\1:string', INSIGHT)}>>").json(path, multiLine=not lines).select(F.inline("data"))


def delivery_facts(insights: DataFrame) -> DataFrame:
    """Canonical delivery rows, and those without day or campaign marked rejected. What isn't reported stays null."""
    count = lambda c: F.col(c).try_cast("bigint")
    return insights.select(
        scalars.iso_date(F.substr("date_start", F.lit(1), F.lit(10))).alias("report_date"), scalars.blank_to_null(F.col("campaign_id")).alias("campaign"), scalars.country_code(F.col("country")).alias("country"), scalars.platform(F.col("impression_device")).alias("platform"),
        F.upper("account_currency").alias("currency"), F.coalesce(F.col("spend").try_cast("decimal(20,6)"), F.lit(0)).cast("decimal(20,6)").alias("spend"), F.coalesce(count("impressions"), F.lit(0)).alias("impressions"), F.coalesce(count("clicks"), F.lit(0)).alias("clicks"), count("inline_link_clicks").alias("link_clicks"),
    ).withColumn("rejected", F.col("report_date").isNull() | F.col("campaign").isNull())


def budgets(campaigns: DataFrame, ad_groups: DataFrame) -> DataFrame:
    """campaign, daily, source: a campaign's daily budget in major units, else the sum of its ad groups'."""
    major = lambda c: (F.col(c).try_cast("decimal(20,6)") / 100).cast("decimal(20,6)")
    below = ad_groups.groupBy("campaign").agg(F.sum(major("daily_budget")).cast("decimal(20,6)").alias("below"))
    rows = campaigns.select("campaign", major("daily_budget").alias("own")).join(below, "campaign", "left")
    return rows.select("campaign", F.coalesce(F.when(F.col("own") > 0, F.col("own")), "below").alias("daily"), F.when(F.col("own") > 0, "campaign").when(F.col("below").isNotNull(), "ad_groups").alias("source"))


def install_facts(raw: DataFrame) -> DataFrame:
    """One CSV row is one install: counts by day, source, campaign, country and platform."""
    keys = {
        "install_date": scalars.iso_date(F.substr(optional(raw, "install_time", "install_date"), F.lit(1), F.lit(10))), "media_source": optional(raw, "media_source"), "campaign": optional(raw, "campaign_id", "campaign"),
        "country": scalars.country_code(optional(raw, "country_code", "country")), "platform": scalars.platform(optional(raw, "platform", "os")),
    }
    return raw.select(*(c.alias(k) for k, c in keys.items())).filter("install_date IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("installs"))


def event_facts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event counts, and in-app revenue of events that carry an amount, from one raw events report."""
    rows = raw.select(
        scalars.iso_date(F.substr(optional(raw, "event_time"), F.lit(1), F.lit(10))).alias("event_date"), optional(raw, "event_name").alias("event_name"), optional(raw, "media_source").alias("media_source"), optional(raw, "campaign_id", "campaign").alias("campaign"),
        scalars.country_code(optional(raw, "country_code", "country")).alias("country"), scalars.platform(optional(raw, "platform", "os")).alias("platform"), F.upper(optional(raw, "event_revenue_currency")).alias("currency"), F.regexp_replace(optional(raw, "event_revenue"), ",", "").try_cast("decimal(20,6)").alias("amount"),
    ).filter("event_date IS NOT NULL")
    keys = ["event_date", "media_source", "campaign", "country", "platform"]
    counts = rows.groupBy(*keys, "event_name").agg(F.count("*").alias("events"))
    revenue = rows.filter("amount <> 0").groupBy(*keys, "currency").agg(F.sum("amount").cast("decimal(20,6)").alias("revenue")).withColumn("revenue_type", F.lit("iap"))
    return counts, revenue


def unpivot_revenue(report: DataFrame, keys: list[str]) -> DataFrame:
    """A wide report (iap, ad, total; iap_1d, ad_7d, ...) as rows of type, age (null: event day) and revenue.

    Components come before totals: a total is kept only where neither component is reported. Null isn't 0; zeros are
    left out; cohort rows need installs.
    """
    value = lambda n: (F.col(n) if n in report.columns else F.lit(None)).cast("decimal(20,6)")
    made = []
    for age in (None, *vocab.COHORT_AGES):
        tail = "" if age is None else f"_{age}d"
        parts = value(f"iap{tail}").isNotNull() | value(f"ad{tail}").isNotNull()
        able = F.lit(True) if age is None or "installs" not in report.columns else F.col("installs") > 0
        for kind in ("iap", "ad", "total"):
            usable = value(f"{kind}{tail}").isNotNull() & (value(f"{kind}{tail}") != 0) & able & (~parts if kind == "total" else F.lit(True))
            made.append(F.when(usable, F.struct(F.lit(kind).alias("revenue_type"), F.lit(age).cast("int").alias("age"), value(f"{kind}{tail}").alias("revenue"))))
    return report.select(*keys, F.inline(F.array_compact(F.array(*made))))


def covered_window(rows: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """n, skipped, from_date, to_date: rows within the window, those outside, and the days that the report covers."""
    inside = F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return rows.agg(F.count_if(inside).alias("n"), F.count_if(~inside).alias("skipped"), F.min(F.when(inside, F.col(day))).alias("from_date"), F.max(F.when(inside, F.col(day))).alias("to_date"))


def group_tokens(text: str, known: tuple[str, ...] = ("date", "campaign", "country", "platform")) -> tuple[list[str], list[str]]:
    """Known and unknown grouping tokens of a saved report, each once, in order."""
    tokens = list(dict.fromkeys(t for t in re.split(r"[,_\s]+", text.lower()) if t))
    return [t for t in tokens if t in known], [t for t in tokens if t not in known]


def best_report(reports: DataFrame) -> DataFrame:
    """The report to use: able ones only; then most cohort columns, revenue, campaign, country, platform, newest."""
    keys = ("cohort_columns", "has_revenue", "by_campaign", "by_country", "by_platform", "updated")
    return reports.filter("able").orderBy(*(F.col(k).desc_nulls_last() for k in keys), "report").limit(1)


def replay(raw: DataFrame, item: str) -> DataFrame:
    """Stored pages (payload: JSON with an array under data) as rows of the item schema, without reading them anew."""
    return raw.select(F.inline(F.from_json("payload", f"struct<data:array<{item}>>")["data"]))


def demo_delivery(spark: SparkSession, first: str, days: int, campaigns: int = 3) -> DataFrame:
    """A repeatable delivery series by day, campaign and country, for tests."""
    base = spark.range(days * campaigns * 3)
    n = F.col("id")
    noise = F.pmod(F.xxhash64(n), F.lit(1000)).cast("long")
    return base.select(
        F.date_add(F.lit(first).cast("date"), F.floor(n / (campaigns * 3)).cast("int")).alias("report_date"), F.concat(F.lit("c"), F.pmod(F.floor(n / 3), F.lit(campaigns)).cast("string")).alias("campaign"), F.element_at(F.array(*map(F.lit, ("US", "GB", "DE"))), (n % 3 + 1).cast("int")).alias("country"),
        F.lit("ios").alias("platform"), F.lit("meta_ads").alias("provider"), F.lit("USD").alias("currency"), (noise / 10).cast("decimal(20,6)").alias("spend"), (noise * 20).alias("impressions"), noise.alias("clicks"), F.lit(None).cast("long").alias("link_clicks"),
    )


def aggregate_installs(report: DataFrame) -> DataFrame:
    """Installs that a report has summed by day and source: ids are null, certainty is unknown; rows without a day are left out."""
    rows = report.select(scalars.iso_date(F.substr("date", F.lit(1), F.lit(10))).alias("install_date"), optional(report, "media_source").alias("media_source"), F.lit(None).cast("string").alias("campaign"), scalars.number(F.col("installs")).cast("long").alias("installs"))
    return rows.filter("install_date IS NOT NULL").withColumn("certainty", F.lit("unknown"))


def tracked_installs(report: DataFrame) -> DataFrame:
    """A saved report's rows as deterministic installs: only tracked ones count, what networks report is not read."""
    day = scalars.iso_date(F.substr(optional(report, "date", "day"), F.lit(1), F.lit(10)))
    rows = report.select(
        day.alias("install_date"), optional(report, "ad_network_name", "ad_network", "media_source").alias("media_source"), optional(report, "campaign_id", "campaign_ref_id").alias("campaign"), optional(report, "campaign_name", "campaign", "name").alias("name"),
        scalars.country_code(optional(report, "country", "country_code")).alias("country"), scalars.platform(optional(report, "platform")).alias("platform"), scalars.number(F.coalesce("tracked_installs", F.lit("0"))).cast("long").alias("installs"), F.lit("deterministic").alias("certainty"),
    )
    return rows.filter("install_date IS NOT NULL")


def campaign_directory(resources: DataFrame) -> DataFrame:
    """campaign, name, remote_id, channel of JSON resources (column resource); those without an id are left out."""
    shape = "id string, attributes struct<id:string,name:string,remote_campaign_id:string,channel_name:string>"
    of = resources.select(F.from_json("resource", shape).alias("r"))
    text = lambda c: scalars.blank_to_null(F.col(c))
    rows = of.select(F.coalesce(text("r.attributes.id"), text("r.id")).alias("campaign"), text("r.attributes.name").alias("name"), text("r.attributes.remote_campaign_id").alias("remote_id"), text("r.attributes.channel_name").alias("channel"))
    return rows.filter("campaign IS NOT NULL")


def cohort_coverage(reports: DataFrame) -> DataFrame:
    """age, kind, has: which returns a report's column names (columns) give at each age.

    A total stands if both components are there, or if neither is and the provider has one of its own.
    """
    held = lambda kind, age: F.array_contains("columns", f"{kind}_{age}d")
    rows = []
    for age in vocab.COHORT_AGES:
        iap, ad = held("iap", age), held("ad", age)
        for kind, has in (("iap", iap), ("ad", ad), ("total", (iap & ad) | (~iap & ~ad & held("total", age)))):
            rows.append(F.struct(F.lit(age).alias("age"), F.lit(kind).alias("kind"), has.alias("has")))
    return reports.select(F.inline(F.array(*rows)))


#: Breakdowns of a read, from the finest.
LADDER = ("country_device", "country", "none")


def finest_breakdown(rows: DataFrame, *scope: str) -> DataFrame:
    """Rows of the finest breakdown that each scope was answered at, whole; coarser reads of it go."""
    rank = F.array_position(F.array(*map(F.lit, LADDER)), F.col("breakdown"))
    best = rows.groupBy(*scope).agg(F.min(rank).alias("_rank"))
    return rows.withColumn("_own", rank).join(best, [*scope]).filter("_own = _rank").drop("_own", "_rank")
