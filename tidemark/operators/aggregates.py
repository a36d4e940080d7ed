"""Window aggregates of delivery, installs and revenue: exact sums by population, one row each even on empty input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import populations


def total(column: str, when: Column | None = None) -> Column:
    """A sum over the rows of a population; 0 if it has none."""
    value = F.col(column) if when is None else F.when(when, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0))


def marketing_totals(delivery: DataFrame, mappings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Spend, mapped spend and volumes, of all rows or by some columns; link_clicks stays null where no row reports it."""
    rows = populations.marketing(delivery, mappings)
    live = populations.delivered()
    return rows.groupBy(*by).agg(
        total("spend").alias("spend"), total("spend", F.col("mapped")).alias("mapped_spend"), total("impressions").alias("impressions"), total("clicks").alias("clicks"), F.sum("link_clicks").alias("link_clicks"),
        F.count_distinct("currency").alias("spend_currencies"), F.count_distinct(F.when(live, F.col("campaign"))).alias("delivered_campaigns"), F.count_distinct(F.when(live & F.col("mapped"), F.col("campaign"))).alias("mapped_delivered_campaigns"),
        F.count("*").alias("delivery_rows"), F.max("report_date").alias("last_day"),
    )


def install_totals(installs: DataFrame, mappings: DataFrame, delivery: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    rows = populations.attribution(installs, mappings, delivery, by)
    paid = ~F.col("organic")
    out = rows.groupBy(*by).agg(
        total("installs").alias("installs"), total("installs", F.col("organic")).alias("organic_installs"), total("installs", paid & F.col("mapped")).alias("mapped_installs"),
        total("installs", paid & F.col("aligned")).alias("aligned_installs"), F.count("*").alias("install_rows"),
    )
    return out.withColumn("unmapped_installs", F.col("installs") - F.col("organic_installs") - F.col("mapped_installs"))


def revenue_totals(revenue: DataFrame, mappings: DataFrame, delivery: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    rows = populations.attribution(revenue, mappings, delivery, by)
    paid, kind = ~F.col("organic"), F.col("revenue_type")
    return rows.groupBy(*by).agg(
        total("revenue").alias("revenue"), total("revenue", paid & F.col("mapped")).alias("mapped_revenue"), total("revenue", paid & F.col("aligned")).alias("aligned_revenue"), total("revenue", F.col("organic")).alias("organic_revenue"),
        total("revenue", kind == "iap").alias("iap_revenue"), total("revenue", kind == "ad").alias("ad_revenue"), F.count_distinct("currency").alias("revenue_currencies"),
    )


def mapping_totals(mappings: DataFrame) -> DataFrame:
    """Campaigns by the standing of their best mapping."""
    best = populations.best_mapping(mappings)
    return best.agg(F.count("*").alias("campaigns"), F.count_if(populations.authoritative()).alias("authoritative_campaigns"), F.count_if(populations.operational()).alias("operational_campaigns"))


def daily(facts: DataFrame, date: str, *measures: str) -> DataFrame:
    return facts.groupBy(F.col(date).alias("day")).agg(*(F.sum(m).alias(m) for m in measures))


def timeseries(delivery: DataFrame, installs: DataFrame, revenue: DataFrame) -> DataFrame:
    """One row a day that any of the three grains reports; a grain without that day stays null, never 0."""
    return (
        daily(delivery, "report_date", "spend", "impressions", "clicks")
        .join(daily(installs, "install_date", "installs"), "day", "full_outer")
        .join(daily(revenue, "event_date", "revenue"), "day", "full_outer")
    )


def channels(installs: DataFrame) -> DataFrame:
    """Installs by channel of their normalised source."""
    return installs.groupBy(scalars.media_channel(F.col("media_source")).alias("channel")).agg(F.sum("installs").alias("installs"))


def checksum(facts: DataFrame, groups: int = 4096) -> DataFrame:
    """Row count and digest of a table as a multiset of rows: equal whatever their order and however they are dealt.

    A row's SHA-256 (of its columns as text, joined by unit separators, null as NUL) is four numbers of 60 bits. Rows of a
    group (by the digest's first three digits) add up, so groups are summed where the rows are; the digest is the SHA-256 of
    the groups' numbers and sums in order. Any engine with SHA-256 and wide decimals finds the same value.
    """
    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in facts.columns)), 256)
    limbs = [F.sum(F.conv(F.substr("h", F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    group = (F.conv(F.substr("h", F.lit(1), F.lit(3)), 16, 10).cast("int") % groups).alias("g")
    parts = facts.select(row.alias("h")).groupBy(group).agg(*limbs, F.count("*").alias("n"))
    line = F.struct("g", F.concat_ws(":", "g", "n", "s0", "s1", "s2", "s3").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(lines, ",").cast("binary"), 256).alias("digest"))
