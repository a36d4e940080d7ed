"""Cohorts at fixed ages: horizon, coverage, maturity, revenue slices, installs, aligned spend and the 18 metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars
from tidemark.operators import metrics, populations


#: What makes two cohort rows of different revenue types the same cohort.
IDENTITY = ["install_date", "age", "media_source", "campaign", "country", "platform", "currency"]


def horizon(installs: DataFrame, revenue: DataFrame) -> DataFrame:
    """as_of: the earlier of both streams' last days; null unless both report."""
    days = installs.select(F.lit("installs").alias("s"), F.col("install_date").alias("d")).unionByName(revenue.select(F.lit("revenue").alias("s"), F.col("event_date").alias("d")))
    last = days.groupBy("s").agg(F.max("d").alias("d"))
    return last.agg(F.when(F.count("d") == 2, F.min("d")).alias("as_of"))


def covered_days(windows: DataFrame) -> DataFrame:
    """day and the last date on which a run that covers it finished: intervals become days, so later joins are by key."""
    return windows.select(F.explode(F.sequence("from_date", "to_date")).alias("day"), "finished").groupBy("day").agg(F.max("finished").alias("finished"))


def with_maturity(facts: DataFrame, windows: DataFrame, as_of: Column) -> DataFrame:
    """facts (install_date, age) with matured (old enough), covered (a run read the day late enough), read_after (the row
    itself was read late enough; facts without read_on leave that to the runs) and mature (all three)."""
    read = F.coalesce(F.col("read_on") > F.date_add("install_date", F.col("age").cast("int")), F.lit(False)) if "read_on" in facts.columns else F.lit(True)
    days = covered_days(windows).select(F.col("day").alias("install_date"), "finished")
    ready = F.date_add("install_date", F.col("age").cast("int"))
    return (
        facts.join(days, "install_date", "left")
        .withColumn("matured", F.coalesce(ready < as_of, F.lit(False)))
        .withColumn("covered", F.coalesce(F.col("finished") > ready, F.lit(False)))
        .withColumn("read_after", read)
        .withColumn("mature", F.col("matured") & F.col("covered") & F.col("read_after"))
        .drop("finished")
    )


def without_doubled_totals(cohorts: DataFrame, identity: list[str], kind: str = "revenue_type") -> DataFrame:
    """Rows without the totals whose components are there too. Nulls in the identity are equal to each other."""
    parts = cohorts.filter(F.col(kind).isin(*vocab.COMPONENTS)).select(*(F.col(c).alias(f"_{c}") for c in identity)).distinct()
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    lone = cohorts.filter(F.col(kind) == "total").join(parts, same, "left_anti")
    return cohorts.filter(F.col(kind) != "total").unionByName(lone)


def aligned_days(delivery: DataFrame, mappings: DataFrame) -> DataFrame:
    """campaign, install_date: attribution campaigns whose mapped source spent on that day."""
    spent = delivery.filter("spend > 0").select(F.col("campaign").alias("source"), F.col("report_date").alias("install_date")).distinct()
    links = mappings.filter(populations.operational() & F.col("target").isNotNull()).select("source", F.col("target").alias("campaign")).distinct()
    return spent.join(links, "source").select("campaign", "install_date")


def slices(cohorts: DataFrame, windows: DataFrame, mappings: DataFrame, delivery: DataFrame, as_of: Column) -> DataFrame:
    """Revenue by age and slice (iap, ad, total): mature, organic, mapped, aligned, immature and early-read sums."""
    rows = with_maturity(without_doubled_totals(cohorts, IDENTITY), windows, as_of).withColumn("organic", scalars.is_organic(F.col("media_source")))
    rows = populations.flag(populations.flag(rows, populations.linked_targets(mappings), "mapped"), aligned_days(delivery, mappings), "aligned")
    both = F.array_distinct(F.array("revenue_type", F.lit("total")))
    mature = F.col("mature")
    sums = {
        "mature": mature, "mature_organic": mature & F.col("organic"), "mature_mapped": mature & ~F.col("organic") & F.col("mapped"),
        "aligned": mature & ~F.col("organic") & F.col("aligned"), "mature_unmapped": mature & ~F.col("organic") & ~F.col("mapped"), "immature": ~F.col("matured"), "early_read": F.col("matured") & ~F.col("read_after"),
    }
    sliced = rows.select("*", F.explode(both).alias("slice")).groupBy("age", "slice")
    return sliced.agg(*(F.coalesce(F.sum(F.when(c, F.col("revenue"))), F.lit(0)).cast("double").alias(n) for n, c in sums.items()), F.count_distinct(F.when(mature, F.col("currency"))).alias("currencies"), F.count_distinct(F.when(sums["aligned"], F.col("currency"))).alias("aligned_currencies"), F.count_if(sums["early_read"]).alias("early_read_rows"))


def install_maturity(installs: DataFrame, windows: DataFrame, as_of: Column) -> DataFrame:
    """For each age: mature installs (paid, organic) and how many install days are mature, immature or uncovered."""
    aged = installs.select("*", F.explode(F.array(*map(F.lit, vocab.COHORT_AGES))).alias("age"))
    rows = with_maturity(aged, windows, as_of).withColumn("organic", scalars.is_organic(F.col("media_source")))
    day = lambda c: F.count_distinct(F.when(c, F.col("install_date")))
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("installs"))), F.lit(0))
    return rows.groupBy("age").agg(
        amount(F.col("mature")).alias("mature_installs"), amount(F.col("mature") & ~F.col("organic")).alias("paid_installs"), amount(F.col("mature") & F.col("organic")).alias("organic_installs"),
        day(F.col("mature")).alias("mature_days"), day(~F.col("matured")).alias("immature_days"), day(F.col("matured") & ~F.col("covered")).alias("uncovered_days"),
    )


def aligned_spend(delivery: DataFrame, mappings: DataFrame, windows: DataFrame, as_of: Column) -> DataFrame:
    """For each age: spend of mapped campaigns on mature days, its currencies and its campaign-days."""
    mapped = populations.marketing(delivery, mappings).filter("mapped").withColumn("install_date", F.col("report_date"))
    aged = mapped.select("*", F.explode(F.array(*map(F.lit, vocab.COHORT_AGES))).alias("age"))
    rows = with_maturity(aged, windows, as_of).filter("mature")
    return rows.groupBy("age").agg(F.sum("spend").cast("double").alias("aligned_spend"), F.count_distinct("currency").alias("currencies"), F.count_distinct(F.struct("campaign", "report_date")).alias("campaign_days"))


def roas_currencies(cohorts: DataFrame, windows: DataFrame, mappings: DataFrame, delivery: DataFrame, as_of: Column) -> DataFrame:
    """age, slice, n: the currencies behind a return, those of aligned mature cohorts and of the spend that bought them."""
    rows = with_maturity(without_doubled_totals(cohorts, IDENTITY), windows, as_of).filter(F.col("mature") & ~scalars.is_organic(F.col("media_source")))
    earned = populations.flag(rows, aligned_days(delivery, mappings), "aligned").filter("aligned").select("age", F.explode(F.array_distinct(F.array("revenue_type", F.lit("total")))).alias("slice"), "currency")
    mapped = populations.marketing(delivery, mappings).filter("mapped").withColumn("install_date", F.col("report_date"))
    aged = mapped.select("*", F.explode(F.array(*map(F.lit, vocab.COHORT_AGES))).alias("age"))
    spent = with_maturity(aged, windows, as_of).filter("mature").select("age", F.explode(F.array(*map(F.lit, (*vocab.COMPONENTS, "total")))).alias("slice"), "currency")
    return earned.unionByName(spent).groupBy("age", "slice").agg(F.count_distinct("currency").alias("n"))


def cohort_metrics(cohorts: DataFrame, installs: DataFrame, delivery: DataFrame, mappings: DataFrame, windows: DataFrame, as_of: Column) -> DataFrame:
    """The 18 cohort metrics: blocks in order (no horizon, no cohorts, days not read, days too young, currencies), then
    arithmetic, then caveats: days or rows that were left out make a value partial."""
    flat = lambda df, names, tag: df.select(*(F.struct(F.concat_ws("_", F.lit(n), *tag).alias("measure"), F.col(c).cast("double").alias("value")).alias(n) for c, n in names))
    long = lambda df, names, *tag: flat(df, names, tag).select(F.inline(F.array(*(n for _, n in names))))
    age = F.col("age").cast("string")
    parts = long(slices(cohorts, windows, mappings, delivery, as_of), [(c, c) for c in ("mature", "aligned", "mature_mapped", "mature_unmapped", "early_read_rows", "currencies")], F.col("slice"), age)
    taken = long(install_maturity(installs, windows, as_of), [(c, c) for c in ("mature_installs", "mature_days", "immature_days", "uncovered_days")], age)
    paid = long(aligned_spend(delivery, mappings, windows, as_of), [("aligned_spend", "aligned_spend")], age)
    money = long(roas_currencies(cohorts, windows, mappings, delivery, as_of), [("n", "roas_currencies")], F.col("slice"), age)
    values = parts.unionByName(taken).unionByName(paid).unionByName(money).agg(F.map_from_entries(F.collect_list(F.struct("measure", "value"))).alias("m"))
    get = lambda *name: F.coalesce(F.col("m")[F.lit("_".join(map(str, name)))], F.lit(0.0))

    def row(m: metrics.Metric) -> Column:
        kind, at = m.money.removeprefix("cohort_currencies_").rsplit("_", 1)
        roas, ratio = "roas" in m.key, m.denominator is not None
        top, below = get(m.numerator), get(m.denominator) if ratio else F.lit(None).cast("double")
        ripe, young, unread = get("mature_days", at), get("immature_days", at), get("uncovered_days", at)
        reason = (
            F.when(as_of.isNull(), "provider_stale").when(ripe + young + unread == 0, "no_cohorts").when((ripe == 0) & (unread > 0), "provider_stale_days").when(ripe == 0, "immature_cohort")
            .when(get("roas_currencies" if roas else "currencies", kind, at) > 1, "mixed_currency")
        )
        if ratio:
            reason = reason.when(below <= 0, "missing_denominator").when(below < m.minimum, "below_minimum")
        left_out = (young > 0) | (unread > 0) | (get("early_read_rows", kind, at) > 0)
        if roas:
            left_out = left_out | (get("mature_unmapped", kind, at) > 0) | (get("mature_mapped", kind, at) > get("aligned", kind, at))
        blocked = reason.isin("provider_stale_days", "immature_cohort", "mixed_currency")
        return F.struct(
            F.lit(m.key).alias("metric"), F.when(reason.isNull(), scalars.ratio(top, below, m.minimum) if ratio else top).alias("value"), F.when(blocked, "blocked").when(reason.isNotNull(), "unavailable").when(left_out, "partial").otherwise("available").alias("availability"),
            F.coalesce(F.when(reason == "provider_stale_days", "provider_stale").otherwise(reason), F.when(left_out, "left_out")).alias("reason"),
        )

    return values.select(F.inline(F.array(*map(row, metrics.COHORT))))
