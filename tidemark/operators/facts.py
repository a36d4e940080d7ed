"""Campaign-day facts through mapping links, their roll-up to the app, dense series and the summaries that rules read.

Each attribution campaign is credited to one marketing campaign, its strongest operational link, so summing campaigns
never counts a cohort twice. Everything is one pass of grouped joins over the fact tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars
from tidemark.operators import cohorts, populations

EVENT_IDENTITY = ["event_date", "media_source", "campaign", "country", "platform", "currency"]
_STRINGS = "array<string>"


def strongest_links(mappings: DataFrame) -> DataFrame:
    """attribution, campaign: for each target of an operational edge the source of highest confidence, then least name."""
    good = mappings.filter(populations.operational() & F.col("target").isNotNull())
    return good.groupBy(F.col("target").alias("attribution")).agg(F.min_by("source", F.struct(-F.col("confidence"), F.col("source"))).alias("campaign"))


def by_link(facts: DataFrame, mappings: DataFrame) -> DataFrame:
    """Paid attribution rows under the marketing campaign that they are credited to."""
    paid = facts.filter(~scalars.is_organic(F.col("media_source"))).withColumnRenamed("campaign", "attribution")
    return paid.join(strongest_links(mappings), "attribution").drop("attribution")


def linked_installs(installs: DataFrame, mappings: DataFrame) -> DataFrame:
    return by_link(installs, mappings).groupBy("campaign", F.col("install_date").alias("day")).agg(F.sum("installs").alias("installs"))


def linked_revenue(revenue: DataFrame, mappings: DataFrame) -> DataFrame:
    """Event-day revenue; a total counts only where its components aren't there."""
    rows = by_link(cohorts.without_doubled_totals(revenue, EVENT_IDENTITY), mappings)
    return rows.groupBy("campaign", F.col("event_date").alias("day")).agg(F.sum("revenue").alias("revenue"))


def linked_cohorts(rows: DataFrame, mappings: DataFrame, windows: DataFrame, as_of: Column) -> DataFrame:
    """campaign, day, age: mature revenue and its currencies by component and in total, and rows read too early."""
    held = by_link(cohorts.with_maturity(cohorts.without_doubled_totals(rows, cohorts.IDENTITY), windows, as_of), mappings)
    of = lambda kind: F.col("mature") if kind == "total" else F.col("mature") & (F.col("revenue_type") == kind)
    kinds = (*vocab.COMPONENTS, "total")
    sums = [F.coalesce(F.sum(F.when(of(k), F.col("revenue"))), F.lit(0)).alias(f"revenue_{k}") for k in kinds]
    money = [F.array_sort(F.collect_set(F.when(of(k), F.col("currency")))).alias(f"currencies_{k}") for k in kinds]
    return held.groupBy("campaign", F.col("install_date").alias("day"), "age").agg(*sums, *money, F.count_if(F.col("matured") & ~F.col("read_after")).alias("early_rows"))


def delivery_days(delivery: DataFrame) -> DataFrame:
    """campaign, day: delivery sums, and the currencies of rows that spent."""
    sums = [F.sum(m).alias(m) for m in ("spend", "impressions", "clicks")]
    return delivery.filter("campaign IS NOT NULL").groupBy("campaign", F.col("report_date").alias("day")).agg(*sums, F.array_sort(F.collect_set(F.when(F.col("spend") > 0, F.col("currency")))).alias("spend_currencies"))


def lifetime_spend(delivery: DataFrame) -> DataFrame:
    """Spend of each campaign over all its days, for lifetime budgets."""
    return delivery.groupBy("campaign").agg(F.sum("spend").alias("spent_to_date"))


def campaign_days(delivery: DataFrame, installs: DataFrame, rows: DataFrame, mappings: DataFrame, windows: DataFrame, as_of: Column, age: int) -> DataFrame:
    """One row for each campaign and day that any fact knows: delivery, linked installs, cohort return at the age, and
    whether the day is old enough and was read late enough for that age (both hold of the day, rows or none)."""
    earned = linked_cohorts(rows, mappings, windows, as_of).filter(F.col("age") == age).drop("age")
    days = delivery_days(delivery).join(linked_installs(installs, mappings), ["campaign", "day"], "full_outer").join(earned, ["campaign", "day"], "full_outer")
    zero = ["spend", "impressions", "clicks", "installs", "early_rows", *(f"revenue_{k}" for k in (*vocab.COMPONENTS, "total"))]
    sets = ["spend_currencies", *(f"currencies_{k}" for k in (*vocab.COMPONENTS, "total"))]
    filled = days.select("campaign", "day", *(F.coalesce(c, F.lit(0)).alias(c) for c in zero), *(F.coalesce(c, F.array().cast(_STRINGS)).alias(c) for c in sets))
    filled = filled.withColumn("aligned_installs", F.when(F.col("spend") > 0, F.col("installs")).otherwise(0))
    return with_day_state(filled, windows, as_of, age)


def with_day_state(days: DataFrame, windows: DataFrame, as_of: Column, age: int) -> DataFrame:
    """days with old_enough and covered at an age."""
    read = cohorts.covered_days(windows)
    ready = F.date_add("day", age)
    held = days.join(read, "day", "left").withColumn("old_enough", F.coalesce(ready < as_of, F.lit(False)))
    return held.withColumn("covered", F.coalesce(F.col("finished") > ready, F.lit(False))).drop("finished")


def mapping_state(mappings: DataFrame) -> DataFrame:
    """campaign with mapping_status, method, confidence of its strongest edge, operational, ambiguous (and not operational), targets."""
    usable = populations.operational() & F.col("target").isNotNull()
    best = F.min_by(F.struct("status", "method", "confidence"), F.struct(~usable, -F.col("confidence"), F.col("status"), F.coalesce("target", F.lit(""))))
    out = mappings.groupBy(F.col("source").alias("campaign")).agg(
        best.alias("b"), F.bool_or(usable).alias("operational"), F.bool_or(F.col("status") == "ambiguous").alias("unsure"), F.array_sort(F.collect_set(F.when(usable, F.col("target")))).alias("targets")
    )
    return out.select("campaign", F.col("b.status").alias("mapping_status"), F.col("b.method").alias("mapping_method"), F.col("b.confidence").alias("mapping_confidence"), "operational", (F.col("unsure") & ~F.col("operational")).alias("ambiguous"), "targets")


def app_days(days: DataFrame, state: DataFrame, windows: DataFrame, as_of: Column, age: int) -> DataFrame:
    """The days of operationally mapped campaigns, summed. Cohorts and aligned installs join only on days on which their
    own campaign spent."""
    mapped = days.join(state.filter("operational").select("campaign"), "campaign")
    spent = F.col("spend") > 0
    whole = [F.sum(c).alias(c) for c in ("spend", "impressions", "clicks", "installs", "aligned_installs")]
    aligned = [F.coalesce(F.sum(F.when(spent, F.col(c))), F.lit(0)).alias(c) for c in ("early_rows", *(f"revenue_{k}" for k in (*vocab.COMPONENTS, "total")))]
    some = lambda c, when: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(when, F.col(c)))))).alias(c)
    sets = [some("spend_currencies", F.lit(True)), *(some(f"currencies_{k}", spent) for k in (*vocab.COMPONENTS, "total"))]
    return with_day_state(mapped.groupBy("day").agg(*whole, *aligned, *sets), windows, as_of, age)


def app_coverage(days: DataFrame, state: DataFrame) -> DataFrame:
    """One row: per cent of the window's spend on operational and on ambiguous campaigns (null without spend)."""
    rows = days.join(state.select("campaign", "operational", "ambiguous"), "campaign", "left")
    share = lambda c: F.when(F.sum("spend") > 0, F.coalesce(F.sum(F.when(F.col(c), F.col("spend"))), F.lit(0)).cast("double") / F.sum("spend").cast("double") * 100)
    return rows.agg(share("operational").alias("spend_coverage"), share("ambiguous").alias("ambiguous_spend"))


def scope_summary(days: DataFrame, scope: str, kind: str, as_of: Column) -> DataFrame:
    """What the rules read of a scope's window: maturity counts of delivered days, mature and settled sums, currencies."""
    spent = F.col("spend") > 0
    mature = spent & F.col("old_enough") & F.col("covered")
    settled = spent & F.coalesce(F.col("day") < as_of, F.lit(False))
    sets = lambda c, when: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(when, F.col(c))))))
    amount = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return days.groupBy(scope).agg(
        amount("spend", spent).alias("spend"), F.count_if(spent).alias("delivered_days"), F.bool_or(spent | (F.col("impressions") > 0) | (F.col("clicks") > 0)).alias("delivered"), F.count_if(mature).alias("mature_days"),
        F.count_if(spent & ~F.col("old_enough")).alias("immature_days"), F.count_if(spent & F.col("old_enough") & ~F.col("covered")).alias("uncovered_days"), amount("early_rows", spent).alias("early_rows"),
        amount("spend", mature).alias("mature_spend"), amount("aligned_installs", mature).alias("mature_installs"), amount(f"revenue_{kind}", mature).alias("mature_revenue"), amount("spend", settled).alias("settled_spend"),
        amount("aligned_installs", settled).alias("settled_installs"), amount("installs", F.coalesce(F.col("day") <= as_of, F.lit(False))).alias("window_installs"), sets("spend_currencies", spent).alias("spend_currencies"), sets(f"currencies_{kind}", mature).alias("revenue_currencies"),
    )


def series(days: DataFrame, revenue: DataFrame, scope: str, ends: dict[str, Column]) -> DataFrame:
    """scope, metric, day, value: dense from the scope's first active day to each stream's last day (ends by metric).

    days: spend, impressions, clicks, installs; revenue: scope, day, revenue of events. A day in between without a row is a zero.
    """
    active = (F.col("spend") > 0) | (F.col("impressions") > 0) | (F.col("clicks") > 0) | (F.col("installs") > 0)
    first = days.filter(active).groupBy(scope).agg(F.min("day").alias("first"))
    last = F.greatest(*ends.values())
    dense = first.filter(F.col("first") <= last).select(scope, F.explode(F.sequence("first", last)).alias("day"))
    held = dense.join(days.select(scope, "day", "spend", "installs"), [scope, "day"], "left").join(revenue, [scope, "day"], "left")
    rows = F.array(*(F.when(F.col("day") <= end, F.struct(F.lit(m).alias("metric"), F.coalesce(m, F.lit(0)).cast("double").alias("value"))) for m, end in ends.items()))
    return held.select(scope, "day", F.inline(F.array_compact(rows)))
