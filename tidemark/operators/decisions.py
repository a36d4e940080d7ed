"""Decision support over campaign days: dense series, robust anomalies and their classes, pacing, trends and signals.

All rules are plans over one row for each scope and day; none reads a clock. Windows are partitioned by scope and
metric and ordered by day, so a partition holds one series of at most a few hundred days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars
from tidemark.operators import metrics


def dense_days(facts: DataFrame, measures: list[str], last: Column, scope: str = "campaign", day: str = "day") -> DataFrame:
    """scope, day and measures for every day from a scope's first active one to last; days without a row count 0."""
    active = F.lit(False)
    for m in measures:
        active = active | (F.col(m) > 0)
    span = facts.filter(active).groupBy(scope).agg(F.min(day).alias("first"))
    days = span.filter(F.col("first") <= last).select(scope, F.explode(F.sequence("first", last)).alias(day))
    return days.join(facts.select(scope, day, *measures), [scope, day], "left").select(scope, day, *(F.coalesce(m, F.lit(0)).alias(m) for m in measures))


def median(values: Column) -> Column:
    """Exact median of an array: the middle value, or the mean of both."""
    s = F.array_sort(values)
    at = lambda i: F.element_at(s, i.cast("int"))
    n = F.size(s)
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2)


def anomalies(series: DataFrame, scope: str = "campaign", floor: float = vocab.ABSOLUTE_FLOOR, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """scope, metric, day, value, center, mad, points, z, deviation_pct, direction of days far outside their history.

    series: scope, metric, day, value (dense). The history of a day is the 14 calendar days before it. Only days from
    first to last are judged; earlier ones are history.
    """
    back = Window.partitionBy(scope, "metric").orderBy(F.unix_date("day")).rangeBetween(-vocab.BASELINE_DAYS, -1)
    rows = series.withColumn("history", F.collect_list(F.col("value").cast("double")).over(back)).withColumn("value", F.col("value").cast("double"))
    rows = rows.filter(F.size("history") >= vocab.BASELINE_POINTS).withColumn("center", median(F.col("history")))
    rows = rows.withColumn("mad", median(F.transform("history", lambda v: F.abs(v - F.col("center"))))).withColumn("deviation", F.col("value") - F.col("center"))
    size = F.abs("deviation")
    relative = (F.col("center") <= 0) & (size > 0) | (F.col("center") > 0) & (size >= vocab.RELATIVE_DEVIATION * F.col("center"))
    z = F.when(F.col("mad") > 0, size / (vocab.MAD_TO_SIGMA * F.col("mad")))
    judged = F.lit(True)
    if first is not None:
        judged = judged & (F.col("day") >= first)
    if last is not None:
        judged = judged & (F.col("day") <= last)
    far = rows.filter(judged & (size >= floor) & relative & F.coalesce(z >= vocab.ROBUST_Z, F.lit(True)))
    return far.select(
        scope, "metric", "day", scalars.rounded(F.col("value")).alias("value"), scalars.rounded(F.col("center")).alias("center"), scalars.rounded(F.col("mad")).alias("mad"), F.size("history").alias("points"),
        scalars.rounded(z, 3).alias("z"), F.when(F.col("center") > 0, scalars.rounded(F.col("deviation") / F.col("center") * 100, 4)).alias("deviation_pct"), F.when(F.col("deviation") > 0, "up").otherwise("down").alias("direction"),
    )


def classify(found: DataFrame, signals: DataFrame, freshness: str | None = None, scope: str = "campaign") -> DataFrame:
    """found with class. signals: day, sync_error, uncovered, finding (days without a row have none of them).

    Movements of the same day and direction are seen by one grouped pass, not by a self-join.
    """
    moved = found.groupBy(scope, "day", "direction").agg(F.bool_or(F.col("metric") == "spend").alias("spend_moved"), F.bool_or(F.col("metric") == "installs").alias("installs_moved"))
    rows = found.join(moved, [scope, "day", "direction"]).join(signals, "day", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    feed = F.lit(freshness is not None and freshness not in ("fresh", "delayed"))
    data = has("sync_error") | has("uncovered")
    installs = F.when(data, "data_gap").when(F.col("spend_moved"), "delivery").when(has("finding") | feed, "attribution").otherwise("undetermined")
    revenue = F.when(data, "data_gap").when(F.col("installs_moved"), installs).when(F.col("spend_moved"), "delivery").when(has("finding"), "attribution").otherwise("monetization")
    kind = F.when(F.col("metric") == "spend", "delivery").when(F.col("metric") == "installs", installs).otherwise(revenue)
    return rows.select(*found.columns, kind.alias("class"))


def pacing(days: DataFrame, budgets: DataFrame, scope: str = "campaign") -> DataFrame:
    """Mean spend of delivered days against the daily budget. days: scope, day, spend, currency; budgets: scope, daily, budget_currency."""
    live = F.col("spend") > 0
    sums = days.groupBy(scope).agg(
        F.sum("spend").cast("double").alias("spend"), F.count_distinct(F.when(live, F.col("day"))).alias("delivered_days"), F.count_distinct(F.when(live, F.col("currency"))).alias("currencies"), F.min(F.when(live, F.col("currency"))).alias("currency")
    )
    rows = sums.join(budgets, scope, "left").withColumn("average", F.when(F.col("delivered_days") > 0, scalars.rounded(F.col("spend") / F.col("delivered_days"))))
    known = F.coalesce(F.col("daily") > 0, F.lit(False))
    clash = (F.col("currencies") > 1) | F.coalesce(F.col("budget_currency") != F.col("currency"), F.lit(False))
    reason = F.when(F.col("delivered_days") == 0, "not_delivered").when(~known, "no_budget").when(clash, "mixed_currency")
    ratio = F.when(reason.isNull(), scalars.rounded(F.col("average") / F.col("daily").cast("double"), 4))
    status = F.when(ratio.isNull(), "unknown").when(ratio < vocab.UNDER_PACE, "under").when(ratio > vocab.OVER_PACE, "over").otherwise("on")
    return rows.select(scope, "spend", "delivered_days", F.col("average").alias("average_spend"), ratio.alias("ratio"), status.alias("status"), reason.alias("reason"))


def trend(days: DataFrame, floor_denominator: float = 50, floor_installs: int = vocab.MIN_INSTALLS, scope: str = "campaign", higher_is_better: bool = True) -> DataFrame:
    """The newest seven eligible days against the seven before. days: scope, day, numerator, denominator, installs, eligible."""
    size = vocab.HALF_DAYS
    place = F.row_number().over(Window.partitionBy(scope).orderBy(F.col("day").desc()))
    halves = days.filter("eligible").withColumn("place", place).filter(F.col("place") <= 2 * size).withColumn("half", F.when(F.col("place") <= size, "now").otherwise("before"))
    sums = lambda h: [F.sum(F.when(F.col("half") == h, F.col(c))).cast("double").alias(f"{h}_{c}") for c in ("numerator", "denominator", "installs")] + [F.count_if(F.col("half") == h).alias(f"{h}_days")]
    rows = halves.groupBy(scope).agg(*sums("now"), *sums("before"))
    value = lambda h: F.when((F.col(f"{h}_days") == size) & (F.col(f"{h}_denominator") >= floor_denominator) & (F.col(f"{h}_installs") >= floor_installs), scalars.rounded(scalars.ratio(F.col(f"{h}_numerator"), F.col(f"{h}_denominator"))))
    rows = rows.withColumn("now", value("now")).withColumn("before", value("before")).withColumn("change_pct", scalars.change_percent(F.col("now"), F.col("before")))
    better = F.col("change_pct") * (1 if higher_is_better else -1)
    direction = F.when(F.col("change_pct").isNull(), "unknown").when(F.abs("change_pct") < vocab.MATERIAL_CHANGE, "stable").when(better > 0, "improving").otherwise("deteriorating")
    return rows.select(scope, "now_days", "before_days", "now", "before", "change_pct", direction.alias("direction"))


def cpi_verdict(spend: Column, installs: Column, ceiling: Column, floor_spend: float = vocab.MIN_SPEND, floor_installs: int = vocab.MIN_INSTALLS) -> Column:
    """Spend for each install on settled days against a ceiling: null without the volume."""
    able = (spend >= floor_spend) & (installs >= floor_installs) & (installs > 0)
    cpi = F.when(able, spend.cast("double") / installs.cast("double"))
    return F.when(cpi <= ceiling * (1 - vocab.TARGET_BAND), "scale").when(cpi >= ceiling * (1 + vocab.TARGET_BAND), "reduce").when(cpi.isNotNull(), "hold")


@dataclass(frozen=True)
class Policy:
    """Targets of an app; None sets none. Capabilities are pairs of revenue type and age that the provider reports."""

    target_d7: float | None = None
    target_d1: float | None = None
    max_cpi: float | None = None
    currency: str | None = None
    capabilities: frozenset[tuple[str, int]] = frozenset()


@dataclass(frozen=True)
class Measure:
    """The return that a policy is read against; partial is one component's, which is only a floor on the whole."""

    age: int
    kind: str
    partial: bool
    target: float


def return_measure(policy: Policy) -> Measure | None:
    """Age 7 before age 1, each only with a target; the total before a component."""
    for age, target in ((7, policy.target_d7), (1, policy.target_d1)):
        if target is not None and target > 0:
            for kind in ("total", *vocab.COMPONENTS):
                if (kind, age) in policy.capabilities:
                    return Measure(age, kind, kind != "total", target)
    return None


def evaluate(scopes: DataFrame, policy: Policy) -> DataFrame:
    """scopes with signal, category, blocker, roas, cpi and confidence. Gates come in order, the first that fails decides.

    scopes: is_app, provider_missing, operational, ambiguous, mapping_status, mapping_confidence, spend_coverage and
    ambiguous_spend (per cent, of an app), marketing_status and attribution_status (freshness; null: never synced),
    sync_errors, as_of, spend_currencies and revenue_currencies (arrays), error_findings (those that count for the
    scope), data_anomalies, open_anomalies, mature_days, immature_days, uncovered_days, mature_spend, mature_installs,
    mature_revenue, settled_spend, settled_installs, direction.
    """
    c, measure = F.col, return_measure(policy)
    say = lambda signal, category, blocker: F.struct(F.lit(signal).alias("signal"), F.lit(category).alias("category"), (blocker if isinstance(blocker, Column) else F.lit(blocker).cast("string")).alias("blocker"))
    no, data, low, good = "insufficient_data", "data_quality", "coverage", "performance"
    marketing, attribution = (F.coalesce(c(n), F.lit("unknown")) for n in ("marketing_status", "attribution_status"))
    worst = scalars.worst_of(F.array(marketing, attribution))
    spent, earned = c("spend_currencies"), c("revenue_currencies")
    clash = (F.size(spent) > 1) | (F.size(earned) > 1) | ((F.size(spent) == 1) & (F.size(earned) == 1) & (F.element_at(spent, 1) != F.element_at(earned, 1)))
    enough = (c("mature_days") >= vocab.MIN_MATURE_DAYS) & (c("mature_spend") >= vocab.MIN_SPEND) & (c("mature_installs") >= vocab.MIN_INSTALLS) & (c("mature_spend") > 0)
    exact = F.when(enough, c("mature_revenue").cast("double") / c("mature_spend").cast("double"))
    settled = (c("settled_spend") >= vocab.MIN_SPEND) & (c("settled_installs") >= vocab.MIN_INSTALLS) & (c("settled_installs") > 0)
    cost = F.when(settled, c("settled_spend").cast("double") / c("settled_installs").cast("double"))
    gates = [
        (c("provider_missing"), say(no, low, "missing_provider")),
        (~c("is_app") & ~c("operational") & c("ambiguous"), say("investigate", low, "ambiguous_mapping")),
        (~c("is_app") & ~c("operational"), say(no, low, "insufficient_coverage")),
        (c("is_app") & (c("spend_coverage") < vocab.COVERAGE_FLOOR), say(no, low, "insufficient_coverage")),
        (c("is_app") & (c("ambiguous_spend") > vocab.AMBIGUOUS_CEILING), say("investigate", low, "ambiguous_mapping")),
        ((worst == "error") | (c("sync_errors") > 0), say("investigate", data, "provider_stale")),
        (worst.isNull() | worst.isin("stale", "unknown"), say(no, data, "provider_stale")),
        (c("as_of").isNull(), say(no, data, "provider_stale")),
        (clash, say("investigate", data, "mixed_currency")),
        (c("error_findings") > 0, say("investigate", data, "data_quality_finding")),
        (c("data_anomalies") > 0, say("investigate", data, "anomalous_data")),
        (c("open_anomalies") > 0, say("investigate", "undetermined", "anomalous_data")),
    ]
    if measure is None and policy.max_cpi is not None and policy.max_cpi > 0:
        verdict = cpi_verdict(c("settled_spend"), c("settled_installs"), F.lit(policy.max_cpi))
        if policy.currency:
            gates.append((F.try_element_at(spent, F.lit(1)) != policy.currency, say("hold", data, "mixed_currency")))
        gates += [(verdict.isNull(), say(no, low, "missing_denominator"))] + [(verdict == v, say(v, good, None)) for v in ("scale", "reduce", "hold")]
    elif measure is None:
        wanted = policy.target_d7 is not None or policy.target_d1 is not None
        gates.append((F.lit(True), say("hold", "undetermined", "unsupported_metric" if wanted else "no_target")))
    else:
        high, under = measure.target * (1 + vocab.TARGET_BAND), measure.target * (1 - vocab.TARGET_BAND)
        gates += [
            ((c("mature_days") == 0) & (c("uncovered_days") > 0), say(no, data, "provider_stale")),
            (c("mature_days") == 0, say(no, low, "immature_cohort")),
            (exact.isNull(), say(no, low, F.when(c("mature_days") < vocab.MIN_MATURE_DAYS, "immature_cohort").otherwise("missing_denominator"))),
            ((exact >= high) & (c("direction") == "deteriorating"), say("hold", good, "trend_contradicts")),
            (exact >= high, say("scale", good, None)),
            ((exact <= under) & F.lit(measure.partial), say("hold", good, "partial_return")),
            ((exact <= under) & (c("direction") == "improving"), say("hold", good, "trend_contradicts")),
            (exact <= under, say("reduce", good, None)),
            (F.lit(True), say("hold", good, None)),
        ]
    out = F.when(F.lit(False), gates[0][1])
    for condition, verdict in gates:
        out = out.when(F.coalesce(condition, F.lit(False)), verdict)
    strength = F.when(~c("operational"), 0.0).when(c("mapping_status") == "matched_fallback", F.coalesce("mapping_confidence", F.lit(0.0))).otherwise(1.0)
    lived = c("mature_days") + c("immature_days") + c("uncovered_days")
    ripe = F.when(lived > 0, c("mature_days") / lived).otherwise(0.0)
    sample = F.least(F.lit(1.0), c("mature_installs") / F.lit(float(vocab.MIN_INSTALLS)))
    covered = F.when(c("is_app") & c("spend_coverage").isNotNull(), c("spend_coverage") / 100)
    clear = F.when(c("is_app") & c("ambiguous_spend").isNotNull(), 1 - c("ambiguous_spend") / 100)
    score = metrics.confidence(scalars.lookup(vocab.FRESHNESS_SCORE, F.coalesce(worst, F.lit("unknown"))), sample, covered, clear, ripe, F.when(~c("is_app"), strength))
    judged = scopes.withColumns({"verdict": out, "roas": scalars.rounded(exact), "cpi": scalars.rounded(cost), "confidence": score})
    return judged.select("*", "verdict.signal", "verdict.category", "verdict.blocker", metrics.confidence_level(c("confidence")).alias("confidence_level")).drop("verdict")
