"""Governed metrics: definitions as data, and one row for each metric with value, availability and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars
from tidemark.operators import aggregates


@dataclass(frozen=True)
class Metric:
    """numerator and denominator name measures; money names the measure that counts the currencies behind it.

    partial names measures that, when positive, make the value partial: rows that its two sides don't share. sources are
    the feeds (and the mapping) that a value rests on, needs the capabilities that a provider must have, tolerated the
    minutes since the last success after which it is stale, kind its class (operational, mapping, cohort).
    """

    key: str
    family: str
    unit: str
    numerator: str
    denominator: str | None = None
    minimum: float = 0
    scale: float = 1
    money: str | None = None
    partial: tuple[str, ...] = ()
    grain: str = "report_date"
    sources: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    tolerated: int = 24 * 60
    kind: str = "operational"


SPEND, EARNED = "spend_currencies", "revenue_currencies"
_AD, _BOTH, _ALL = {"sources": ("marketing",)}, {"sources": ("marketing", "attribution")}, {"sources": ("marketing", "attribution", "mapping")}
_MMP = {"sources": ("attribution",)}
_MAPPED = {"sources": ("attribution", "mapping"), "kind": "mapping"}
_LINKED = {"sources": ("marketing", "mapping"), "kind": "mapping"}
_COST, _VOLUME, _TAKEN, _EARNED = ("cost_data",), ("delivery_metrics",), ("attributed_installs",), ("attributed_revenue",)
_TWO_DAYS = 48 * 60
# Metrics with their families, sources, capabilities and tolerances.
OPERATIONAL = (
    Metric("spend", "delivery", "currency", "spend", money=SPEND, needs=_COST, **_AD),
    Metric("impressions", "delivery", "count", "impressions", needs=_VOLUME, **_AD),
    Metric("clicks", "delivery", "count", "clicks", needs=_VOLUME, **_AD),
    Metric("link_clicks", "delivery", "count", "link_clicks", needs=("link_clicks",), **_AD),
    Metric("ctr", "delivery", "ratio", "clicks", "impressions", vocab.MIN_IMPRESSIONS, needs=_VOLUME, **_AD),
    Metric("cpm", "delivery", "currency", "spend", "impressions", vocab.MIN_IMPRESSIONS, 1000, SPEND, needs=_COST + _VOLUME, **_AD),
    Metric("cpc", "delivery", "currency", "spend", "clicks", vocab.MIN_CLICKS, money=SPEND, needs=_COST + _VOLUME, **_AD),
    Metric("attributed_installs", "attribution", "count", "installs", grain="install_date", needs=_TAKEN, **_MMP),
    Metric("attributed_revenue", "revenue", "currency", "revenue", money=EARNED, grain="event_date", needs=_EARNED, tolerated=_TWO_DAYS, **_MMP),
    Metric("paid_attributed_installs", "attribution", "count", "paid_installs", grain="install_date", **_MMP),
    Metric("iap_revenue", "revenue", "currency", "iap_revenue", money=EARNED, grain="event_date", **_MMP),
    Metric("ad_revenue", "revenue", "currency", "ad_revenue", money=EARNED, grain="event_date", **_MMP),
    Metric("mapped_paid_installs", "attribution", "count", "mapped_installs", grain="install_date", needs=_TAKEN, **_MAPPED),
    Metric("organic_installs", "attribution", "count", "organic_installs", grain="install_date", needs=_TAKEN, **_MMP),
    Metric("mapped_attributed_revenue", "revenue", "currency", "mapped_revenue", money=EARNED, grain="event_date", needs=_EARNED, tolerated=_TWO_DAYS, **_MAPPED),
    Metric("delivery_aligned_paid_installs", "attribution", "count", "aligned_installs", grain="install_date", needs=_TAKEN, **_ALL),
    Metric("delivery_aligned_revenue", "revenue", "currency", "aligned_revenue", money=EARNED, grain="event_date", needs=_EARNED, tolerated=_TWO_DAYS, **_ALL),
    Metric(
        "mapped_cpi", "efficiency", "currency", "mapped_spend", "aligned_installs", vocab.MIN_INSTALLS, 1, SPEND,
        ("unmapped_installs", "outside_installs"), "mixed", needs=_COST + _TAKEN, **_ALL,
    ),
    Metric(
        "blended_cpi", "efficiency", "currency", "spend", "installs", vocab.MIN_INSTALLS, 1, SPEND,
        ("organic_installs", "unmapped_installs"), "mixed", needs=_COST + _TAKEN, **_BOTH,
    ),
    Metric("mapping_coverage", "coverage", "ratio", "authoritative_campaigns", "campaigns", 1, grain="none", sources=("mapping",), kind="mapping"),
    Metric("operational_mapping_coverage", "coverage", "ratio", "operational_campaigns", "campaigns", 1, grain="none", sources=("mapping",), kind="mapping"),
    Metric("spend_coverage", "coverage", "ratio", "mapped_spend", "spend", money=SPEND, needs=_COST, **_LINKED),
    Metric("attribution_coverage", "coverage", "ratio", "mapped_installs", "paid_installs", grain="install_date", needs=_TAKEN, **_MAPPED),
    Metric("campaign_operational_coverage", "coverage", "ratio", "mapped_delivered_campaigns", "delivered_campaigns", 1, **_LINKED),
)
#: Eighteen cohort metrics: three slices, three kinds, two ages. Each needs the capability of its slice and age.
COHORT = tuple(
    Metric(
        f"cohort_{slice_}{kind}_d{age}", "cohort", "ratio" if kind == "roas" else "currency", top, below, least, money=f"cohort_currencies_{s}_{age}",
        grain="cohort_date", needs=("cohort_reporting", *more, f"cohort_{s}_revenue_d{age}"), kind="cohort", **feeds,
    )
    for slice_, s in (("", "total"), ("iap_", "iap"), ("ad_", "ad"))
    for age in vocab.COHORT_AGES
    for kind, top, below, least, more, feeds in (
        ("revenue", f"mature_{s}_{age}", None, 0, (), _MMP),
        ("rpi", f"mature_{s}_{age}", f"mature_installs_{age}", vocab.MIN_INSTALLS, _TAKEN, _MMP),
        ("roas", f"aligned_{s}_{age}", f"aligned_spend_{age}", 1, _COST, _ALL),
    )
)


def metric_definitions(spark) -> DataFrame:
    """The catalogue as a table."""
    rows = [(m.key, m.family, m.unit, m.grain, m.numerator, m.denominator, float(m.minimum)) for m in OPERATIONAL + COHORT]
    return spark.createDataFrame(rows, "metric string, family string, unit string, grain string, numerator string, denominator string, minimum double")


def measures(*totals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A map from measure to value: one row, or one for each value of the by columns; totals have numbers beside those."""
    out = None
    for one in totals:
        names = [f.name for f in one.schema.fields if f.name not in by and f.dataType.typeName() not in ("date", "string", "array", "timestamp")]
        long = one.select(*by, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(list(by), names, "measure", "value")
        out = long if out is None else out.unionByName(long)
    return out.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("measure", "value"))).alias("m"))


def evaluate(values: DataFrame, metrics: tuple[Metric, ...]) -> DataFrame:
    """metric, value, numerator, denominator, availability, reason beside the columns that values has with its map m:
    currencies first, then arithmetic, then caveats."""

    def row(m: Metric) -> Column:
        get = lambda name: F.col("m")[F.lit(name)]
        top, below = get(m.numerator), get(m.denominator) if m.denominator else F.lit(None).cast("double")
        mixed = F.coalesce(get(m.money) > 1, F.lit(False)) if m.money else F.lit(False)
        reason = F.when(mixed, "mixed_currency").when(top.isNull(), "not_reported")
        if m.denominator:
            reason = reason.when(below.isNull() | (below <= 0), "missing_denominator").when(below < m.minimum, "below_minimum")
        caveat = F.lit(False)
        for name in m.partial:
            caveat |= F.coalesce(get(name) > 0, F.lit(False))
        plain = scalars.ratio(top * m.scale, below, m.minimum) if m.denominator else top
        return F.struct(
            F.lit(m.key).alias("metric"), F.when(~mixed, plain).alias("value"), F.when(~mixed, top).alias("numerator"), below.alias("denominator"),
            F.when(mixed, "blocked").when(reason.isNotNull(), "unavailable").when(caveat, "partial").otherwise("available").alias("availability"), F.coalesce(reason, F.when(caveat, "population_mismatch")).alias("reason"),
        )

    return values.select(*(c for c in values.columns if c != "m"), F.inline(F.array(*map(row, metrics))))


def operational_metrics(delivery: DataFrame, installs: DataFrame, revenue: DataFrame, mappings: DataFrame) -> DataFrame:
    """The 24 operational metrics over a window."""
    taken = aggregates.install_totals(installs, mappings, delivery)
    taken = taken.withColumn("paid_installs", F.col("installs") - F.col("organic_installs")).withColumn("outside_installs", F.col("mapped_installs") - F.col("aligned_installs"))
    values = measures(aggregates.marketing_totals(delivery, mappings), taken, aggregates.revenue_totals(revenue, mappings, delivery), aggregates.mapping_totals(mappings))
    return evaluate(values, OPERATIONAL)


def scoped_metrics(delivery: DataFrame, installs: DataFrame, revenue: DataFrame, mappings: DataFrame, by: tuple[str, ...] = ("scope",)) -> DataFrame:
    """The 24 operational metrics of every scope in one pass: each table has the by columns, a row once for each scope that
    holds it. Alignment is within the scope: the mapped campaign delivered there. Mapping standings are of no scope.
    """
    parts = [aggregates.marketing_totals(delivery, mappings, by), aggregates.install_totals(installs, mappings, delivery, by), aggregates.revenue_totals(revenue, mappings, delivery, by)]
    parts[1] = parts[1].withColumn("paid_installs", F.col("installs") - F.col("organic_installs")).withColumn("outside_installs", F.col("mapped_installs") - F.col("aligned_installs"))
    scopes = parts[0].select(*by).union(parts[1].select(*by)).union(parts[2].select(*by)).distinct()
    # A scope without rows of a table has sums of 0 there, as an aggregate over no rows has; what none reports stays null.
    filled = [scopes.join(p, list(by), "left").fillna(0, [c for c in p.columns if c not in (*by, "link_clicks")]) for p in parts]
    standing = scopes.crossJoin(F.broadcast(aggregates.mapping_totals(mappings)))
    return evaluate(measures(*filled, standing, by=by), OPERATIONAL)


#: From the first condition to the last; the first that holds of a metric decides.
_GATES = (
    ("unavailable", "missing_provider"), ("unavailable", "unsupported_metric"), ("stale", "provider_stale"), ("stale", "provider_stale"),
    ("partial", "provider_stale"), ("partial", "insufficient_coverage"), ("partial", "ambiguous_mapping"),
)
_ORDER = {a: i for i, a in enumerate(vocab.AVAILABILITY)}


def catalogue(spark, metrics: tuple[Metric, ...]) -> DataFrame:
    """What each metric rests on, as a relation (as long as the catalogue)."""
    rows = [(m.key, m.family, m.kind, list(m.sources), list(m.needs), m.tolerated) for m in metrics]
    return spark.createDataFrame(rows, "metric string, family string, kind string, sources array<string>, needs array<string>, tolerated int")


def feed_states(bindings: DataFrame, streams: DataFrame, now: Column) -> DataFrame:
    """app, role, status, minutes of each bound role: the worst stored state of its streams, and the minutes since the
    earliest of their last successes (null where no stream succeeded).

    bindings: app, role. streams: app, data_type, status, last_success; a role's streams are those whose type begins with it.
    """
    role = F.split_part("data_type", F.lit("_"), F.lit(1))
    state = streams.withColumn("role", role).groupBy("app", "role").agg(scalars.worst_freshness(F.col("status")).alias("status"), F.min("last_success").alias("earliest"))
    held = bindings.select("app", "role").distinct().join(state, ["app", "role"], "left")
    return held.select("app", "role", "status", F.floor(scalars.minutes_since(F.col("earliest"), now)).alias("minutes"))


def gates(apps: DataFrame, metrics: tuple[Metric, ...], feeds: DataFrame, capabilities: DataFrame, coverage: DataFrame) -> DataFrame:
    """app, metric, gate_availability, gate_blocker: for each app the first gate that stops or qualifies each metric.

    feeds: app, role, status, minutes of the connected roles. capabilities: app, capability, supported (one that any binding
    supports is supported). coverage: app, total_spend, mapped_spend, ambiguous_spend. The catalogue meets feeds by source
    and capabilities by need; each violation is a row with its gate's place, and the least place of a metric wins.
    """
    asked = apps.select("app").distinct().crossJoin(F.broadcast(catalogue(apps.sparkSession, metrics)))
    by_source = asked.select("app", "metric", "tolerated", F.explode(F.array_remove("sources", "mapping")).alias("role"))
    met = by_source.join(feeds.withColumn("connected", F.lit(True)), ["app", "role"], "left")
    late = F.col("minutes") > F.col("tolerated")
    of_feed = F.array(
        F.when(F.col("connected").isNull(), 0), F.when(F.col("status").isin("stale", "error"), 2), F.when(late, 3), F.when(F.col("status") == "delayed", 4)
    )
    supported = capabilities.filter("supported").select("app", F.col("capability").alias("need")).distinct()
    lacking = asked.select("app", "metric", F.explode("needs").alias("need")).join(supported, ["app", "need"], "left_anti").select("app", "metric", F.lit(1).alias("place"))
    # Figures of both feeds describe the account only as far as its spend is mapped.
    both = asked.filter((F.col("kind") == "operational") & F.array_contains("sources", "marketing") & F.array_contains("sources", "attribution"))
    share = lambda c: F.when(F.col("total_spend") > 0, F.col(c) / F.col("total_spend") * 100)
    of_cover = F.array(F.when(share("mapped_spend") < vocab.COVERAGE_FLOOR, 5), F.when(share("ambiguous_spend") > vocab.AMBIGUOUS_CEILING, 6))
    covered = both.join(coverage, "app").select("app", "metric", F.explode(F.array_compact(of_cover)).alias("place"))
    places = met.select("app", "metric", F.explode(F.array_compact(of_feed)).alias("place")).unionByName(lacking).unionByName(covered)
    first = places.groupBy("app", "metric").agg(F.min("place").alias("place"))
    found = F.element_at(F.array(*(F.struct(F.lit(a).alias("availability"), F.lit(b).alias("blocker")) for a, b in _GATES)), F.col("place") + 1)
    out = asked.select("app", "metric", "family").join(first, ["app", "metric"], "left").withColumn("found", F.when(F.col("place").isNotNull(), found))
    return out.select("app", "metric", "family", F.coalesce("found.availability", F.lit("available")).alias("gate_availability"), F.col("found.blocker").alias("gate_blocker"))


def in_context(evaluated: DataFrame, gated: DataFrame) -> DataFrame:
    """app, metric, family, value, numerator, denominator, availability, blocker: evaluated metrics (of each app, or of none) under their gates.

    An unavailable gate hides the value, whatever it is; otherwise the stricter of both availabilities holds, the gate's
    where they are equal, with its blocker.
    """
    on = [c for c in ("app", "metric") if c in evaluated.columns]
    rows = gated.join(evaluated, on)
    rank = lambda c: scalars.lookup(_ORDER, F.col(c))
    hidden = F.col("gate_availability") == "unavailable"
    wins = hidden | (rank("gate_availability") >= rank("availability"))
    shown = [F.when(~hidden, F.col(c)).alias(c) for c in ("value", "numerator", "denominator") if c in evaluated.columns]
    return rows.select(
        "app", "metric", "family", *shown, F.when(wins, F.col("gate_availability")).otherwise(F.col("availability")).alias("availability"),
        F.when(wins & F.col("gate_blocker").isNotNull(), F.col("gate_blocker")).otherwise(F.col("reason")).alias("blocker"),
    )


def documents(gated: DataFrame, feeds: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row for each app: its metrics by family, what is qualified and why, distinct blockers, feed states and confidence.

    groups: a map from family to (metric, value, availability) by metric; lists are as long as the catalogue. Confidence is
    the product of freshness (marketing's, else attribution's), mapped and unambiguous shares of spend, and the share that the
    sample reaches of the least one. coverage: app, total_spend, mapped_spend, ambiguous_spend, sample (aligned installs).
    """
    entry = F.struct("metric", "value", "availability")
    families = gated.groupBy("app", "family").agg(F.array_sort(F.collect_list(entry)).alias("metrics"))
    groups = families.groupBy("app").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "metrics")))).alias("groups"))
    noted = gated.groupBy("app").agg(
        F.array_sort(F.collect_list(F.when(F.col("availability") != "available", F.struct("metric", "availability", "blocker")))).alias("qualified"),
        F.array_sort(F.collect_set("blocker")).alias("blockers"),
    )
    state = lambda role: F.max(F.when(F.col("role") == role, F.col("status"))).alias(role)
    states = feeds.groupBy("app").agg(state("marketing"), state("attribution"))
    joined = groups.join(noted, "app").join(states, "app", "left").join(coverage, "app", "left")
    fresh = F.coalesce("marketing", "attribution")
    worth = scalars.lookup(vocab.FRESHNESS_SCORE, fresh)
    spend = F.col("total_spend")
    score = confidence(
        F.when(fresh.isNotNull(), F.coalesce(worth, F.lit(0.4))), F.when(spend > 0, F.col("mapped_spend") / spend), F.when(spend > 0, 1 - F.col("ambiguous_spend") / spend), F.col("sample") / vocab.MIN_INSTALLS
    )
    return joined.select("app", "groups", "qualified", "blockers", "marketing", F.col("attribution").alias("attribution_status"), score.alias("confidence"), confidence_level(score).alias("confidence_level"))


def confidence(*components: Column) -> Column:
    """Product of the components, each held within 0 and 1, to four places."""
    out = F.lit(1.0)
    for c in components:
        out = out * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(1.0))))
    return scalars.rounded(out, 4)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")
