"""Populations: which rows of a fact table a metric may count, as flag columns.

Flags come from joins with distinct keys, so they never multiply rows, and one set of filters reaches both sides of a
ratio.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars


@dataclass(frozen=True)
class Filters:
    """Optional equality filters and an inclusive window; None filters nothing."""

    first: str | None = None
    last: str | None = None
    country: str | None = None
    platform: str | None = None
    provider: str | None = None
    channel: str | None = None

    def on(self, facts: DataFrame, date: str) -> DataFrame:
        """facts within the filters; those whose column the facts lack are passed over."""
        if self.first:
            facts = facts.filter(F.col(date) >= F.lit(self.first).cast("date"))
        if self.last:
            facts = facts.filter(F.col(date) <= F.lit(self.last).cast("date"))
        for name in ("country", "platform", "provider"):
            if (value := getattr(self, name)) is not None and name in facts.columns:
                facts = facts.filter(F.col(name) == value)
        return self._of_channel(facts) if self.channel else facts

    def _of_channel(self, facts: DataFrame) -> DataFrame:
        if "media_source" in facts.columns:
            return facts.filter(scalars.media_channel(F.col("media_source")) == self.channel)
        # A delivery row of a network that doesn't serve the channel contradicts the filter.
        return facts.filter(scalars.provider_channel(F.col("provider")) == self.channel) if "provider" in facts.columns else facts


def authoritative() -> Column:
    return F.col("status").isin(*vocab.AUTHORITATIVE)


def operational() -> Column:
    """Good enough to act on: authoritative, or a fallback of high confidence."""
    return F.coalesce(authoritative() | ((F.col("status") == "matched_fallback") & (F.col("confidence") >= vocab.OPERATIONAL_CONFIDENCE)), F.lit(False))


def delivered() -> Column:
    return (F.col("spend") > 0) | (F.col("impressions") > 0) | (F.col("clicks") > 0)


def flag(facts: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """facts with a boolean: whether the row's values of keys' columns (same names) are among them."""
    marked = keys.distinct().withColumn(name, F.lit(True))
    return facts.join(marked, keys.columns, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def linked_targets(mappings: DataFrame, sources: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """campaign: attribution campaigns that an operational mapping leads to, from these source campaigns only if given
    (with the by columns that the source campaigns stand under)."""
    links = mappings.filter(operational() & F.col("target").isNotNull())
    if sources is not None:
        links = links.join(sources.select(*by, F.col("campaign").alias("source")).distinct(), "source")
    return links.select(*by, F.col("target").alias("campaign"))


def attribution(facts: DataFrame, mappings: DataFrame, delivery: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """installs or revenue with organic, mapped and aligned (the mapped campaign delivered within the same filters, or
    within the same values of the by columns)."""
    out = flag(facts.withColumn("organic", scalars.is_organic(F.col("media_source"))), linked_targets(mappings), "mapped")
    return flag(out, linked_targets(mappings, delivery.filter(delivered()), by), "aligned")


def _suffixed(value: Column):
    return lambda x: F.concat(x, F.array(value))


def in_scopes(cells: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """cells, once for each scope that holds them: scope names a value for every subset of the dimensions ("*": any).

    A row of null in a dimension is in no scope that names one. Aggregate facts to cells first: a cell comes 2 ** dimensions times.
    """
    scopes = F.array(F.array().cast("array<string>"))
    for d in dimensions:
        wide = F.transform(scopes, _suffixed(F.lit(f"{d}=*")))
        named = F.transform(scopes, _suffixed(F.concat(F.lit(f"{d}="), F.col(d))))
        scopes = F.concat(wide, F.when(F.col(d).isNotNull(), named).otherwise(F.array().cast("array<array<string>>")))
    return cells.select("*", F.explode(F.transform(scopes, lambda x: F.array_join(x, "|"))).alias("scope"))


def marketing(delivery: DataFrame, mappings: DataFrame) -> DataFrame:
    """delivery with mapped: its campaign is the source of an operational mapping."""
    return flag(delivery, mappings.filter(operational()).select(F.col("source").alias("campaign")), "mapped")


def best_mapping(mappings: DataFrame, key: str = "source") -> DataFrame:
    """One mapping for each key: highest confidence, then status, then the other end."""
    other = "target" if key == "source" else "source"
    best = F.min_by(F.struct("source", "target", "status", "method", "confidence"), F.struct(-F.col("confidence"), F.col("status"), F.coalesce(other, F.lit("")).alias("other")))
    return mappings.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("best")).select("best.*")
