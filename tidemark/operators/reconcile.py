"""Reconciliation of marketing campaigns with attribution campaigns: identifiers first, then deterministic names.

Each rule yields candidate edges with a priority; the best priority of a campaign wins. Names are counted by key before
any join, and only keys of one marketing campaign are joined, so repeated names never make pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars
from tidemark.operators import populations

_EDGE = ["source", "target", "status", "method", "confidence", "priority"]


def _edges(pairs: DataFrame, status: str, method: str, confidence: float, priority: int) -> DataFrame:
    return pairs.select("source", "target", F.lit(status).alias("status"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority"))


def resolve_remote(attribution: DataFrame, campaigns: DataFrame, ad_groups: DataFrame | None = None) -> DataFrame:
    """target, source: where an attribution campaign's remote id leads, through an ad group to its parent or directly."""
    asked = attribution.filter("remote_id IS NOT NULL").select(F.col("campaign").alias("target"), "remote_id")
    direct = asked.join(campaigns.select(F.col("campaign").alias("remote_id"), F.col("campaign").alias("source")), "remote_id", "left")
    if ad_groups is None:
        return direct.filter("source IS NOT NULL").select("target", "source")
    parents = ad_groups.select(F.col("ad_group").alias("remote_id"), F.col("campaign").alias("parent"))
    return direct.join(parents, "remote_id", "left").select("target", F.coalesce("parent", "source").alias("source")).filter("source IS NOT NULL")


def resolve_levels(asked: DataFrame, campaigns: DataFrame, ad_groups: DataFrame) -> DataFrame:
    """asked with entity_type, source, source_name, method and confidence where its remote id resolves at a level of its pair.

    asked: target, remote_id, attribution_provider, marketing_provider. campaigns: campaign, name; ad_groups: ad_group,
    campaign (null: its parent isn't known, which resolves nothing). Levels come from the pair, in its order: an id that
    names an ad group for one pair may name a campaign for another. Ids of all levels are one relation, joined once.
    """
    places = [(a, m, level, i) for (a, m), levels in vocab.REMOTE_LEVELS.items() for i, level in enumerate(levels)]
    pairs = asked.sparkSession.createDataFrame(places, "attribution_provider string, marketing_provider string, level string, place int")
    known = pairs.select("attribution_provider", "marketing_provider", F.lit(True).alias("known")).distinct()
    of_campaign = campaigns.groupBy("campaign").agg(F.max("name").alias("source_name"))
    ids = of_campaign.select(F.col("campaign").alias("remote_id"), F.lit("campaign").alias("level"), F.col("campaign").alias("source"))
    parents = ad_groups.filter("campaign IS NOT NULL").groupBy(F.col("ad_group").alias("remote_id")).agg(F.min("campaign").alias("source"))
    ids = ids.unionByName(parents.select("remote_id", F.lit("ad_group").alias("level"), "source"))
    pair = ["attribution_provider", "marketing_provider"]
    tried = asked.filter("remote_id IS NOT NULL").join(F.broadcast(known), pair, "left").join(ids, "remote_id").join(F.broadcast(pairs), [*pair, "level"], "left")
    default = {level: i for i, level in enumerate(vocab.REMOTE_DEFAULT)}
    place = F.when(F.col("known"), F.col("place")).otherwise(scalars.lookup(default, F.col("level")))
    best = tried.withColumn("place", place).filter("place IS NOT NULL").groupBy("target", "remote_id", *pair).agg(F.min_by(F.struct("level", "source"), "place").alias("b"))
    method = F.when(F.col("b.level") == "ad_group", "remote_ad_group").otherwise("remote_campaign")
    named = best.select("target", "remote_id", *pair, F.col("b.level").alias("entity_type"), F.col("b.source").alias("source"), method.alias("method"), F.lit(1.0).alias("confidence"))
    return named.join(of_campaign.withColumnRenamed("campaign", "source"), "source", "left")


def candidates(attribution: DataFrame, expected_source: str | None = None) -> DataFrame:
    """The attribution campaigns that may be matched, by their media source."""
    if "media_source" not in attribution.columns:
        return attribution
    source = scalars.media_source(F.col("media_source"))
    paid = attribution.filter(~scalars.is_organic(F.col("media_source")))
    return paid if expected_source is None else paid.filter(source == expected_source)


def reconcile(campaigns: DataFrame, attribution: DataFrame, decided: DataFrame | None = None, ad_groups: DataFrame | None = None, expected_source: str | None = None) -> DataFrame:
    """source, target, status, method, confidence for every marketing campaign (several rows where several children match).

    campaigns: campaign, name. attribution: campaign, name, remote_id and, where known, media_source. decided: source, of
    campaigns that a human has settled; they are left alone. A target that an identifier resolves to another campaign is
    no candidate by name. Organic rows are unpaid traffic and no candidates; nor, where a source is expected, are those
    of another one.
    """
    attribution = candidates(attribution, expected_source)
    own = campaigns.join(decided.select(F.col("source").alias("campaign")).distinct(), "campaign", "left_anti") if decided is not None else campaigns
    remote = resolve_remote(attribution, campaigns, ad_groups)
    by_remote = _edges(remote.join(own.select(F.col("campaign").alias("source")), "source"), "matched_exact", "remote_id", 1.0, 1)
    same = own.join(attribution.select("campaign").distinct(), "campaign").select(F.col("campaign").alias("source"), F.col("campaign").alias("target"))
    by_id = _edges(same, "matched_exact", "stable_id", 1.0, 2)

    keyed = own.select(F.col("campaign").alias("source"), scalars.name_key(F.col("name")).alias("key")).filter("key IS NOT NULL")
    # Every campaign counts towards a name's ambiguity, those already decided too.
    uses = campaigns.select(scalars.name_key(F.col("name")).alias("key")).groupBy("key").agg(F.count("*").alias("uses"))
    named = keyed.join(uses, "key")
    resolved = remote.select("target").union(attribution.select(F.col("campaign").alias("target")).join(campaigns.select(F.col("campaign").alias("target")), "target", "left_semi")).distinct()
    free = attribution.select(F.col("campaign").alias("target"), F.posexplode(scalars.name_keys(F.col("name"))).alias("at", "key"), scalars.name_key(F.col("name")).alias("whole"))
    free = free.join(resolved, "target", "left_anti").withColumn("embedded", F.col("key") != F.coalesce("whole", F.lit("")))
    counts = free.groupBy("key").agg(F.count_if("embedded").alias("inside"), F.count_if(~F.col("embedded")).alias("bare"), F.min(F.when(~F.col("embedded"), F.col("target"))).alias("bare_target"))
    single = named.filter("uses = 1")
    met = single.join(counts, "key")
    inside = met.filter("inside > 0").select("source", "key").join(free.filter("embedded").select("key", "target"), "key")
    by_name = _edges(inside, "matched_fallback", "embedded_name", 0.9, 4)
    by_bare = _edges(met.filter("inside = 0 AND bare = 1").select("source", F.col("bare_target").alias("target")), "matched_fallback", "name", 0.5, 5)
    none = F.lit(None).cast("string")
    repeated = _edges(named.filter("uses > 1").join(counts.select("key"), "key", "left_semi").select("source", none.alias("target")), "ambiguous", "name", 0.25, 3)
    several = _edges(met.filter("inside = 0 AND bare > 1").select("source", none.alias("target")), "ambiguous", "name", 0.25, 6)
    missing = _edges(own.select(F.col("campaign").alias("source"), none.alias("target")), "unmatched", "none", 0.0, 7)

    found = by_remote
    for more in (by_id, repeated, by_name, by_bare, several, missing):
        found = found.unionByName(more)
    best = found.groupBy("source").agg(F.min("priority").alias("priority"))
    return found.join(best, ["source", "priority"]).select(*_EDGE[:-1]).distinct()


def reverse(attribution: DataFrame, campaigns: DataFrame, decided: DataFrame | None = None, ad_groups: DataFrame | None = None) -> DataFrame:
    """target, source, status, method, confidence: attribution campaigns seen from their side; organic ones don't apply.

    Those that an identifier has linked already, or that a human has settled (decided: target), are left out. Keys are the
    whole name's and the embedded ones'; just one marketing campaign under all of them together is a match, several are none.
    """
    organic = scalars.is_organic(F.col("media_source")) if "media_source" in attribution.columns else F.lit(False)
    declared = resolve_remote(candidates(attribution), campaigns, ad_groups).select(F.col("target").alias("campaign")).distinct()
    rows = attribution.withColumn("organic", organic).join(declared.withColumn("declared", F.lit(True)), "campaign", "left").filter("organic OR declared IS NULL").drop("declared")
    if decided is not None:
        rows = rows.join(decided.select(F.col("target").alias("campaign")).distinct().withColumn("settled", F.lit(True)), "campaign", "left").filter("organic OR settled IS NULL").drop("settled")
    names = campaigns.select(scalars.name_key(F.col("name")).alias("key"), "campaign").filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("uses"), F.min("campaign").alias("named"))
    keyed = rows.filter("NOT organic").select("campaign", F.posexplode(scalars.name_keys(F.col("name"))).alias("at", "key")).join(names, "key")
    found = keyed.groupBy("campaign").agg(F.sum("uses").alias("matches"), F.min("named").alias("named"), F.max((F.col("at") > 0) & (F.col("uses") == 1)).alias("embedded"))
    same = campaigns.select("campaign").distinct().withColumn("same", F.lit(True))
    met = rows.join(found, "campaign", "left").join(same, "campaign", "left")
    exact, one, inside = F.coalesce("same", F.lit(False)), F.coalesce(F.col("matches") == 1, F.lit(False)), F.coalesce("embedded", F.lit(False))
    status = F.when(F.col("organic"), "not_applicable").when(exact, "matched_exact").when(one, "matched_fallback").otherwise("unmatched")
    source = F.when(F.col("organic"), None).when(exact, F.col("campaign")).when(one, F.col("named"))
    method = F.when(F.col("organic"), "none").when(exact, "stable_id").when(inside, "embedded_name").otherwise("name")
    sure = F.when(F.col("organic"), 0.0).when(exact, 1.0).when(one & inside, vocab.OPERATIONAL_CONFIDENCE).when(one, 0.5).otherwise(0.0)
    return met.select(F.col("campaign").alias("target"), source.alias("source"), status.alias("status"), method.alias("method"), sure.alias("confidence"))


def health(coverage: DataFrame) -> DataFrame:
    """check_key and severity of a coverage row: spend, spend_coverage (per cent), unmapped_installs, ambiguous, historical."""
    checks = (
        ((F.col("spend") > 0) & (F.coalesce("spend_coverage", F.lit(0)) < vocab.COVERAGE_FLOOR), "reconciliation.current_period_spend_unmapped", "error"), (F.col("unmapped_installs") > 0, "reconciliation.paid_installs_unmapped", "warning"),
        (F.col("ambiguous") > 0, "reconciliation.ambiguous_campaigns", "warning"), (F.col("historical") > 0, "reconciliation.historical_campaigns_without_activity", "info"),
    )
    made = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("check_key"), F.lit(s).alias("severity"))) for c, k, s in checks)))
    return coverage.select(F.inline(made))


def authoritative_share(mappings: DataFrame) -> DataFrame:
    best = populations.best_mapping(mappings)
    return best.agg(scalars.ratio(F.count_if(populations.authoritative()), F.count("*")).alias("authoritative"), scalars.ratio(F.count_if(populations.operational()), F.count("*")).alias("operational"))
