"""Campaign table, discrepancies, filter options and coverage by state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars
from tidemark.operators import populations


def campaign_table(
    delivery: DataFrame, mappings: DataFrame, installs: DataFrame, revenue: DataFrame, directory: DataFrame | None = None, status: str | None = None
) -> DataFrame:
    """One row for each delivered campaign: delivery sums, best mapping, and its children's installs and revenue.

    Installs and revenue are summed by attribution campaign before they meet the mapping's edges, so several children
    add up and nothing is counted twice; they show only where the best mapping is operational, and are null where no
    row reports any. Organic rows belong to no campaign. directory: campaign, name, status (several rows a campaign are
    folded to the greatest of each). Rows without a campaign are no campaign. status keeps the campaigns whose best mapping
    has it (one without a mapping counts as unmatched). total_count is the number of rows then, before any page is cut.
    """
    delivery = delivery.filter("campaign IS NOT NULL")
    paid = ~scalars.is_organic(F.col("media_source"))
    sums = delivery.groupBy("campaign").agg(F.sum("spend").alias("spend"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.max("report_date").alias("last_day"))
    links = mappings.filter(populations.authoritative() | (F.col("status") == "matched_fallback")).filter("target IS NOT NULL").select("source", "target").distinct()
    taken = installs.filter(paid).groupBy("campaign").agg(F.sum("installs").alias("installs"), F.max("install_date").alias("last_install_day"))
    earned = revenue.filter(paid).groupBy("campaign").agg(F.sum("revenue").alias("revenue"))
    children = (
        links.join(taken, links["target"] == taken["campaign"], "left").drop("campaign").join(earned, F.col("target") == earned["campaign"], "left")
        .groupBy("source").agg(F.count("*").alias("children"), F.array_sort(F.collect_list("target")).alias("targets"), F.sum("installs").alias("installs"), F.sum("revenue").alias("revenue"), F.max("last_install_day").alias("last_install_day"))
    )
    best = populations.best_mapping(mappings).select(F.col("source").alias("campaign"), "target", "status", "method", "confidence", populations.operational().alias("shown"))
    rows = sums.join(best, "campaign", "left")
    if status is not None:
        rows = rows.filter(F.coalesce("status", F.lit("unmatched")) == status)
    rows = rows.join(children.withColumnRenamed("source", "campaign"), "campaign", "left")
    if directory is not None:
        rows = rows.join(directory.groupBy("campaign").agg(F.max("name").alias("name"), F.max("status").alias("campaign_status")), "campaign", "left")
    else:
        rows = rows.withColumns({"name": F.lit(None).cast("string"), "campaign_status": F.lit(None).cast("string")})
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total_count"))))
    shown = lambda c: F.when(F.col("shown"), c)
    return rows.select(
        "campaign", "name", "campaign_status", F.col("spend").cast("double").alias("spend"), "impressions", "clicks", "last_day", F.coalesce("status", F.lit("not_computed")).alias("mapping_status"), F.col("method").alias("mapping_method"),
        F.col("confidence").alias("mapping_confidence"), F.col("target").alias("attribution_campaign"), F.coalesce("children", F.lit(0)).alias("children"), F.array_join(F.coalesce("targets", F.array().cast("array<string>")), ",").alias("targets"), "last_install_day", "total_count",
        shown(F.col("installs")).alias("installs"), shown(F.col("revenue")).cast("double").alias("revenue"),
        scalars.ratio(F.col("clicks"), F.col("impressions"), vocab.MIN_IMPRESSIONS).alias("ctr"), scalars.ratio(F.col("spend").cast("double") * 1000, F.col("impressions"), vocab.MIN_IMPRESSIONS).alias("cpm"),
        scalars.ratio(F.col("spend"), F.col("clicks"), vocab.MIN_CLICKS).alias("cpc"), scalars.ratio(F.col("spend"), shown(F.col("installs")), vocab.MIN_INSTALLS).alias("cpi"),
        scalars.attribution_note(F.col("status"), F.col("confidence"), F.col("children")).alias("note"),
    )


def page(table: DataFrame, sort: str = "spend", ascending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a table, nulls last, ties by campaign."""
    order = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last()
    return table.orderBy(order, F.col("campaign").asc()).offset(offset).limit(limit)


def delivery_without_attribution(delivery: DataFrame, mappings: DataFrame) -> DataFrame:
    """Campaigns that spent without an operational mapping."""
    linked = mappings.filter(populations.operational()).select(F.col("source").alias("campaign")).distinct()
    return delivery.groupBy("campaign").agg(F.sum("spend").alias("spend")).filter("spend > 0").join(linked, "campaign", "left_anti")


def attribution_without_mapping(installs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Attribution campaigns with installs that no operational mapping reaches; organic ones are not left out."""
    sums = installs.groupBy("campaign").agg(F.sum("installs").alias("installs")).filter("installs > 0")
    out = sums.join(populations.linked_targets(mappings).distinct(), "campaign", "left_anti")
    return out.withColumn("kind", F.when(F.col("campaign").isNull(), "no_campaign_id").otherwise("not_mapped"))


def filter_options(delivery: DataFrame, installs: DataFrame) -> DataFrame:
    """Distinct values of each filter over both fact tables."""
    pick = lambda df, c: df.select(F.lit(c).alias("filter"), F.col(c).alias("value")).filter("value IS NOT NULL")
    return pick(delivery, "country").union(pick(installs, "country")).union(pick(delivery, "platform")).union(pick(installs, "platform")).distinct()


def structure_coverage(mappings: DataFrame) -> DataFrame:
    """Campaigns by status, method and standing of their best mapping."""
    return populations.best_mapping(mappings).groupBy("status", "method", populations.operational().alias("operational")).agg(F.count("*").alias("campaigns"))


def delivery_states(delivery: DataFrame, mappings: DataFrame) -> DataFrame:
    """Delivered campaigns and spend by state: mapped before ambiguous before unmapped."""
    live = delivery.filter(populations.delivered()).groupBy("campaign").agg(F.sum("spend").alias("spend"))
    key = lambda cond: mappings.filter(cond).select(F.col("source").alias("campaign"))
    rows = populations.flag(populations.flag(live, key(populations.operational()), "mapped"), key(F.col("status") == "ambiguous"), "ambiguous")
    state = F.when(F.col("mapped"), "mapped").when(F.col("ambiguous"), "ambiguous").otherwise("unmapped")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("campaigns"), F.sum("spend").cast("double").alias("spend"))


def install_states(installs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Installs by state: organic, mapped (an edge in either direction), ambiguous, unmapped."""
    good = mappings.filter(populations.operational())
    ends = good.select(F.col("target").alias("campaign")).union(good.select(F.col("source").alias("campaign"))).filter("campaign IS NOT NULL")
    unsure = mappings.filter("status = 'ambiguous' AND target IS NOT NULL").select(F.col("target").alias("campaign"))
    rows = populations.flag(populations.flag(installs, ends, "mapped"), unsure, "ambiguous")
    state = F.when(scalars.is_organic(F.col("media_source")), "organic").when(F.col("mapped"), "mapped").when(F.col("ambiguous"), "ambiguous").otherwise("unmapped")
    return rows.groupBy(state.alias("state")).agg(F.sum("installs").alias("installs"), F.count_distinct("campaign").alias("campaigns"))


def hierarchy_completeness(*edges: tuple[str, DataFrame, str]) -> DataFrame:
    """edge, linked, total: rows whose parent key is known, for each (name, table, parent column)."""
    out = None
    for name, table, parent in edges:
        one = table.agg(F.lit(name).alias("edge"), F.count(parent).alias("linked"), F.count("*").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out
