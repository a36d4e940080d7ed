"""Idempotent writes: restatement-aware merges, superseded dimensions, protected human decisions, append-only dedup.

Stored and written rows meet in one full outer join on the key. Parquet has no update in place, so a merge returns the
table's next version; save_version writes it beside the others and latest_version reads the newest complete one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars


def last_written(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key: the one of greatest order."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def merge_facts(stored: DataFrame, written: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """keys, measures, outcome: inserted, restated, unchanged, or kept (stored and not written).

    Nulls in keys equal each other, and a null measure differs from 0. generation, where stored has it, counts how often
    a row was restated.
    """
    old = stored.select("*", F.lit(True).alias("_old")).alias("s")
    new = written.select(*keys, *measures, F.lit(True).alias("_new")).alias("w")
    joined = old.join(new, _same("s", "w", keys), "full_outer")
    differs = F.lit(False)
    for m in measures:
        differs = differs | ~F.col(f"s.{m}").eqNullSafe(F.col(f"w.{m}"))
    is_new, is_old = F.col("w._new").isNotNull(), F.col("s._old").isNotNull()
    outcome = F.when(~is_new, "kept").when(~is_old, "inserted").when(differs, "restated").otherwise("unchanged")
    pick = lambda c: F.when(is_new, F.col(f"w.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    columns = [*map(pick, [*keys, *measures]), outcome.alias("outcome")]
    if "generation" in stored.columns:
        columns.append((F.coalesce("s.generation", F.lit(0)) + F.when(outcome == "restated", 1).otherwise(0)).alias("generation"))
    return joined.select(*columns)


def outcomes(merged: DataFrame) -> DataFrame:
    return merged.groupBy("outcome").agg(F.count("*").alias("n"))


def superseded(stored: DataFrame, written: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Stored rows that a write replaces by leaving them out: their scope was written, their key was not."""
    scopes, keyed = written.select(*scope).distinct().alias("w"), written.select(*keys).distinct().alias("k")
    touched = stored.alias("s").join(scopes, _same("s", "w", scope), "left_semi")
    return touched.alias("s").join(keyed, _same("s", "k", keys), "left_anti")


def restate(stored: DataFrame, written: DataFrame, scope: list[str], keys: list[str], measures: list[str]) -> DataFrame:
    """The next version of a fact table: merged, and without what the write supersedes."""
    gone = superseded(stored, written, scope, keys).select(*keys)
    left = stored.alias("s").join(gone.alias("g"), _same("s", "g", keys), "left_anti")
    return merge_facts(left, written, keys, measures)


def upsert_latest(stored: DataFrame, written: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Dimension upsert: of all rows of a key the newest by order stays."""
    return last_written(stored.unionByName(written, allowMissingColumns=True), keys, F.col(order))


def append_new(stored: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of written whose key is neither stored nor met before in the batch; nulls equal each other."""
    fresh = written.dropDuplicates(keys).alias("w")
    return fresh.join(stored.select(*keys).distinct().alias("s"), _same("w", "s", keys), "left_anti")


def merge_mappings(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Computed edges over stored ones: a human's decision stays as it is, edges not computed again go."""
    key, fields = ["source", "target"], ["status", "method", "confidence"]
    human = F.col("s.status").isin(*vocab.HUMAN_DECIDED)
    joined = stored.alias("s").join(computed.alias("w"), _same("s", "w", key), "full_outer")
    live = joined.filter(F.coalesce(human, F.lit(False)) | F.col("w.status").isNotNull())
    pick = lambda c: F.when(F.coalesce(human, F.lit(False)), F.col(f"s.{c}")).otherwise(F.coalesce(F.col(f"w.{c}"), F.col(f"s.{c}"))).alias(c)
    return live.select(*(F.coalesce(f"w.{k}", f"s.{k}").alias(k) for k in key), *map(pick, fields))


def decide(mappings: DataFrame, source: str, target: str, accept: bool) -> DataFrame:
    """A human verifies or rejects one edge."""
    it = F.col("source").eqNullSafe(F.lit(source)) & F.col("target").eqNullSafe(F.lit(target))
    new = {"status": F.lit("manually_verified" if accept else "rejected"), "method": F.lit("manual"), "confidence": F.lit(1.0 if accept else 0.0)}
    return mappings.withColumns({c: F.when(it, v).otherwise(F.col(c)) for c, v in new.items()})


def replace_findings(stored: DataFrame, found: DataFrame, owned: list[str]) -> DataFrame:
    """Findings of the owned checks are replaced, others stay."""
    return stored.filter(~F.col("check_key").isin(*owned)).unionByName(found)


def merge_freshness(stored: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """New values where there are any; the newest day never goes back."""
    joined = stored.alias("s").join(seen.alias("w"), _same("s", "w", keys), "full_outer")
    newer = lambda c: F.coalesce(F.col(f"w.{c}"), F.col(f"s.{c}")).alias(c)
    return joined.select(*map(newer, keys), newer("status"), newer("last_success"), F.greatest("s.latest_day", "w.latest_day").alias("latest_day"))


def open_errors(errors: DataFrame, runs: DataFrame) -> DataFrame:
    """Errors that no later completed window settles.

    A retryable error goes once one window holds its own; another only by a window equal to it. An error without a
    window goes with a later run that is complete (runs: complete; all of them where the column lacks). Windows become
    days, so the join is by key: an error is held by a run whose window has its first day, if that window ends late enough.
    """
    done = runs.filter("complete") if "complete" in runs.columns else runs
    last = done.agg(F.max("finished").alias("last"))
    whole = F.col("from_date").isNull() & F.coalesce(F.col("last") > F.col("occurred"), F.lit(False))
    errors = errors.crossJoin(F.broadcast(last)).filter(~whole).drop("last")
    days = runs.select(F.explode(F.sequence("from_date", "to_date")).alias("day"), F.col("from_date").alias("run_from"), F.col("to_date").alias("run_to"), "finished")
    retryable = F.col("error_class").isin(*vocab.RETRYABLE_ERRORS)
    inside = F.col("run_to") >= F.col("to_date")
    equal = (F.col("run_from") == F.col("from_date")) & (F.col("run_to") == F.col("to_date"))
    settled = (F.col("from_date") == F.col("day")) & (F.col("finished") > F.col("occurred")) & F.when(retryable, inside).otherwise(equal)
    return errors.join(days, settled, "left_anti")


def save_version(table: DataFrame, root: str, version: int) -> str:
    """Writes a version in a folder of its own; readers see it once Spark's success marker is there.

    A folder without the marker is what a write that failed has left, and is written anew; a complete version stays as it is.
    """
    path, spark = f"{root}/version={version:010d}", table.sparkSession
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        table.write.mode("overwrite").parquet(path)
    return path


def drop_versions(spark: SparkSession, root: str, keep: int = 3) -> int:
    """Deletes all complete versions but the newest keep; how many went."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(s.getPath().getName() for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(top) else []
    old = done[: max(0, len(done) - max(1, keep))]
    for name in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(top, name), True)
    return len(old)


def restate_days(stored: DataFrame, written: DataFrame, day: str, keys: list[str], measures: list[str]) -> DataFrame:
    """The rows of the days that a write touches, merged: all that a table partitioned by day has to write anew."""
    touched = stored.join(written.select(day).distinct(), day, "left_semi")
    return merge_facts(touched, written, keys, measures)


def backfill_parent(facts: DataFrame, dimension: DataFrame, keys: list[str], parent: str) -> DataFrame:
    """facts whose parent id is filled from the dimension by the keys where it is null; one that is there stays."""
    known = dimension.groupBy(*keys).agg(F.max(parent).alias("_parent"))
    return facts.join(known, keys, "left").withColumn(parent, F.coalesce(parent, "_parent")).drop("_parent")


def append_checkpoint(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """runs (run, windows: array of keys, data_windows: array of structs) with the windows that finished, each once, in order of arrival.

    finished: run, position, window, data_window (null if the window held no data).
    """
    rows = F.array_sort(F.collect_list(F.struct("position", "window", "data_window")))
    more = finished.groupBy("run").agg(rows.alias("more"))
    fresh = F.filter(F.coalesce("more", F.array()), lambda m: ~F.array_contains(F.coalesce("windows", F.array().cast("array<string>")), m["window"]))
    joined = runs.join(more, "run", "left").withColumn("more", F.when(F.col("more").isNotNull(), fresh))
    windows = F.array_distinct(F.concat(F.coalesce("windows", F.array().cast("array<string>")), F.coalesce(F.transform("more", lambda m: m["window"]), F.array().cast("array<string>"))))
    data = F.when(F.col("more").isNull(), F.col("data_windows")).otherwise(F.concat("data_windows", F.filter(F.transform("more", lambda m: m["data_window"]), lambda w: w.isNotNull())))
    return joined.select(*[c for c in runs.columns if c not in ("windows", "data_windows")], windows.alias("windows"), data.alias("data_windows"))


def new_sources(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """Directory rows (source, normal, organic) of the raw sources that the facts hold and the directory lacks: insert only."""
    named = facts.select(F.trim("media_source").alias("source")).filter("source <> ''").distinct()
    fresh = named.join(stored.select("source"), "source", "left_anti")
    return fresh.select("source", scalars.media_source(F.col("source")).alias("normal"), scalars.is_organic(F.col("source")).alias("organic"))


def put_policies(stored: DataFrame, written: DataFrame, removed: DataFrame) -> DataFrame:
    """One policy an app: a written one replaces the stored one whole, and those of removed apps go."""
    kept = stored.join(written.select("app"), "app", "left_anti").unionByName(written)
    return kept.join(removed.select("app"), "app", "left_anti")


def capability_of(capabilities: DataFrame) -> DataFrame:
    """The row that counts for each connection and capability: the account's own before the connection's, then the newest."""
    best = F.max_by(F.struct("account", "supported", "seen"), F.struct(F.col("account").isNotNull(), F.col("seen"), F.coalesce("account", F.lit(""))))
    return capabilities.groupBy("connection", "capability").agg(best.alias("b")).select("connection", "capability", "b.*")


def latest_version(spark: SparkSession, root: str) -> tuple[int, DataFrame] | None:
    """Number and rows of the newest complete version."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    found = [s.getPath() for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not found:
        return None
    path = max(found, key=lambda p: p.getName())
    return int(path.getName().split("=")[1]), spark.read.parquet(path.toString())
