"""Sync runs as data: their JSON windows, the days that they read, open findings and errors, and the context of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import scalars
from tidemark.operators import intervals

CHECKPOINT = "struct<dataWindows:array<struct<`from`:string,to:string>>,completedWindows:array<string>>"
DONE = ("completed", "partially_completed")


def data_windows(runs: DataFrame, apps: DataFrame) -> DataFrame:
    """app, data_type, from_date, to_date, finished (the local date in the app's zone) of each window that a finished run read."""
    held = runs.filter(F.col("status").isin(*DONE)).join(apps.select("app", "zone"), "app")
    out = held.select("run", "app", "data_type", scalars.local_date(F.col("finished_at"), F.col("zone")).alias("finished"), F.explode(F.from_json("checkpoint", CHECKPOINT)["dataWindows"]).alias("w"))
    return out.select("run", "app", "data_type", F.to_date("w.from").alias("from_date"), F.to_date("w.to").alias("to_date"), "finished")


def completed_windows(runs: DataFrame) -> DataFrame:
    """run, app, data_type, from_date, to_date: the windows that a run completed, and the whole run's if it's complete."""
    held = runs.filter(F.col("status").isin(*DONE))
    keys = F.transform(F.coalesce(F.from_json("checkpoint", CHECKPOINT)["completedWindows"], F.array().cast("array<string>")), scalars.key_window)
    whole = F.when(F.col("status") == "completed", F.array(F.struct(F.col("window_start").alias("from"), F.col("window_end").alias("to")))).otherwise(F.array().cast("array<struct<`from`:date,to:date>>"))
    out = held.select("run", "app", "connection", "data_type", "finished_at", F.explode(F.concat(keys, whole)).alias("w"))
    return out.select("run", "app", "connection", "data_type", "finished_at", F.col("w.from").alias("from_date"), F.col("w.to").alias("to_date")).filter("from_date <= to_date")


def run_errors(errors: DataFrame, runs: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Open errors with their run's app and data type, of these types only."""
    return errors.filter("resolved_at IS NULL").join(runs.select("run", "app", "data_type", "status").filter(F.col("data_type").isin(*types)), "run")


def current_findings(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings that no later run of the same connection and data type has read anew; those without a run stay.

    A finding of a day goes with a run that finished later and completed a window that holds the day; one without a day
    with any later finished run. Windows become days first, so both are joins by key.
    """
    of = findings.join(runs.select("run", "connection", "data_type"), "run", "left")
    days = completed_windows(runs).select("connection", "data_type", F.explode(F.sequence("from_date", "to_date")).alias("observed"), "finished_at")
    read = days.groupBy("connection", "data_type", "observed").agg(F.max("finished_at").alias("read_at"))
    last = runs.filter(F.col("status").isin(*DONE)).groupBy("connection", "data_type").agg(F.max("finished_at").alias("last_at"))
    held = of.join(read, ["connection", "data_type", "observed"], "left").join(last, ["connection", "data_type"], "left")
    later = F.when(F.col("observed").isNull(), F.col("last_at")).otherwise(F.col("read_at"))
    return held.filter(~F.coalesce(later > F.col("created_at"), F.lit(False))).drop("read_at", "last_at")


def day_signals(days: DataFrame, errors: DataFrame, windows: DataFrame, findings: DataFrame) -> DataFrame:
    """day with sync_error, uncovered and finding. days: day; errors: window_start, window_end (null ends are open);
    windows: from_date, to_date of what the installs' runs completed; findings: observed, severity, check_key."""
    hit = lambda df: df.distinct()
    wrong = intervals.holding(days, errors, "day", "window_start", "window_end")
    read = windows.select(F.explode(F.sequence("from_date", "to_date")).alias("day"))
    noted = findings.filter((F.col("severity") != "info") & F.col("observed").isNotNull() & ~F.col("check_key").isin(*vocab.LABEL_CHECKS) & ~F.col("check_key").startswith("reconciliation.")).select(F.col("observed").alias("day"))
    out = days
    for name, keys in (("sync_error", wrong), ("read", read), ("finding", noted)):
        out = out.join(hit(keys).withColumn(name, F.lit(True)), "day", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select("day", "sync_error", (~F.col("read")).alias("uncovered"), "finding")


def finding_counts(findings: DataFrame, first: Column, last: Column) -> DataFrame:
    """check_key, severity, n of the findings in the window (those without a day count), in order, without labelling checks."""
    inside = F.col("observed").isNull() | F.col("observed").between(first, last)
    rows = findings.filter(inside & ~F.col("check_key").isin(*vocab.LABEL_CHECKS)).groupBy("check_key", "severity").agg(F.count("*").alias("n"))
    return rows.orderBy("check_key", "severity")


def stream_context(streams: DataFrame) -> DataFrame:
    """role: the worst status of its streams, their latest day, and the earliest of their last successes.

    streams: role, status, latest_day, last_success. States that don't apply are passed over.
    """
    return streams.groupBy("role").agg(scalars.worst_freshness(F.col("status")).alias("status"), F.max("latest_day").alias("latest_day"), F.min("last_success").alias("last_success"), F.count("*").alias("streams"))


def stream_states(runs: DataFrame, checked: DataFrame) -> DataFrame:
    """app, data_type, status, last_success, latest_day of each stream, as a check at the app's checked_at records it.

    runs: app, data_type, status, finished_at, latest_day. What is expected of a stream goes by its type (vocab.EXPECTED_FRESHNESS).
    """
    done = F.col("status").isin(*DONE)
    seen = runs.groupBy("app", "data_type").agg(
        F.max(F.when(done, F.col("finished_at"))).alias("last_success"), F.max_by("status", "finished_at").alias("newest"), F.max("latest_day").alias("latest_day")
    )
    kind = F.when(F.col("data_type") == "marketing_structure", "structure").when(F.col("data_type") == "attribution_revenue", "revenue").otherwise(F.split_part("data_type", F.lit("_"), F.lit(1)))
    held = seen.join(checked, "app").withColumn("expected", scalars.lookup(vocab.EXPECTED_FRESHNESS, kind))
    age = F.date_diff(F.to_date("checked_at"), F.col("latest_day"))
    status = scalars.freshness(F.lit(True), F.col("newest") == "failed", scalars.minutes_since(F.col("last_success"), F.col("checked_at")), F.col("expected"), age)
    return held.select("app", "data_type", status.alias("status"), "last_success", "latest_day")


def recent(rows: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The newest n rows, for lists of runs, errors and findings."""
    return rows.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


def empty_state(connected: Column, synced: Column, rows: Column) -> Column:
    """Why a page shows nothing: not connected, never synced, or nothing in the range; null if it has rows."""
    return F.when(~connected, "unconnected").when(~synced, "never_synced").when(rows == 0, "empty_range")


def target_of(bindings: DataFrame) -> DataFrame:
    """app, marketing, attribution: the providers to reconcile, null unless both roles are bound (the first by name of each)."""
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("provider")))
    rows = bindings.groupBy("app").agg(of("marketing").alias("m"), of("attribution").alias("a"))
    both = F.col("m").isNotNull() & F.col("a").isNotNull()
    return rows.select("app", F.when(both, F.col("m")).alias("marketing"), F.when(both, F.col("a")).alias("attribution"))


def bound(bindings: DataFrame, connections: DataFrame, accounts: DataFrame) -> DataFrame:
    """bindings with their connection's provider and status, and their account's name where there is one."""
    return bindings.join(connections, "connection").join(accounts, ["connection", "account"], "left")
