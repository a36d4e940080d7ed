"""Fact tables that are written day by day: a commit writes only the days that it touches, and becomes visible at once.

A table lies under one root in the shared store: `data/commit=N/<day>=D/` holds the rows of day D as commit N left them, and
`manifest/version=N/` names, for every live day, the commit that holds it. A commit reads the stored rows of the touched days
alone, merges them with what was written, writes those days under its own number, and last the manifest. Readers take the
newest manifest that carries Spark's success marker, so they see all of a commit or nothing of it.

Exactly once: commits are numbered by their writer (a stream gives its batch's number). A number that a manifest already has
is passed over; what a commit that died has left is overwritten when the number comes again. The bytes of a commit grow with
the days that it touches, not with the table.

Rows carry when they last changed: generation counts how often a key was restated, restated_in is the commit that inserted or
last restated it. A restatement is a change of a measure; attributes (names and the like) are overwritten and don't count.
Days are a calendar, so manifests and lists of days are small at any size of the table; all else stays in executors.

Defined results: nulls in keys equal each other; a null measure differs from 0; of several rows of a key in one write the last
by order stays whole; rows of a null day are kept under a day of their own; an empty write makes an empty commit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import merge

_META = (("generation", "int"), ("restated_in", "long"))


@dataclass(frozen=True)
class Ledger:
    """keys (day among them) name a row, measures are compared, attributes follow; scope: columns within which a write that
    leaves a stored key out supersedes it (None: nothing is superseded)."""

    root: str
    day: str
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    attributes: tuple[str, ...] = ()
    scope: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.day not in self.keys or (self.scope is not None and self.day not in self.scope):
            raise ValueError("the day belongs to the keys, and to the scope where there is one")

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.measures, *self.attributes]


@dataclass(frozen=True)
class Version:
    """A manifest: number, the commit that holds each live day, and the types of the table's columns."""

    number: int
    days: dict
    schema: T.StructType


def _manifests(spark: SparkSession, ledger: Ledger) -> list[int]:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{ledger.root}/manifest")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def version(spark: SparkSession, ledger: Ledger, number: int | None = None) -> Version | None:
    """The newest manifest, or that of a number; None before the first commit."""
    held = _manifests(spark, ledger)
    if not held or (number is not None and number not in held):
        return None
    number = held[-1] if number is None else number
    rows = spark.read.schema("day date, commit long, schema string").parquet(f"{ledger.root}/manifest/version={number:010d}").collect()
    schema = next(r["schema"] for r in rows if r["schema"] is not None)
    return Version(number, {r["day"]: r["commit"] for r in rows if r["commit"] is not None}, T._parse_datatype_json_string(schema))


def _folder(ledger: Ledger, commit: int, day) -> str:
    return f"{ledger.root}/data/commit={commit:010d}/{ledger.day}={'__HIVE_DEFAULT_PARTITION__' if day is None else day.isoformat()}"


def read(spark: SparkSession, ledger: Ledger, at: Version | None, days: list | None = None) -> DataFrame | None:
    """The table's rows, of the given days only where given: no other file is listed or opened."""
    if at is None:
        return None
    chosen = [d for d in at.days if days is None or d in days]
    columns = [*ledger.columns, *(c for c, _ in _META)]
    if not chosen:
        return spark.createDataFrame([], T.StructType([at.schema[c] for c in columns]))
    stored = T.StructType([f for f in at.schema if f.name != ledger.day]).add("commit", "string").add(ledger.day, "date")
    rows = spark.read.schema(stored).option("basePath", f"{ledger.root}/data").parquet(*(_folder(ledger, at.days[d], d) for d in chosen))
    return rows.select(columns)


def _merged(ledger: Ledger, stored: DataFrame, written: DataFrame, number: int) -> DataFrame:
    """The touched days' rows after the write, with what it supersedes left out."""
    if ledger.scope is not None:
        gone = merge.superseded(stored, written, list(ledger.scope), list(ledger.keys)).select(*ledger.keys)
        stored = stored.alias("s").join(gone.alias("g"), merge._same("s", "g", list(ledger.keys)), "left_anti")
    old, new = stored.select("*", F.lit(True).alias("_old")).alias("s"), written.select("*", F.lit(True).alias("_new")).alias("w")
    joined = old.join(new, merge._same("s", "w", list(ledger.keys)), "full_outer")
    differs = F.lit(False)
    for m in ledger.measures:
        differs = differs | ~F.col(f"s.{m}").eqNullSafe(F.col(f"w.{m}"))
    is_new, is_old = F.col("w._new").isNotNull(), F.col("s._old").isNotNull()
    pick = [F.when(is_new, F.col(f"w.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in ledger.columns]
    changed = is_new & is_old & differs
    generation = F.coalesce("s.generation", F.lit(0)) + changed.cast("int")
    restated = F.when(is_new & (~is_old | changed), F.lit(number)).otherwise(F.col("s.restated_in")).cast("long")
    return joined.select(*pick, generation.alias("generation"), restated.alias("restated_in"))


def commit(ledger: Ledger, written: DataFrame, number: int, order: str | None = None) -> Version:
    """Merges written into the table as commit number and gives back the version that readers see then.

    The version before it is the newest of a lesser number; a number that is there already changes nothing.
    """
    spark, keys = written.sparkSession, list(ledger.keys)
    at = version(spark, ledger)
    if at is not None and at.number >= number:
        return at
    if at is not None and set(at.schema.names) != {*ledger.columns, *(c for c, _ in _META)}:
        raise ValueError("the table has other columns than what is written")
    last = F.col("_order") if order else F.struct(*ledger.measures)
    rows = written.select(*ledger.columns, *([F.col(order).alias("_order")] if order else []))
    rows = merge.last_written(rows, keys, last).select(ledger.columns)
    days = [r[0] for r in rows.select(ledger.day).distinct().collect()]
    held = read(spark, ledger, at, days)
    if held is None:
        held = rows.limit(0).select("*", *(F.lit(None).cast(t).alias(c) for c, t in _META))
    after, path = _merged(ledger, held, rows, number), f"{ledger.root}/data/commit={number:010d}"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in after.schema])
    # One exchange brings a day's rows together in files of even size; a large day is split over several.
    after.hint("rebalance", ledger.day).write.mode("overwrite").partitionBy(ledger.day).parquet(path)
    live = {} if at is None else {d: c for d, c in at.days.items() if d not in days}
    stored = T.StructType([f for f in schema if f.name != ledger.day]).add(ledger.day, "date")
    live |= {r[0]: number for r in spark.read.schema(stored).parquet(path).select(ledger.day).distinct().collect()} if days else {}
    entries = [(None, None, schema.json()), *((d, c, None) for d, c in live.items())]
    spark.createDataFrame(entries, "day date, commit long, schema string").coalesce(1).write.mode("overwrite").parquet(f"{ledger.root}/manifest/version={number:010d}")
    return Version(number, live, schema)


def vacuum(spark: SparkSession, ledger: Ledger, keep: int = 3) -> int:
    """Deletes manifests but the newest keep, and days of commits that none of these names; how many folders went."""
    numbers = _manifests(spark, ledger)
    kept = numbers[-max(1, keep) :]
    used = {_folder(ledger, c, d) for n in kept for d, c in version(spark, ledger, n).days.items()}
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    top = path(f"{ledger.root}/data")
    fs, gone = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for n in numbers[: len(numbers) - len(kept)]:
        fs.delete(path(f"{ledger.root}/manifest/version={n:010d}"), True)
        gone += 1
    for one in fs.listStatus(top) if kept and fs.exists(top) else []:
        name = one.getPath().getName()
        if int(name.split("=")[1]) > kept[-1]:  # a commit that is being written
            continue
        for day in fs.listStatus(one.getPath()):
            if day.isDirectory() and f"{ledger.root}/data/{name}/{day.getPath().getName()}" not in used:
                fs.delete(day.getPath(), True)
                gone += 1
    return gone
