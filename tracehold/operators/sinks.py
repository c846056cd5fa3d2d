"""Sinks that may be replayed, on plain Parquet folders.

Three kinds, all keyed by the number of the micro-batch that writes, so that a batch that failed half-way and comes
again leaves what it would have left at once:

* events are appended with their batch; ids that another batch stored are left out;
* logs (hits, alert deltas, assignments) have a folder a batch, which a replay overwrites;
* state (counters, baselines, incidents, open windows) is a few segments, each the merged rows of a range of batches. A
  batch writes a segment of its own rows; older ones are merged as they grow to one size, and readers merge what is left.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share. Where that is unset, a local session, as in tests, gets a temporary folder; elsewhere executors would not see it, so it is an error."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own = _own or f"file://{tempfile.mkdtemp(prefix='tracehold-')}"
        base = _own
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again, so that lineage ends there."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables stored for the length of one job; `clear` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(scratch(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


# Events


def _date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("ts"))


def _of_dates(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored events of the dates that rows have: partitions are pruned by the set of dates, of which there is one for each day at most, so an old event doesn't read the days between."""
    return stored.join(F.broadcast(rows.select("date").distinct()), "date", "left_semi")


def unseen(batch: DataFrame, path: str, number: int = 0) -> DataFrame:
    """Rows of the batch, one an id, that no other batch has stored; only the batch's own dates are looked at."""
    spark = batch.sparkSession
    new = batch.dropDuplicates(["id"])
    if not exists(spark, path):
        return new
    known = _of_dates(spark.read.parquet(path).where(F.col("batch") != number), _date(new)).select("id")
    return new.join(known, "id", "left_anti")


def write_events_idempotent(batch: DataFrame, path: str, number: int = 0) -> None:
    """Appends events whose id isn't stored, neither by another batch nor by this one before it failed."""
    spark = batch.sparkSession
    new = _date(batch.dropDuplicates(["id"])).withColumn("batch", F.lit(number))
    if exists(spark, path):
        new = new.join(_of_dates(spark.read.parquet(path), new).select("id"), "id", "left_anti")
    new.write.mode("append").partitionBy("date", "class_uid").parquet(path)


# Logs


def write_log(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_log(spark: SparkSession, path: str, other_than: int | None = None) -> DataFrame | None:
    """All batches' rows with their batch, or those of all other batches; None if there is nothing."""
    if not exists(spark, path):
        return None
    df = spark.read.parquet(path)
    return df if other_than is None else df.where(F.col("batch") != other_than)


# State

Merge = Callable[[DataFrame], DataFrame]
"""Rows of any number of batches to the state after them. It must not matter in which groups batches are merged: merge(merge(a + b) + c) = merge(a + b + c)."""


def _numbered(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows the prefix in the names of complete folders; one that a write left half-way has no mark of success."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)]
    return [x.getName()[len(prefix) :] for x in names if exists(spark, f"{x.toString()}/_SUCCESS")]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table that each batch writes anew, in order."""
    return sorted(int(x) for x in _numbered(spark, path, "version="))


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last complete version, or the last below `before`."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def segments(spark: SparkSession, path: str, before: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(first, last batch) of the segments that hold the batches below `before`, in order, and of those that a wider one has replaced."""
    found = [tuple(map(int, x.split("-"))) for x in _numbered(spark, path, "segment=")]
    kept, replaced = [], []
    for low, high in sorted((x for x in found if before is None or x[1] < before), key=lambda x: (x[0], -x[1])):
        (replaced if kept and low <= kept[-1][1] else kept).append((low, high))
    return kept, replaced


def _read(spark: SparkSession, path: str, found: list[tuple[int, int]]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f"{path}/segment={low}-{high}") for low, high in found])


def state(spark: SparkSession, path: str, merge: Merge, before: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
    """The state after all batches, or after those below `before`; None if there is none. only: a table of keys, where no other key's rows are asked for: they are left out before rows are merged."""
    found, _ = segments(spark, path, before)
    if not found:
        return None
    rows = _read(spark, path, found)
    return merge(rows if only is None else rows.join(only.distinct(), only.columns, "left_semi"))


def advance(batch: DataFrame, path: str, number: int, merge: Merge) -> None:
    """Writes batch `number`'s own rows, merged, as a segment, after older segments have been compacted. Batches are numbered from 0."""
    compact(batch.sparkSession, path, number, merge)
    merge(batch).write.mode("overwrite").parquet(f"{path}/segment={number}-{number}")


def compact(spark: SparkSession, path: str, number: int, merge: Merge, least: int = 4) -> None:
    """Merges the last segments of the batches below `number`, whose writers are committed, where `least` or more have grown to one size.

    A segment goes in if it is no larger than those after it together. So there are never more than the logarithm of the batches and `least`,
    and a row is written anew that often at most, whatever the size of the state. A segment that was left half-way is not read, and is written
    again. What is replaced is removed by the next call, when readers that listed it are through.
    """
    found, replaced = segments(spark, path, number)
    for low, high in replaced:
        remove(spark, f"{path}/segment={low}-{high}")
    tail, size = [], 0
    for low, high in reversed(found):
        fs, p = _folder(spark, f"{path}/segment={low}-{high}")
        own = fs.getContentSummary(p).getLength()
        if tail and own > size:
            break
        tail, size = [(low, high), *tail], size + own
    if len(tail) >= least:
        merge(_read(spark, path, tail)).write.mode("overwrite").parquet(f"{path}/segment={tail[0][0]}-{tail[-1][1]}")


def by_key(keys: list[str], *merged: Column) -> Merge:
    return lambda df: df.groupBy(*keys).agg(*merged)


def _baselines() -> Merge:
    return by_key(["asset_id", "exe_path"], F.min("first_seen").alias("first_seen"))


def write_baselines(batch: DataFrame, path: str, number: int) -> None:
    advance(batch, path, number, _baselines())


def read_baselines(spark: SparkSession, path: str, before: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
    return state(spark, path, _baselines(), before, only)


def _counters(key: str) -> Merge:
    return by_key([key], F.sum("hits").alias("hits"), F.max("last").alias("last"))


def write_counters(batch: DataFrame, path: str, key: str, number: int) -> None:
    """batch: key, hits, last; added to the totals of the batches before it."""
    advance(batch, path, number, _counters(key))


def read_counters(spark: SparkSession, path: str, key: str, before: int | None = None) -> DataFrame | None:
    return state(spark, path, _counters(key), before)


def _last_rows(ts: str) -> Merge:
    def merge(df: DataFrame) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c != "id"])
        return df.groupBy("id").agg(F.max_by(row, F.struct(ts, row)).alias("_r")).select("id", "_r.*")

    return merge


def write_incidents(batch: DataFrame, path: str, number: int, ts: str = "updated_at") -> None:
    """batch: id, `ts` and other columns; of each incident the row with the last `ts` stays, of equal ones the greatest row."""
    advance(batch, path, number, _last_rows(ts))


def read_incidents(spark: SparkSession, path: str, before: int | None = None, ts: str = "updated_at") -> DataFrame | None:
    return state(spark, path, _last_rows(ts), before)


def _windows() -> Merge:
    return by_key(["fingerprint"], F.max_by("first_ts", "batch").alias("first_ts"), F.max("batch").alias("batch"))


def write_windows(batch: DataFrame, path: str, number: int, forget: int) -> None:
    """batch: fingerprint, first_ts: the alert window that each has open. Those without a hit in `forget` batches go when segments are merged."""
    rows = batch.withColumn("batch", F.lit(number).cast("long"))
    advance(rows, path, number, lambda df: _windows()(df).where(F.col("batch") >= number - forget))


def read_windows(spark: SparkSession, path: str, number: int, forget: int, only: DataFrame | None = None) -> DataFrame | None:
    """What was open before batch `number`, of all fingerprints or of those in `only`."""
    return state(spark, path, lambda df: _windows()(df).where(F.col("batch") >= number - forget), number, only)


# Alerts: a log of deltas


def upsert_alerts(deltas: DataFrame, path: str, number: int) -> None:
    """deltas: fingerprint, first_ts, rule_id, asset_id, severity, added, last_ts, event_id. A delta begins an alert or adds to the one of its fingerprint and first time."""
    write_log(deltas, path, number)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint, first_ts, rule_id, asset_id, severity, count, last_ts, event_id), one row an alert."""
    order = F.struct("batch", "event_id")
    return spark.read.parquet(path).groupBy("fingerprint", "first_ts").agg(F.min_by("rule_id", order).alias("rule_id"), F.min_by("asset_id", order).alias("asset_id"), F.max("severity").alias("severity"), F.sum("added").alias("count"), F.max("last_ts").alias("last_ts"), F.min_by("event_id", order).alias("event_id"))
