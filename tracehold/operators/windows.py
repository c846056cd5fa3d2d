"""Window operators: anchored de-duplication, sampling, gaps, brute force, first-seen, latest state.

The greedy folds (a row opens a window that later rows of its key join) can't be told from neighbouring rows alone. They
run in two steps: gaps of at least the window start a new chain for sure, which splits a key's rows into short runs
with an ordinary window function; only inside a run of close rows is the opener carried along in an aggregate, which holds
the run's distinct times and its openers.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(w: timedelta) -> float:
    return w.total_seconds()


def dedup_window(hits: DataFrame, keys: Iterable[str], ts: str, window: timedelta) -> DataFrame:
    """hits with window_no and first_ts: the first hit of a key opens a window; hits less than `window` after the opener join it, a hit at exactly `window` opens the next. Rows with a null time are left out.

    Times are told apart first, so the fold holds one number for each distinct time of a run.
    """
    keys = list(keys)
    micros = F.unix_micros(F.col(ts))
    width = round(_seconds(window) * 1e6)
    order = Window.partitionBy(*keys).orderBy("_t")
    times = hits.where(F.col(ts).isNotNull()).select(*keys, micros.alias("_t")).distinct()
    runs = times.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(order) >= width).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    first = F.struct(F.lit(None).cast("bigint").alias("open"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        opens = acc["open"].isNull() | (t - acc["open"] >= width)
        return F.when(opens, F.struct(t.alias("open"), F.concat(acc["out"], F.array(t)).alias("out"))).otherwise(acc)

    fold = F.aggregate(F.sort_array(F.collect_list("_t")), first, step, lambda acc: acc["out"])
    openers = runs.groupBy(*keys, "_run").agg(fold.alias("_o")).select(*keys, F.explode("_o").alias("_t"), F.lit(True).alias("_opens"))
    marked = times.select(*keys, "_t", F.lit(False).alias("_opens")).unionByName(openers).groupBy(*keys, "_t").agg(F.max("_opens").alias("_opens"))
    placed = marked.withColumn("_open", F.last(F.when(F.col("_opens"), F.col("_t")), ignorenulls=True).over(order))
    numbered = placed.withColumn("window_no", F.sum(F.col("_opens").cast("int")).over(order))
    on = [F.col(f"h.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys] + [F.col("h._t") == F.col("p._t")]
    both = hits.withColumn("_t", micros).alias("h").join(numbered.alias("p"), on)
    return both.select(*[F.col(f"h.{c}") for c in hits.columns], F.col("p.window_no").cast("long").alias("window_no"), F.timestamp_micros(F.col("p._open")).alias("first_ts"))


def alert_rollup(hits: DataFrame, keys: Iterable[str], ts: str, window: timedelta, event_id: str = "id") -> DataFrame:
    """One row for each key and window: count, first_ts, last_ts, severity, first event."""
    keys = list(keys)
    return dedup_window(hits, keys, ts, window).groupBy(*keys, "window_no").agg(F.count("*").alias("count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.max("severity").alias("severity"), F.min(F.struct(ts, event_id))[event_id].alias("event_id"))


def sample_first(df: DataFrame, keys: Iterable[str], ts: str, interval: timedelta) -> DataFrame:
    """Rows at least `interval` after the last row kept of their key."""
    return dedup_window(df, keys, ts, interval).where(F.col("first_ts") == F.col(ts)).drop("window_no", "first_ts")


def gap_sessions(df: DataFrame, key: str, ts: str, gap: timedelta, tie: str) -> DataFrame:
    """df with session_no: a row joins the one before it of its key if it comes at most `gap` later; a null key is a key of its own."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    far = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(order)) > round(_seconds(gap) * 1e6)
    return df.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("session_no", F.sum("_new").over(order)).drop("_new")


def brute_force_success(auth: DataFrame, window: timedelta = timedelta(minutes=10), threshold: int = 5) -> DataFrame:
    """Successes (status_id 1) of an asset and user with at least `threshold` failures (status_id 2) in the window up to them: hits of severity 5."""
    span = round(_seconds(window) * 1e6)
    frame = Window.partitionBy("asset_id", "username").orderBy("_t").rangeBetween(-span, 0)
    counted = auth.where(F.col("status_id").isin(1, 2) & F.col("username").isNotNull()).withColumn("_t", F.unix_micros("ts")).withColumn("failures", F.count_if(F.col("status_id") == 2).over(frame))
    return counted.where((F.col("status_id") == 1) & (F.col("failures") >= threshold)).drop("_t").withColumns({"rule_id": F.lit("bruteforce:success"), "severity": F.lit(5)})


def learning_start(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy("asset_id").agg(F.min("first_seen").alias("learning_start"))


def first_seen(events: DataFrame, learning: timedelta = timedelta(days=7), baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(baseline rows that are new, hits): a program first seen on an asset once its learning period is over. events: id, ts, asset_id, exe_path."""
    seen = events.where(F.col("exe_path").isNotNull() & F.col("asset_id").isNotNull()).groupBy("asset_id", "exe_path").agg(F.min(F.struct("ts", "id")).alias("first"))
    fresh = seen.select("asset_id", "exe_path", F.col("first.ts").alias("first_seen"), F.col("first.id").alias("event_id"))
    if baseline is not None:
        fresh = fresh.join(baseline, ["asset_id", "exe_path"], "left_anti")
    known = fresh.select("asset_id", "first_seen")
    start = learning_start(known if baseline is None else known.unionByName(baseline.select("asset_id", "first_seen")))
    late = F.unix_micros("first_seen") - F.unix_micros("learning_start") >= round(_seconds(learning) * 1e6)
    hits = fresh.join(start, "asset_id").where(late).select("event_id", "asset_id", "exe_path", F.col("first_seen").alias("ts"), F.lit("ueba:first_seen").alias("rule_id"), F.lit(2).alias("severity"))
    return fresh.select("asset_id", "exe_path", "first_seen"), hits


def latest_state(df: DataFrame, key: str, ts: str, tie: str | None = None) -> DataFrame:
    """The last row of each key, as one aggregate."""
    order = F.struct(ts, *( [tie] if tie else []))
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, order).alias("_r")).select(key, "_r.*")


def latest_open_alert(alerts: DataFrame, incidents: DataFrame, since: Column) -> DataFrame:
    """The newest alert of each asset not older than `since` whose incident is open or triaged."""
    open_ones = incidents.where(F.col("status").isin("open", "triaged")).select(F.col("id").alias("incident_id"))
    found = alerts.join(open_ones, "incident_id", "left_semi").where(F.col("ts") >= since)
    return found.groupBy("asset_id").agg(F.max(F.struct("ts", "id", "incident_id")).alias("a")).select("asset_id", "a.ts", "a.id", "a.incident_id")


def resolve_process_instance(starts: DataFrame, host: str = "host", pid: str = "pid", ppid: str = "ppid", ts: str = "ts") -> DataFrame:
    """Launch rows (guid, host, pid, ppid, ts) with parent_guid: the latest earlier start of ppid on the host. As-of join by union and a running last value."""
    asks = starts.withColumns({"_h": F.col(host), "_p": F.col(ppid), "_t": F.col(ts), "_k": F.lit(0), "_g": F.lit(None).cast("string")})
    gives = starts.select(F.col(host).alias("_h"), F.col(pid).alias("_p"), F.col(ts).alias("_t"), F.lit(1).alias("_k"), F.col("guid").cast("string").alias("_g"))
    order = Window.partitionBy("_h", "_p").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asks.unionByName(gives, allowMissingColumns=True).withColumn("parent_guid", F.last("_g", ignorenulls=True).over(order))
    return both.where("_k = 0").select(*starts.columns, "parent_guid")


def ingest_loss(agent_events: DataFrame, agent: str = "agent_id", ts: str = "ts", dropped: str = "dropped_events") -> DataFrame:
    """Events that each agent reports as dropped: growth of a running counter, which begins anew when the agent does."""
    before = F.lag(dropped).over(Window.partitionBy(agent).orderBy(ts))
    grown = F.when(before.isNull() | (F.col(dropped) < before), F.col(dropped)).otherwise(F.col(dropped) - before)
    return agent_events.withColumn("_g", grown).groupBy(agent).agg(F.sum("_g").alias("dropped"))
