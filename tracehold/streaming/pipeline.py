"""The operators under Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions.scalars import fingerprint, flow_key
from ..operators import correlate, detect, flows, sinks, windows
from ..operators.detect import RuleSet


def without_replays(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A record comes once within the watermark; older replays are the sink's matter (write_events_idempotent)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def split_late(batch: DataFrame, watermark: str | None) -> tuple[DataFrame, DataFrame]:
    """(on time, late) by a query's last watermark; late rows are for a table of their own."""
    if not watermark:
        return batch, batch.limit(0)
    edge = F.lit(watermark).cast("timestamp")
    return batch.where(F.col("ts") >= edge), batch.where(F.col("ts") < edge)


class _Windows(StatefulProcessor):
    """An alert window a fingerprint: the first hit's time, and the newest hit's."""

    def __init__(self, width: pd.Timedelta, forget: timedelta):
        self.width, self.forget = width, round(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "first bigint", self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = pd.Timestamp(self.open.get()[0], unit="us") if self.open.exists() else None
        out: list[list] = []
        for ts in pd.concat(list(rows))["ts"].sort_values():
            new = first is None or not pd.Timedelta(0) <= ts - first < self.width
            if new:
                first = ts
            if new or not out:
                out.append([key[0], first, 0, ts, new])
            out[-1][2] += 1
            out[-1][3] = max(out[-1][3], ts)
        self.open.update((int(first.value // 1000),))
        yield pd.DataFrame(out, columns=["fingerprint", "first_ts", "added", "last_ts", "is_new"])

    def close(self) -> None:
        pass


def stateful_dedup(hits: DataFrame, window: timedelta, forget: timedelta = timedelta(days=1)) -> DataFrame:
    """hits (fingerprint, ts) to alert deltas: fingerprint, first_ts, added, last_ts, is_new, by a state store (RocksDB, which the session must name).

    One state row a fingerprint. Its hits are taken in order of time inside a micro-batch; a hit from the first one's time on and within
    the window joins it, any other, also one that comes late, opens a window of its own, which later hits are held against. A state
    goes when its fingerprint has had no hit for `forget` of the clock on the wall: no other event's time ends a window.
    """
    return hits.select("fingerprint", "ts").groupBy("fingerprint").transformWithStateInPandas(_Windows(pd.Timedelta(window), forget), "fingerprint string, first_ts timestamp, added long, last_ts timestamp, is_new boolean", "Append", "ProcessingTime")


class _Failures(StatefulProcessor):
    """Times of an asset's and user's failures, and how many each time had."""

    def __init__(self, width: int, threshold: int, forget: timedelta | None):
        self.width, self.threshold, self.forget = width, threshold, forget and round(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failed = handle.getMapState("failed", "t bigint", "n bigint", self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tries = pd.concat(list(rows))
        for t, n in tries.loc[tries["status_id"] == 2, "t"].value_counts().items():
            before = self.failed.getValue((int(t),)) if self.failed.containsKey((int(t),)) else None
            self.failed.updateValue((int(t),), (int(n) + (before[0] if before else 0),))
        logins = tries[tries["status_id"] == 1]
        if logins.empty:
            return
        counts = pd.Series({k[0]: v[0] for k, v in self.failed.iterator()}, dtype="int64").sort_index()
        total = np.concatenate([[0], counts.to_numpy().cumsum()])
        times, at = counts.index.to_numpy(dtype="int64"), logins["t"].to_numpy()
        found = total[np.searchsorted(times, at, "right")] - total[np.searchsorted(times, at - self.width, "left")]
        hits = logins.assign(failures=found)[found >= self.threshold]
        yield hits.assign(asset_id=key[0], username=key[1])[["id", "asset_id", "username", "t", "failures"]]

    def close(self) -> None:
        pass


def stream_brute_force(auth: DataFrame, window: timedelta = timedelta(minutes=10), threshold: int = 5, forget: timedelta | None = timedelta(days=1)) -> DataFrame:
    """auth (id, ts, asset_id, username, status_id) to the hits of `windows.brute_force_success`: id, asset_id, username, ts, failures, rule_id, severity.

    One state an asset and user: a row for each time at which it failed, kept for `forget` of the clock on the wall, so
    that no other one's time ends it (None: kept; such a query ends by itself where its source does). A login is counted against
    the failures of its own micro-batch and of those before; a failure that comes later makes no hit of it. Rows without a
    time or a user are left out, a null asset is one asset. Needs RocksDB as the state store, like `stateful_dedup`.
    """
    tries = auth.where(F.col("status_id").isin(1, 2) & F.col("username").isNotNull() & F.col("ts").isNotNull())
    rows = tries.select(F.col("id").cast("string").alias("id"), "asset_id", "username", F.unix_micros("ts").alias("t"), "status_id")
    kinds = dict(rows.dtypes)
    processor = _Failures(round(window.total_seconds() * 1e6), threshold, forget)
    hits = rows.groupBy("asset_id", "username").transformWithStateInPandas(processor, f"id string, asset_id {kinds['asset_id']}, username string, t long, failures long", "Append", "ProcessingTime" if forget else "None")
    return hits.select("id", "asset_id", "username", F.timestamp_micros("t").alias("ts"), "failures", F.lit("bruteforce:success").alias("rule_id"), F.lit(5).alias("severity"))


class _Programs(StatefulProcessor):
    """An asset's programs, with when each was first seen, and when the first of all was."""

    def __init__(self, learning: int):
        self.learning = learning

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "exe_path string", "first_seen bigint")
        self.start = handle.getValueState("start", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = pd.concat([r.sort_values(["t", "id"]).drop_duplicates("exe_path") for r in rows])
        first = first.sort_values(["t", "id"]).drop_duplicates("exe_path")
        new = first[[not self.known.containsKey((p,)) for p in first["exe_path"]]]
        if new.empty:
            return
        for path, t in zip(new["exe_path"], new["t"], strict=True):
            self.known.updateValue((path,), (int(t),))
        start = min([int(new["t"].min()), *(self.start.get() if self.start.exists() else ())])
        self.start.update((start,))
        yield new[new["t"] - start >= self.learning].assign(asset_id=key[0])[["id", "asset_id", "exe_path", "t"]]

    def close(self) -> None:
        pass


def stream_first_seen(events: DataFrame, learning: timedelta = timedelta(days=7)) -> DataFrame:
    """events (id, ts, asset_id, exe_path) to the hits of `windows.first_seen`: event_id, asset_id, exe_path, ts, rule_id, severity.

    One state an asset: a row a program, as a baseline is never forgotten, and the start of its learning. A program is looked
    up by its path; the others are not read. An event that comes late may move the start back for the programs after it, but calls
    back no hit. Rows without a time, an asset or a program are left out. Ids are ordered as text where times are equal.
    """
    rows = events.where(F.col("exe_path").isNotNull() & F.col("asset_id").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select(F.col("id").cast("string").alias("id"), "asset_id", "exe_path", F.unix_micros("ts").alias("t"))
    found = rows.groupBy("asset_id").transformWithStateInPandas(_Programs(round(learning.total_seconds() * 1e6)), f"id string, asset_id {dict(rows.dtypes)['asset_id']}, exe_path string, t long", "Append", "None")
    return found.select(F.col("id").alias("event_id"), "asset_id", "exe_path", F.timestamp_micros("t").alias("ts"), F.lit("ueba:first_seen").alias("rule_id"), F.lit(2).alias("severity"))


def alert_deltas(hits: DataFrame, opened: DataFrame | None, window: timedelta, anchor_late: bool = True) -> DataFrame:
    """hits (fingerprint, rule_id, asset_id, source, id, ts, severity) to deltas: fingerprint, first_ts, rule_id, asset_id, source, severity, added, last_ts, event_id, is_new, late.

    opened: (fingerprint, first_ts) of the windows that hits are held against. Hits from its first time on join a window or open the
    next. A hit before then comes late. It opens a window that takes the place of the open one, as hits are taken in order of time, and the hits after it
    are held against that; with anchor_late=False late hits form windows of their own, and the open one stays.
    """
    rows = hits.select("fingerprint", "rule_id", "asset_id", "source", "id", "ts", "severity", F.lit(1).alias("weight"))
    if opened is None:
        rows = rows.withColumn("late", F.lit(False))
    else:
        earliest = rows.groupBy("fingerprint").agg(F.min("ts").alias("_least"))
        own = opened.join(earliest, "fingerprint").where((F.col("_least") >= F.col("first_ts")) | F.lit(not anchor_late))
        own = own.select("fingerprint", F.col("first_ts").alias("ts"), F.lit(0).alias("weight"), F.lit(False).alias("late"))
        late = F.lit(False) if anchor_late else F.coalesce(F.col("ts") < F.col("_first"), F.lit(False))
        rows = rows.join(opened.select("fingerprint", F.col("first_ts").alias("_first")), "fingerprint", "left").withColumn("late", late).drop("_first").unionByName(own, allowMissingColumns=True)
    placed = windows.dedup_window(rows, ["fingerprint", "late"], "ts", window)
    real = F.col("weight") == 1
    first = F.min(F.when(real, F.struct("ts", "id", "rule_id", "asset_id", "source"))).alias("_f")
    out = placed.groupBy("fingerprint", "late", "first_ts").agg(F.sum("weight").alias("added"), F.max(F.when(real, F.col("ts"))).alias("last_ts"), F.max("severity").alias("severity"), first, (F.min("weight") == 1).alias("is_new"))
    return out.where("added > 0").select("fingerprint", "first_ts", "_f.rule_id", "_f.asset_id", "_f.source", "severity", "added", "last_ts", F.col("_f.id").alias("event_id"), "is_new", "late")


def brute_force_of(fresh: DataFrame, stored_events: DataFrame | None, keep: tuple[str, ...], window: timedelta = timedelta(minutes=10)) -> DataFrame:
    """Hits among the fresh authentication events; failures of earlier batches within the window count."""
    auth = lambda df: df.where(F.col("class_uid") == 3002).withColumn("status_id", F.try_variant_get(F.try_parse_json("raw"), "$.status_id", "int"))
    cols = list(dict.fromkeys(("id", "ts", "class_uid", "asset_id", "username", "status_id", *keep)))
    rows = auth(fresh).select(*cols, F.lit(True).alias("_fresh"))
    if stored_events is not None:
        past = auth(stored_events)
        rows = rows.unionByName(past.select(*[c for c in cols if c in past.columns], F.lit(False).alias("_fresh")), allowMissingColumns=True)
    return windows.brute_force_success(rows, window).where("_fresh").select("id", "ts", "class_uid", *keep, "rule_id", "severity")


def detection_batch(spark: SparkSession, rules: Callable[[], RuleSet], intel: Callable[[], DataFrame] | None, suppressions: Callable[[], DataFrame] | None, out: str, window: timedelta = timedelta(minutes=5), forget: int = 50_000, anchor_late: bool = True, failures_within: timedelta = timedelta(minutes=10)) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: events in; events, hits, alerts, counters and metrics out. The callables are asked anew at each batch, so rules and tables refresh while running.

    Every write is keyed by the batch (see `sinks`), so a batch may fail at any place and come again. A batch reads the
    stored ids of its own dates, the authentication events that failures are counted over and the window of each fingerprint;
    none of these grows with history. A window is forgotten when its fingerprint has had no hit in `forget` batches (a day, of two seconds each): the times
    of other events, which may be wrong, end no window. Alerts are read by `sinks.read_alerts`, counters by `sinks.read_counters`.
    """
    keep = ("asset_id", "partition_key", "fingerprint_suffix", "username", "source")

    def run(batch: DataFrame, number: int) -> None:
        work = sinks.Workspace(spark)
        try:
            batch = work.stored(batch, "batch")
            fresh = work.stored(sinks.unseen(batch, f"{out}/events", number), "fresh")
            hits = detect.match_rules(fresh, rules(), None, keep, os="asset_os" if "asset_os" in fresh.columns else None)
            if intel is not None:
                hits = detect.union_detections(hits, detect.match_intel(fresh, intel(), keep=keep))
            past, span = None, fresh.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).head()
            if span["lo"] is not None and sinks.exists(spark, f"{out}/events"):
                since = F.lit(span["lo"]) - F.make_dt_interval(secs=F.lit(failures_within.total_seconds()))
                past = spark.read.parquet(f"{out}/events").where((F.col("date") >= F.to_date(since)) & (F.col("ts") >= since) & (F.col("ts") <= F.lit(span["hi"])) & (F.col("batch") != number))
            hits = detect.union_detections(hits, brute_force_of(fresh, past, keep, failures_within))
            hits = work.stored(hits if "ioc_id" in hits.columns else hits.withColumn("ioc_id", F.lit(None).cast("string")), "hits")
            if intel is not None:
                sinks.write_counters(detect.match_counters(hits.where(F.col("ioc_id").isNotNull()), "ioc_id"), f"{out}/intel_counters", "ioc_id", number)
            if suppressions is not None:
                hits, quiet = detect.apply_suppressions(hits, suppressions())
                sinks.write_counters(detect.match_counters(quiet, "suppression_id"), f"{out}/suppressions", "suppression_id", number)
            key = F.concat(F.col("partition_key"), F.coalesce("fingerprint_suffix", F.lit("")))  # the suffix begins with a bar
            named = work.stored(hits.withColumn("fingerprint", fingerprint(F.col("rule_id"), key, F.lit(0), F.lit(""), F.col("username"))), "named")
            sinks.write_log(named, f"{out}/hits", number)
            opened = sinks.read_windows(spark, f"{out}/open", number, forget, named.select("fingerprint"))
            deltas = work.stored(alert_deltas(named, opened, window, anchor_late), "deltas")
            sinks.upsert_alerts(deltas, f"{out}/alerts", number)
            newest = deltas.where("not late").groupBy("fingerprint").agg(F.max("first_ts").alias("first_ts"))
            sinks.write_windows(newest, f"{out}/open", number, forget)
            sinks.write_log(batch_metrics(batch, fresh, deltas), f"{out}/metrics", number)
            sinks.write_events_idempotent(fresh, f"{out}/events", number)
        finally:
            work.clear()

    return run


def batch_metrics(batch: DataFrame, fresh: DataFrame, deltas: DataFrame) -> DataFrame:
    """(stage, source, rows) of a batch: published, processed, duplicate, alerts created."""
    count = lambda df, stage: df.groupBy("source").agg(F.count("*").alias("rows")).select(F.lit(stage).alias("stage"), "source", "rows")
    published, processed = count(batch, "published"), count(fresh, "processed")
    both = published.join(processed.select("source", F.col("rows").alias("_p")), "source", "left")
    duplicate = both.select(F.lit("duplicate").alias("stage"), "source", (F.col("rows") - F.coalesce("_p", F.lit(0))).alias("rows"))
    return published.unionByName(processed).unionByName(duplicate).unionByName(count(deltas.where("is_new"), "alerts"))


def quarantine_batch(out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over undecodable records (see `normalise.decode_envelopes`): they are kept with their reason, and counted by reason."""

    def run(bad: DataFrame, number: int) -> None:
        sinks.write_log(bad, f"{out}/quarantine", number)
        sinks.write_log(bad.groupBy("reason").agg(F.count("*").alias("rows")), f"{out}/failures", number)

    return run


def first_seen_batch(out: str, learning: timedelta = timedelta(days=7)) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: programs first seen, against the baseline of the batches before."""

    def run(batch: DataFrame, number: int) -> None:
        known = sinks.read_baselines(batch.sparkSession, f"{out}/baseline", number, batch.select("asset_id"))
        new, hits = windows.first_seen(batch, learning, known)
        sinks.write_log(hits, f"{out}/first_seen", number)
        sinks.write_baselines(new, f"{out}/baseline", number)

    return run


def correlation_batch(spark: SparkSession, events: Callable[[], DataFrame], assets: Callable[[], DataFrame], out: str, window: timedelta = timedelta(minutes=30)) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over new alerts (id, ts, asset_id, process_guid, rule_id): each joins an incident of the batches before or of its own, or begins one.

    Writes `assigned` (the batch's alerts with incident_id, parent_alert_id, reason) and `incidents` (id, status,
    updated_at): a triaged incident that gains an alert is open again, a closed one gains none.
    """

    def run(batch: DataFrame, number: int) -> None:
        work = sinks.Workspace(spark)
        try:
            new = work.stored(batch.dropDuplicates(["id"]), "alerts")
            past = sinks.read_log(spark, f"{out}/assigned", number)
            incidents = sinks.read_incidents(spark, f"{out}/incidents", number)
            kind = dict(new.dtypes)["id"]
            every = new.withColumn("incident_id", F.lit(None).cast(kind))
            if past is not None:
                new = new.join(past.select("id"), "id", "left_anti")
                every = past.select(*every.columns).unionByName(new.withColumn("incident_id", F.lit(None).cast(kind)))
            known = incidents if incidents is not None else spark.createDataFrame([], f"id {kind}, status string, updated_at timestamp")
            assigned = correlate.assign_incidents(work.stored(every, "alerts"), events(), assets(), window, existing=known)
            own = work.stored(assigned.join(new.select("id"), "id", "left_semi"), "assigned")
            sinks.write_log(own, f"{out}/assigned", number)
            touched = own.groupBy(F.col("incident_id").alias("id")).agg(F.max("ts").alias("updated_at"))
            status = correlate.reopened(known.select("id", "status"), own).withColumnRenamed("status", "_status")
            changed = touched.join(status, "id", "left").select("id", F.coalesce("_status", F.lit("open")).alias("status"), "updated_at")
            sinks.write_incidents(changed, f"{out}/incidents", number)
        finally:
            work.clear()

    return run


def flow_batch(out: str, idle: timedelta = timedelta(seconds=30), lifetime: timedelta = timedelta(seconds=300), grace: timedelta = timedelta(seconds=5), most_open: int = 1 << 20) -> Callable[..., None]:
    """For foreachBatch over packets: flows that are over go to `flows`, the packets of open ones are carried to the next batch.

    A flow is over when no later packet can join it: its idle time or lifetime has passed, or its grace after a FIN or
    RST, by the newest packet seen. Of more than `most_open` open flows the ones seen last are given up, as a full
    table takes no new flow; their packets are counted in `dropped`. `run(batch, number, drain=True)` lets all flows end.
    """
    ends = ["proto", "a", "a_port", "b", "b_port"]

    def run(batch: DataFrame, number: int, drain: bool = False) -> None:
        spark = batch.sparkSession
        work = sinks.Workspace(spark)
        try:
            carried = sinks.current(spark, f"{out}/open", number)
            packets = work.stored(batch if carried is None else carried.select(*batch.columns).unionByName(batch), "packets")
            made = work.stored(flows.assemble_flows(packets, idle, lifetime, grace), "flows")
            now = F.lit(packets.agg(F.max("ts")).head()[0]).cast("timestamp")
            passed = lambda since, width: F.unix_micros(now) - F.unix_micros(since) >= round(width.total_seconds() * 1e6)
            over = F.lit(drain) | passed(F.col("last_ts"), idle) | passed(F.col("first_ts"), lifetime) | F.coalesce(passed(F.col("fin_ts"), grace), F.lit(False))
            judged = work.stored(made.withColumn("_over", over), "judged")
            sinks.write_log(flows.orient_flow(judged.where("_over")), f"{out}/flows", number)
            still = judged.where("not _over").orderBy("first_ts", *ends).limit(most_open).select(*ends, "first_ts")
            k = flow_key(F.col("src_ip"), F.col("sport"), F.col("dst_ip"), F.col("dport"))
            keyed = packets.select("*", F.inline(F.array(k))).drop("forward")
            mine = keyed.join(still, ends).where(F.col("ts") >= F.col("first_ts")).select(*packets.columns)
            mine.write.mode("overwrite").parquet(f"{out}/open/version={number}")
            lost = judged.where("not _over").join(still, [*ends, "first_ts"], "left_anti").agg(F.count("*").alias("flows"), F.coalesce(F.sum(F.col("a_packets") + F.col("b_packets")), F.lit(0)).alias("packets"))
            sinks.write_log(lost, f"{out}/dropped", number)
        finally:
            work.clear()

    return run


def start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def in_runs(parts: Iterable[DataFrame], folder: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `made` gives for a stream that is run once for each part, its state kept from run to run: a part is written to the folder, and the query
    goes on where it stopped. The state store is RocksDB, for these queries only. `made` must have a state without a time of its own, so that a run ends with its input."""
    provider, out = "spark.sql.streaming.stateStore.providerClass", None
    for part in parts:
        spark = part.sparkSession
        part.write.mode("append").parquet(f"{folder}/in")
        made_of = made(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        before = spark.conf.get(provider)
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            query = made_of.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        finally:
            spark.conf.set(provider, before)
        query.awaitTermination()
        out = spark.read.schema(made_of.schema).parquet(f"{folder}/out")
    if out is None:
        raise ValueError("no part")
    return out


class Metrics(StreamingQueryListener):
    """Rows, latency and backlog of each micro-batch."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows.append({"batch": p.batchId, "rows": p.numInputRows, "ms": dict(p.durationMs), "backlog": sum(int((s.metrics or {}).get("offsetsBehindLatest", 0) or 0) for s in p.sources)})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def alarms(self, most_backlog: int = 10_000, most_ms: int = 1000) -> list[str]:
        """Which thresholds the last batches are beyond."""
        last = self.rows[-20:]
        slow = sorted(r["ms"].get("triggerExecution", 0) for r in last)
        out = ["backlog"] if last and last[-1]["backlog"] > most_backlog else []
        return out + (["latency"] if slow and slow[int(0.95 * (len(slow) - 1))] > most_ms else [])
