from __future__ import annotations

import json
import shutil
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracehold.functions.rules import compile_rule
from tracehold.operators import detect, flows, sinks, windows
from tracehold.schemas import ENVELOPE
from tracehold.sources import readers
from tracehold.streaming import pipeline

T0 = datetime(2024, 1, 1)
RULE = {"id": "r", "logsource": {"category": "process_creation"}, "detection": {"s": {"Image": "/bin/sh"}, "condition": "s"}}


def envelope(k, minutes, path="/bin/sh"):
    return json.dumps({"version": 1, "id": f"e{k}", "partition_key": "A", "timestamp": (T0 + timedelta(minutes=minutes)).isoformat() + "Z", "class_uid": 1007, "source": "agent", "asset_id": "A", "raw": json.dumps({"process": {"file": {"path": path}}})})


def test_detection_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    lines = [envelope(k, m) for k, m in enumerate((0, 1, 4, 5, 11, 12))] + [envelope(90, 3, "/bin/ls")]
    rules = detect.rule_set(spark, [("r", RULE)])
    batch = pipeline.detection_batch(spark, lambda: rules, None, None, out)
    for n, part in enumerate((lines[:3], lines[2:])):  # one line comes twice
        (src / f"{n}.json").write_text("\n".join(part))
        stream = readers.stream_envelopes(spark, str(src), maxFilesPerTrigger="1")
        q = pipeline.start(stream, batch, f"{tmp_path}/checkpoint", once=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.read.parquet(f"{out}/events").count() == 7
    got = sorted((r.first_ts, r["count"]) for r in sinks.read_alerts(spark, f"{out}/alerts").collect())
    assert got == [(T0, 3), (T0 + timedelta(minutes=5), 1), (T0 + timedelta(minutes=11), 2)]
    events = spark.read.schema(ENVELOPE).json(str(src)).withColumnRenamed("timestamp", "ts").dropDuplicates(["id"])
    hits = detect.match_rules(events, [compile_rule(RULE)], None, ("partition_key",))
    whole = windows.alert_rollup(hits, ["rule_id", "partition_key"], "ts", timedelta(minutes=5))
    assert sorted((r.first_ts, r["count"]) for r in whole.collect()) == got


def test_first_seen_stream(spark, tmp_path):
    run = pipeline.first_seen_batch(f"file://{tmp_path}/out")
    df = lambda rows: spark.createDataFrame(rows, "id string, ts timestamp, asset_id string, exe_path string")
    run(df([("1", T0, "A", "x")]), 0)
    run(df([("2", T0 + timedelta(days=8), "A", "y"), ("3", T0 + timedelta(days=8), "A", "x")]), 1)
    assert [r.event_id for r in spark.read.parquet(f"file://{tmp_path}/out/first_seen").collect()] == ["2"]


def test_stateful_dedup(spark, tmp_path):
    """In two micro-batches: a late hit takes the window's place, and an event dated years ahead ends no other one's window."""
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    parts = [[("f", at(0)), ("f", at(5)), ("f", at(10)), ("f", at(12)), ("g", T0), ("k", at(60))], [("h", T0 + timedelta(days=1000))], [("g", at(2)), ("g", at(9)), ("f", at(21)), ("k", at(50)), ("k", at(59)), ("k", at(61))]]
    src = tmp_path / "hits"
    src.mkdir()
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, rows in enumerate(parts):
            spark.createDataFrame(rows, "fingerprint string, ts timestamp").coalesce(1).write.mode("append").parquet(str(src / "p"))
            stream = spark.readStream.schema("fingerprint string, ts timestamp").parquet(str(src / "p"))
            deltas = pipeline.stateful_dedup(stream, timedelta(minutes=10))
            q = deltas.writeStream.format("parquet").option("path", f"{tmp_path}/deltas").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "cp")).start()
            end = time.time() + 90  # a query by the clock on the wall does not end by itself
            while sum(p["numInputRows"] for p in q.recentProgress) < len(rows) and time.time() < end and q.isActive:
                time.sleep(0.5)
            q.stop()
            assert q.exception() is None
    finally:
        spark.conf.unset(provider)
    got = spark.read.parquet(f"{tmp_path}/deltas").groupBy("fingerprint", "first_ts").agg(F.sum("added").alias("n")).collect()
    assert sorted((r.fingerprint, r.first_ts, r.n) for r in got) == [("f", at(0), 2), ("f", at(10), 2), ("f", at(21), 1), ("g", T0, 3), ("h", T0 + timedelta(days=1000), 1), ("k", at(50), 2), ("k", at(60), 1), ("k", at(61), 1)]


def test_late_hits_and_wrong_clocks(spark, tmp_path):
    """The same rule in the batches of the detection loop; late hits may also be given windows of their own."""
    rules = detect.rule_set(spark, [("r", RULE)])
    parts = [[envelope(1, 60)], [envelope(2, 60 * 24 * 1000)], [envelope(3, 62), envelope(4, 63)], [envelope(5, 50)], [envelope(6, 53), envelope(7, 64)]]
    for anchor, want in ((True, [(50, 2), (60, 3), (64, 1)]), (False, [(50, 1), (53, 1), (60, 4)])):
        out = f"file://{tmp_path}/{anchor}"
        run = pipeline.detection_batch(spark, lambda: rules, None, None, out, window=timedelta(minutes=5), anchor_late=anchor)
        for number, lines in enumerate(parts):
            lines = [x.replace('"A"', '"B"') if '"e2"' in x else x for x in lines]
            df = spark.read.schema(ENVELOPE).json(spark.sparkContext.parallelize(lines)).withColumnRenamed("timestamp", "ts")
            run(df, number)
        got = sorted(((r.first_ts - T0).total_seconds() / 60, r["count"]) for r in sinks.read_alerts(spark, f"{out}/alerts").where("asset_id = 'A'").collect())
        assert got == want


def test_sinks_may_be_replayed(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    df = spark.createDataFrame([("1", T0, 1007), ("2", T0, 4001), ("1", T0, 1007)], "id string, ts timestamp, class_uid int")
    for _ in range(2):
        sinks.write_events_idempotent(df, path)
    assert spark.read.parquet(path).count() == 2
    counters = spark.createDataFrame([("a", 2, T0)], "k string, hits long, last timestamp")
    at = f"file://{tmp_path}/counters"
    for number in (0, 0, 1, 1, 2):
        sinks.write_counters(counters, at, "k", number)
    assert sinks.read_counters(spark, at, "k").head().hits == 6 and sinks.segments(spark, at)[0] == [(0, 0), (1, 1), (2, 2)]
    inventory = readers.hash_inventory(spark, str(tmp_path / "counters"))
    assert inventory.count() >= 1 and inventory.where(F.length("sha256") != 64).count() == 0


def test_state_is_merged_as_it_grows(spark, tmp_path):
    """Twenty-one batches, each of which comes twice, and a compaction that stops half-way: totals hold before every batch, and segments stay few."""
    at, totals, most, sizes = f"file://{tmp_path}/counters", {}, 0, []
    for number in range(21):
        own = {f"k{number % 5}": number + 1, "all": 1}
        df = spark.createDataFrame([(k, n, T0 + timedelta(minutes=number)) for k, n in own.items()], "k string, hits long, last timestamp").coalesce(1)
        for _ in range(2):
            before = sinks.read_counters(spark, at, "k", number)
            assert ({r.k: r.hits for r in before.collect()} if before is not None else {}) == totals
            sinks.write_counters(df, at, "k", number)
        totals = {k: totals.get(k, 0) + own.get(k, 0) for k in totals | own}
        kept, replaced = sinks.segments(spark, at)
        assert [low for low, _ in kept] == [0, *(high + 1 for _, high in kept[:-1])] and kept[-1][1] == number
        most = max(most, len(kept) + len(replaced))
        sizes.append(len(list((tmp_path / "counters" / f"segment={number}-{number}").glob("*.parquet"))))
        if any(low != high for low, high in kept) and not replaced and number < 20:  # as a writer leaves it that fails before its mark of success
            wide = next(x for x in kept if x[0] != x[1])
            broken = tmp_path / "counters" / f"segment={wide[0]}-{number}"
            shutil.copytree(tmp_path / "counters" / f"segment={wide[0]}-{wide[1]}", broken)
            (broken / "_SUCCESS").unlink()
            assert sinks.segments(spark, at)[0] == kept
    assert {r.k: (r.hits, r.last) for r in sinks.read_counters(spark, at, "k").where("k = 'all'").collect()} == {"all": (21, T0 + timedelta(minutes=20))}
    assert most <= 11 and {r.k: r.hits for r in sinks.read_counters(spark, at, "k").collect()} == totals
    only = spark.createDataFrame([("k1",), ("k1",), ("none",)], "k string")
    assert sinks.state(spark, at, sinks._counters("k"), only=only).count() == 1


def test_keyed_state_equals_the_whole_table(spark, tmp_path):
    """Failures and programs in a state store over three runs of the stream: hits are those of the batch operators; a late failure makes no hit, a null asset is one asset."""
    at = lambda m: T0 + timedelta(minutes=m)
    schema = "id string, ts timestamp, asset_id string, username string, status_id int, exe_path string"
    tries = [(f"f{a}{m}", at(m), a, "u", 2, None) for a in ("A", None) for m in (0, 1, 2, 2.5, 9, 9)] + [("s1", at(9), "A", "u", 1, None), ("s2", at(11), "A", "u", 1, None), ("s3", at(11.1), "A", "u", 1, None), ("s4", at(10), None, "u", 1, None), ("s5", at(9), "A", "v", 1, None), ("s6", at(9), "A", None, 1, None), ("s7", None, "A", "u", 1, None)]
    day = 60 * 24
    programs = [("p1", at(0), "A", None, None, "x"), ("p2", at(8 * day), "A", None, None, "y"), ("p0", at(8 * day), "A", None, None, "y"), ("p3", at(9 * day), "A", None, None, "x"), ("p4", at(8 * day), "B", None, None, "x"), ("p5", at(14.9 * day), "B", None, None, "z"), ("p6", at(16 * day), "B", None, None, "w"), ("p7", at(16 * day), None, None, None, "w"), ("p8", at(17 * day), "B", None, None, "w")]
    rows = sorted(tries + programs, key=lambda r: (r[1] is None, r[1] or T0))
    cuts = [[r for r in rows if r[1] is None or r[1] < at(3)], [r for r in rows if r[1] and at(3) <= r[1] < at(8 * day + 1)], [r for r in rows if r[1] and r[1] >= at(8 * day + 1)], [("late", at(8), "A", "v", 2, None)]]
    frames = [spark.createDataFrame(c, schema) for c in cuts]
    streamed = pipeline.in_runs(frames, str(tmp_path / "auth"), lambda s: pipeline.stream_brute_force(s, threshold=5, forget=None))
    every = spark.createDataFrame(rows, schema)
    want = sorted((r.id, r.failures) for r in windows.brute_force_success(every.where("ts is not null")).collect())
    assert sorted((r.id, r.failures) for r in streamed.collect()) == want and [w[0] for w in want] == ["s1", "s2", "s4"]
    seen = pipeline.in_runs(frames, str(tmp_path / "programs"), pipeline.stream_first_seen)
    assert sorted(r.event_id for r in seen.collect()) == sorted(r.event_id for r in windows.first_seen(every)[1].collect()) == ["p0", "p6"]
    assert pipeline.in_runs([every.limit(0)], str(tmp_path / "none"), pipeline.stream_first_seen).count() == 0


def auth(k, minutes, status):
    return json.dumps({"version": 1, "id": f"a{k}", "partition_key": "A", "timestamp": (T0 + timedelta(minutes=minutes)).isoformat() + "Z", "class_uid": 3002, "source": "agent", "asset_id": "A", "username": "u", "raw": json.dumps({"status_id": status})})


def outputs(spark, out):
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    return {
        "events": rows(spark.read.parquet(f"{out}/events").select("id")),
        "hits": rows(spark.read.parquet(f"{out}/hits").select("id", "rule_id", "fingerprint")),
        "alerts": rows(sinks.read_alerts(spark, f"{out}/alerts")),
        "quiet": rows(sinks.read_counters(spark, f"{out}/suppressions", "suppression_id")),
        "intel": rows(sinks.read_counters(spark, f"{out}/intel_counters", "ioc_id")),
        "metrics": rows(spark.read.parquet(f"{out}/metrics")),
        "open": rows(sinks.read_windows(spark, f"{out}/open", 2, 50_000)),
    }


def test_a_batch_that_fails_at_any_write_and_comes_again(spark, tmp_path, monkeypatch):
    rules = detect.rule_set(spark, [("r", RULE), ("q", {**RULE, "id": "q"})])
    quiet = spark.createDataFrame([("s", T0, "q", None, None)], "id string, created_at timestamp, rule_id string, asset_id string, expires_at timestamp")
    intel = spark.createDataFrame([("i", "hash", "abc", 4, None)], "id string, kind string, value string, severity int, expires_at timestamp")
    batches = [[envelope(0, 0), envelope(1, 1), *(auth(k, k, 2) for k in range(3))], [envelope(1, 1), envelope(2, 2), envelope(3, 6, "/bin/ls"), *(auth(k, k, 2) for k in range(3, 5)), auth(9, 6, 1)]]
    frames = [spark.read.schema(ENVELOPE).json(spark.sparkContext.parallelize([x.replace('\\"path', '\\"md5\\": \\"ABC\\", \\"path') for x in lines])).withColumnRenamed("timestamp", "ts") for lines in batches]
    names = ("write_log", "advance", "upsert_alerts", "write_events_idempotent")

    def play(out, fail_at):
        """The second batch after the first, which is copied; fails after its write number fail_at and comes again."""
        calls = {"n": 0}

        def guarded(inner):
            def f(*args, **more):
                inner(*args, **more)  # what was written stays written
                calls["n"] += 1
                if calls["n"] == fail_at:
                    raise RuntimeError("lost")

            return f

        shutil.copytree(tmp_path / "first", out)
        run = pipeline.detection_batch(spark, lambda: rules, lambda: intel, lambda: quiet, f"file://{out}")
        with monkeypatch.context() as m:
            for name in names:
                m.setattr(sinks, name, guarded(getattr(sinks, name)))
            try:
                run(frames[1], 1)
            except RuntimeError:
                run(frames[1], 1)
        return calls["n"]

    pipeline.detection_batch(spark, lambda: rules, lambda: intel, lambda: quiet, f"file://{tmp_path}/first")(frames[0], 0)
    total = play(tmp_path / "clean", 0)
    want = outputs(spark, f"file://{tmp_path}/clean")
    assert len(want["events"]) == 10 and want["quiet"][0][:2] == ("s", "3") and want["intel"][0][:2] == ("i", "4")
    assert sum(r[1] == "bruteforce:success" for r in want["hits"]) == 1
    for k in range(1, total + 1):
        play(tmp_path / f"fail{k}", k)
        assert outputs(spark, f"file://{tmp_path}/fail{k}") == want, k


def test_late_hits_form_windows_of_their_own(spark):
    hits = lambda *minutes: spark.createDataFrame([("f", "r", "A", "s", f"h{m}", T0 + timedelta(minutes=m), 3) for m in minutes], "fingerprint string, rule_id string, asset_id string, source string, id string, ts timestamp, severity int")
    opened = spark.createDataFrame([("f", T0 + timedelta(minutes=10)), ("g", T0)], "fingerprint string, first_ts timestamp")
    got = sorted((r.first_ts, r.added, r.is_new, r.late) for r in pipeline.alert_deltas(hits(8, 11, 14, 15), opened, timedelta(minutes=5), anchor_late=False).collect())
    at = lambda m: T0 + timedelta(minutes=m)
    assert got == [(at(8), 1, True, True), (at(10), 2, False, False), (at(15), 1, True, False)]
    anchored = pipeline.alert_deltas(hits(8, 11, 14, 15), opened, timedelta(minutes=5)).collect()
    assert sorted((r.first_ts, r.added, r.is_new) for r in anchored) == [(at(8), 2, True), (at(14), 2, True)]


def test_correlation_batches(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    events = spark.createDataFrame([], "event_id string, ts timestamp, asset_id string, process_guid string, parent_process_guid string, conn_tuple string")
    assets = spark.createDataFrame([("A", ["10.0.0.1"])], "asset_id string, ip_addrs array<string>")
    run = pipeline.correlation_batch(spark, lambda: events, lambda: assets, out)
    alerts = lambda *rows: spark.createDataFrame([(i, T0 + timedelta(minutes=m), "A", None, "r") for i, m in rows], "id string, ts timestamp, asset_id string, process_guid string, rule_id string")
    run(alerts(("a", 0), ("b", 5)), 0)
    state = lambda status, at: spark.createDataFrame([("a", status, T0 + at)], "id string, status string, updated_at timestamp")
    sinks.write_incidents(state("triaged", timedelta(minutes=6)), f"{out}/incidents", 1)
    for _ in range(2):
        run(alerts(("b", 5), ("c", 20), ("d", 90)), 2)
    got = {r.id: (r.incident_id, r.batch) for r in spark.read.parquet(f"{out}/assigned").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 0), "c": ("a", 2), "d": ("d", 2)}
    assert {r.id: r.status for r in sinks.read_incidents(spark, f"{out}/incidents").collect()} == {"a": "open", "d": "open"}
    sinks.write_incidents(state("closed", timedelta(hours=2)), f"{out}/incidents", 3)
    run(alerts(("e", 25)), 4)
    assert {r.id: r.incident_id for r in spark.read.parquet(f"{out}/assigned").collect()}["e"] == "e"


def test_flows_in_batches(spark, tmp_path):
    schema = "ts timestamp, src_ip string, sport int, dst_ip string, dport int, proto int, tcp_flags int, frame_len long"
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(at(0), "c", 1, "s", 80, 6, 2, 60), (at(1), "s", 80, "c", 1, 6, 18, 60), (at(20), "c", 1, "s", 80, 6, 16, 40), (at(22), "d", 2, "s", 80, 17, 0, 50), (at(45), "c", 1, "s", 80, 6, 1, 40), (at(60), "e", 3, "s", 80, 17, 0, 70), (at(61), "e", 3, "s", 80, 17, 0, 70)]
    df = lambda part: spark.createDataFrame(part, schema)
    key = lambda r: (r.src_ip, r.first_ts, r.src_packets, r.dst_packets)
    want = sorted(key(r) for r in flows.orient_flow(flows.assemble_flows(df(rows))).collect())
    out = f"file://{tmp_path}/flows"
    run = pipeline.flow_batch(out)
    run(df(rows[:3]), 0)
    run(df(rows[3:5]), 1)
    run(df(rows[3:5]), 1)
    assert spark.read.parquet(f"{out}/flows").count() == 0
    run(df(rows[5:]), 2)
    assert spark.read.parquet(f"{out}/flows").count() == 2
    run(df([]), 3, drain=True)
    assert sorted(key(r) for r in spark.read.parquet(f"{out}/flows").collect()) == want
    few = pipeline.flow_batch(f"file://{tmp_path}/few", most_open=1)
    few(df(rows[:4]), 0)
    assert tuple(spark.read.parquet(f"file://{tmp_path}/few/dropped").select("flows", "packets").head()) == (1, 1)
