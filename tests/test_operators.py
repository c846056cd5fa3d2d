from __future__ import annotations

import ipaddress
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracehold.functions import scalars as S
from tracehold.operators import correlate, detect, flows, normalise, views, windows
from tracehold.schemas import ENVELOPE, FLOW_RECORDS

T0 = datetime(2024, 1, 1)


def at(minutes=0, **more):
    return T0 + timedelta(minutes=minutes, **more)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()["x"]


def test_dedup_window_is_anchored(spark):
    df = spark.createDataFrame([(k, "f", at(m)) for k, m in enumerate((0, 5, 10, 19, 20, 21))], "id int, fp string, ts timestamp")
    got = [(r.id, r.window_no, r.first_ts) for r in windows.dedup_window(df, ["fp"], "ts", timedelta(minutes=10)).orderBy("id").collect()]
    assert [n for _, n, _ in got] == [1, 1, 2, 2, 3, 3] and got[3][2] == at(10)
    assert [r.id for r in windows.sample_first(df, ["fp"], "ts", timedelta(minutes=10)).orderBy("id").collect()] == [0, 2, 4]
    same = df.select("id", F.lit(None).cast("string").alias("fp"), "ts").unionByName(df)
    assert windows.dedup_window(same, ["fp"], "ts", timedelta(minutes=10)).count() == 12
    assert windows.dedup_window(df.limit(0), ["fp"], "ts", timedelta(minutes=10)).count() == 0


def test_gap_sessions_are_inclusive(spark):
    df = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(30)), (3, "a", at(61)), (4, None, at(0)), (5, None, at(1))], "id int, asset string, ts timestamp")
    got = {r.id: r.session_no for r in windows.gap_sessions(df, "asset", "ts", timedelta(minutes=30), "id").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1}


def test_brute_force(spark):
    def hits(fails, fail_user="u"):
        rows = [(k, at(k), "a", fail_user, 2) for k in range(fails)] + [(99, at(9), "a", "u", 1)]
        return windows.brute_force_success(spark.createDataFrame(rows, "id int, ts timestamp, asset_id string, username string, status_id int")).count()

    assert (hits(5), hits(2), hits(5, "other")) == (1, 0, 0)


def test_first_seen(spark):
    rows = [(1, at(0), "a", "x"), (2, at(1), "a", "y"), (3, at(days=8), "a", "z"), (4, at(days=9), "a", "z"), (5, at(days=8), "b", "x")]
    base, hits = windows.first_seen(spark.createDataFrame(rows, "id int, ts timestamp, asset_id string, exe_path string"))
    assert base.count() == 4 and [(r.event_id, r.severity) for r in hits.collect()] == [(3, 2)]
    known = spark.createDataFrame([("b", "old", at(0))], "asset_id string, exe_path string, first_seen timestamp")
    _, again = windows.first_seen(spark.createDataFrame(rows[4:], "id int, ts timestamp, asset_id string, exe_path string"), baseline=known)
    assert again.count() == 1


def test_process_instances(spark):
    rows = [("g1", "h", at(0), 10, 1), ("g2", "h", at(1), 20, 10), ("g3", "h", at(2), 10, 20), ("g4", "h", at(3), 30, 10), ("g5", "other", at(4), 40, 10)]
    got = {r.guid: r.parent_guid for r in windows.resolve_process_instance(spark.createDataFrame(rows, "guid string, host string, ts timestamp, pid int, ppid int")).collect()}
    assert got == {"g1": None, "g2": "g1", "g3": "g2", "g4": "g3", "g5": None}


def test_scalars(spark):
    kind = lambda v: tuple(one(spark, S.ioc_kind(F.lit(v))))
    assert kind("10.0.0.1") == ("ip", "10.0.0.1") and kind("FE80::1") == ("ip", "fe80::1") and kind("A" * 64) == ("hash", "a" * 64)
    assert kind("Evil.Example.") == ("domain", "evil.example") and kind("256.1.1.1") == ("domain", "256.1.1.1")
    assert one(spark, S.parent_domains(F.lit("a.b.Example."))) == ["a.b.example", "b.example", "example"]
    a, b = (one(spark, S.stable_id(*map(F.lit, x))) for x in (("a", "bc"), ("ab", "c")))
    assert a != b and a == one(spark, S.stable_id(F.lit("a"), F.lit("bc"))) and a[14] == "8" and a[19] in "89ab"
    assert one(spark, S.strip_nul(F.lit('{"a":"x\\u0000y"}'))) == '{"a":"xy"}' and one(spark, S.strip_nul(F.lit("{bad"))) == "{}"
    assert one(spark, S.parse_verdict(F.lit('so {"a": 1} end'))) == '{"a": 1}' and "unparseable" in one(spark, S.parse_verdict(F.lit("none")))
    assert one(spark, S.md_cell(F.lit("a|b\nc"))) == "`a\\|b c`" and one(spark, S.md_cell(F.lit(""))) == "-"
    key = lambda *x: tuple(one(spark, S.flow_key(*map(F.lit, x))))
    assert key("10.0.0.9", 5, "10.0.0.10", 80)[:4] == key("10.0.0.10", 80, "10.0.0.9", 5)[:4] == ("10.0.0.9", 5, "10.0.0.10", 80)
    head = one(spark, S.http_head(F.lit("GET /a?b HTTP/1.1\r\nHost: h.example\r\nuser-agent: curl\r\n\r\nHost: no")))
    assert tuple(head) == ("GET", "/a?b", "h.example", "curl") and one(spark, S.http_head(F.lit("nothing"))) is None
    ja3 = one(spark, S.ja3(F.lit(771), F.array(F.lit(0x0A0A), F.lit(4865)), F.array(F.lit(0)), F.array(F.lit(29)), F.array(F.lit(0))))
    assert ja3 == one(spark, F.md5(F.lit("771,4865,0,29,0")))
    items = one(spark, S.wmi_items(F.lit('[{"Name":"a","Q":1},{"Q":2}]')))
    assert [i["name"] for i in items] == ["a"] and len(one(spark, S.wmi_items(F.lit('{"Name":"b"}')))) == 1


def test_syslog(spark):
    now = F.lit(datetime(2024, 1, 2)).cast("timestamp")
    p = lambda line: one(spark, S.parse_syslog(F.lit(line), now))
    m = p('<34>1 2023-10-11T22:14:15.003Z host su 77 ID47 [x@1 a="b"] failed for root')
    assert (m.facility, m.severity, m.hostname, m.app, m.procid, m.msgid, m.content) == (4, 2, "host", "su", "77", "ID47", "failed for root")
    assert p("<34>1 2023-10-11T22:14:15Z host su - - - hello").content == "hello"
    m = p("<13>Oct  1 22:14:15 box sshd[9]: bad")
    assert (m.ts, m.hostname, m.app, m.procid, m.content) == (datetime(2023, 10, 1, 22, 14, 15), "box", "sshd", "9", "bad")
    assert p("<13>Oct  1 22:14:15 box no tag here").content == "no tag here"
    m = p("free text")
    assert (m.facility, m.severity, m.content, m.hostname) == (1, 6, "free text", None)


def test_intel_and_suppressions(spark):
    raw = '{"dst_endpoint":{"ip":"1.2.3.4","hostname":"a.Evil.example."},"tls":{"ja3_hash":"ABC","sni":"x"},"answers":[{"ip":"9.9.9.9"}],"note":"1.1.1.1"}'
    events = spark.createDataFrame([("e", T0, 4001, "A", raw)], "id string, ts timestamp, class_uid int, asset_id string, raw string")
    rows = [("1", "ip", "1.2.3.4", 4, None), ("2", "domain", "EVIL.example", 5, None), ("3", "hash", "abc", 3, None), ("4", "ip", "9.9.9.9", 2, at(-1)), ("5", "ip", "1.1.1.1", 1, None), ("6", "domain", "vil.example", 1, None)]
    intel = spark.createDataFrame(rows, "id string, kind string, value string, severity int, expires_at timestamp")
    hits = detect.match_intel(events, intel, keep=("asset_id",))
    assert sorted(r.ioc_id for r in hits.collect()) == ["1", "2", "3"]
    raw = r'{"ip":["[::1]","1.2.3.4",["FE80::1"]],"note":{"ip":"7.7.7.7","x":[{"hostname":"b.example"},"no"],"deep":{"y":1}},"hostname":["a.b."],"sha256":"","q":"\"ip\":"}'
    got = one(spark, detect.intel_candidates(F.lit(raw)))
    assert sorted(tuple(c) for c in got) == sorted([("ip", "[::1]"), ("ip", "1.2.3.4"), ("ip", "fe80::1"), ("ip", "7.7.7.7"), ("domain", "b.example"), ("domain", "example"), ("domain", "a.b"), ("domain", "b")])
    assert one(spark, detect.intel_candidates(F.lit('{"ip": "1.1.1.1"'))) == []
    supp = spark.createDataFrame([("s1", at(-9), "intel:ip:1.2.3.4", None, None), ("s2", at(-8), "intel:ip:1.2.3.4", "A", None), ("s3", T0, "intel:hash:abc", "B", None), ("s4", T0, "intel:domain:evil.example", None, at(-1))], "id string, created_at timestamp, rule_id string, asset_id string, expires_at timestamp")
    kept, quiet = detect.apply_suppressions(hits, supp)
    assert kept.count() == 2 and [r.suppression_id for r in quiet.collect()] == ["s1"]
    new, counts = detect.import_intel(spark.createDataFrame([("# c\n1.1.1.1\n\nBad.example.\nbad.example\n2.2.2.2",)], "text string"), spark.createDataFrame([("ip", "2.2.2.2")], "kind string, value string"))
    assert sorted(r.value for r in new.collect()) == ["1.1.1.1", "bad.example"] and tuple(counts.head()) == (2, 2)


ALERT = "id int, ts timestamp, asset_id string, process_guid string, rule_id string, conn_tuple string"
EVENT = "event_id int, ts timestamp, asset_id string, process_guid string, parent_process_guid string, conn_tuple string"
ASSET = "asset_id string, ip_addrs array<string>"


def incidents(spark, alerts, events=(), assets=(), **more):
    out = correlate.assign_incidents(spark.createDataFrame(list(alerts), ALERT), spark.createDataFrame(list(events), EVENT), spark.createDataFrame(list(assets), ASSET), timedelta(minutes=30), **more)
    return {r.id: (r.incident_id, r.reason) for r in out.collect()}, out


def test_correlation(spark):
    got, _ = incidents(spark, [(1, at(0), "A", None, "r", None), (2, at(1), "A", None, "r", None), (3, at(62), "A", None, "r", None), (4, at(0), "B", None, "r", None)])
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    tree = [(k, at(-200), "A", f"p{k}", f"p{k - 1}", None) for k in range(1, 5)]
    got, _ = incidents(spark, [(1, at(-120), "A", "p1", "r", None), (2, at(0), "A", "p4", "r", None)], tree)
    assert got[2] == (1, "lineage")
    conn = [(9, at(-5), "A", None, None, "tcp:10.0.0.1:4000>10.0.0.2:445")]
    got, out = incidents(spark, [(1, at(-10), "A", None, "r", None), (2, at(0), "B", None, "r", None)], conn, [("A", ["10.0.0.1"]), ("B", ["10.0.0.2"])])
    assert got[2] == (1, "lateral")
    nodes, edges, overflow = correlate.incident_graph(out)
    assert {r.rel for r in edges.collect()} == {"triggered", "lateral"} and nodes.count() == 4 and overflow.count() == 0
    _, _, over = correlate.incident_graph(out, max_nodes=2)
    assert [tuple(r) for r in over.collect()] == [(1, 1)]


def test_parents_of_hot_keys(spark):
    """Against plain Python: one asset with most alerts, one address with most connections, one ancestor of all, over weeks and on the edges of slices; and the hot address is many groups."""
    rng, half = random.Random(5), timedelta(minutes=30)
    when = lambda: at(30 * rng.choice([rng.randrange(40), rng.randrange(2000)]) + rng.choice([0, 0, 7, 29]))
    alerts = [(k, when(), rng.choice(["A", "A", "A", "B", "C", None]), rng.choice(["p1", "p2", "p3", None]), "r", None) for k in range(250)]
    tree = [(f"e{k}", at(0), "A", f"p{k}", "p0" if k < 3 else "p1", None) for k in (1, 2, 3)]
    ips = {"A": "10.0.0.1", "B": "10.0.0.2", "C": "10.0.0.3"}
    conns = [(f"c{k:03}", when(), rng.choice("ABC"), None, None, f"tcp:10.9.9.9:1>{ips[rng.choice('AAAB')]}:445") for k in range(300)]
    frame = spark.createDataFrame(alerts, ALERT)
    key = lambda a: (a[1], a[0])
    gap, lateral, lineage = {}, {}, {}
    above = {"p1": ["p0"], "p2": ["p0"], "p3": ["p1", "p0"]}
    for a in alerts:
        same = [b for b in alerts if b[2] == a[2] and key(b) < key(a)]
        if same and a[1] - max(same, key=key)[1] <= half:
            gap[a[0]] = max(same, key=key)[0]
        for p in above.get(a[3], []):
            if older := [b for b in alerts if b[3] == p and key(b) < key(a)]:
                lineage[a[0]] = max(older, key=key)[0]
                break
        met = sorted(((c[1], c[0], c[2]) for c in conns if a[2] and c[2] != a[2] and c[5].split(">")[1].startswith(ips[a[2]] + ":") and timedelta(0) <= a[1] - c[1] <= half), reverse=True)[:5]
        for _, _, other in met:
            if near := [b for b in alerts if b[2] == other and key(b) < key(a) and a[1] - b[1] <= half]:
                lateral[a[0]] = max(near, key=key)[0]
                break
    assert {r.id: r.gap_parent for r in correlate.gap_parent(frame, half).collect()} == gap and len(gap) > 50
    events = spark.createDataFrame([*tree, *conns], EVENT.replace("event_id int", "event_id string"))
    assets = spark.createDataFrame([(a, [ip]) for a, ip in ips.items()], ASSET)
    assert {r.id: r.lateral_parent for r in correlate.lateral_parent(frame, assets, events.where("conn_tuple is not null"), half).collect()} == lateral and len(lateral) > 10
    assert {r.id: r.lineage_parent for r in correlate.lineage_parent(frame, events).collect()} == lineage and len(lineage) > 20
    slices = frame.where("asset_id = 'A'").groupBy(correlate._bin("ts", half)).count()
    assert slices.count() > 40 and slices.agg(F.max("count")).head()[0] < 20


def test_flows(spark):
    rows = [(at(0), "c", 1000, "s", 80, 6, 2, 60), (at(0, seconds=1), "s", 80, "c", 1000, 6, 18, 60), (at(0, seconds=2), "c", 1000, "s", 80, 6, 1, 40), (at(0, seconds=4), "s", 80, "c", 1000, 6, 16, 40), (at(0, seconds=9), "c", 1000, "s", 80, 6, 2, 60), (at(2), "s", 80, "c", 1000, 6, 18, 60)]
    df = spark.createDataFrame(rows, "ts timestamp, src_ip string, sport int, dst_ip string, dport int, proto int, tcp_flags int, frame_len long")
    got = [(r.src_ip, r.src_packets, r.dst_packets, r.src_bytes) for r in flows.orient_flow(flows.assemble_flows(df)).orderBy("first_ts").collect()]
    assert got == [("c", 2, 2, 100), ("c", 1, 0, 60), ("c", 0, 1, 0)]
    late = df.where("tcp_flags = 2")
    assert flows.assemble_flows(late, idle=timedelta(hours=1), lifetime=timedelta(seconds=9)).count() == 2


def test_snapshots(spark):
    s = "host string, kind string, snap_ts timestamp, key string, value string"
    rows = [("h", "k", at(0), "keep", "1"), ("h", "k", at(0), "change", "a"), ("h", "k", at(0), "drop", "x"), ("h", "k", at(5), "keep", "1"), ("h", "k", at(5), "change", "b"), ("h", "k", at(5), "add", "n"), ("h", "other", at(0), "z", "1")]
    got = sorted((r.key, r.activity, r.value) for r in normalise.snapshot_changes(spark.createDataFrame(rows, s), ["host", "kind"], ["key"], "snap_ts", "value").collect())
    assert got == [("add", 1, "n"), ("change", 3, "b"), ("drop", 4, "x")]


def test_bodies_and_envelopes(spark):
    row = (1_000_000_000, 3_500_000_000, "10.0.0.1", "8.8.8.8", 5000, 53, 17, 1, 70, 1, 200, 0, "q.example", "", "", "", "", "", "NOERROR", ["1.1.1.1"], "", "", "", False, "", "")
    df = spark.createDataFrame([row, (*row[:12], "", "sni.example", *row[14:18], "", None, *row[20:])], FLOW_RECORDS)
    assets = spark.createDataFrame([("A", "h", "Linux", ["10.0.0.1"], "ag", T0, T0), ("B", "g", None, ["10.0.0.1"], None, T0, at(1))], "id string, hostname string, os string, ip_addrs array<string>, agent_id string, first_seen timestamp, last_seen timestamp")
    got = normalise.read_flows(df, assets).orderBy("class_uid").collect()
    assert [r.class_uid for r in got] == [4001, 4003] and got[0].asset_id == "B" and '"sni":"sni.example"' in got[0].raw and '"query"' not in got[0].raw
    assert '"duration_ms":2500' in got[1].raw and '"tls"' not in got[1].raw and '"answers":[{"ip":"1.1.1.1"}]' in got[1].raw
    agent = spark.createDataFrame([("ag", 10**18, 1001, "zz", "", "", '{"file":{"path":"/x"}}', None, 0)], "agent_id string, ts_unix_ns long, class_uid int, process_guid string, username string, conn_tuple string, raw_json string, parent_process_guid string, dropped_events long")
    e = normalise.agent_events(agent, assets).head()
    others = [agent.withColumn(c, F.lit(v)) for c, v in (("process_guid", "g1"), ("parent_process_guid", "g2"), ("conn_tuple", "tcp:a:1>b:2"))]
    assert len({e.id, *[normalise.agent_events(x, assets).head().id for x in others]}) == 4  # each tells two events apart
    assert (e.partition_key, e.process_guid, e.username, e.fingerprint_suffix, e.asset_os) == ("A", None, None, "|/x", "linux")
    good = '{"version":1,"id":"1","partition_key":"a","timestamp":"2024-01-01T00:00:00Z","class_uid":1,"source":"s","raw":"{}"}'
    values = [good, good.replace('"version":1', '"version":2'), "junk", good.replace('"raw":"{}"', '"raw":"{x"'), good.replace('"source":"s"', '"source":""')]
    ok, bad = normalise.decode_envelopes(spark.createDataFrame([(v,) for v in values], "value string"), "value", ENVELOPE)
    assert ok.count() == 1 and sorted(r.reason for r in bad.collect()) == ["not JSON", "raw", "source", "version"]
    xml = "<Event><System><EventID>{}</EventID><Execution ProcessID='7'/></System><EventData>{}</EventData></Event>"
    data = lambda **f: "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in f.items())
    rows = [("ag", T0, xml.format(4625, data(TargetUserName="bob", Status="0xC"))), ("ag", T0, xml.format(4624, data(TargetUserName="PC$"))), ("ag", T0, xml.format(4624, data(TargetUserName="eve", LogonType="5"))), ("ag", T0, xml.format(4104, data(ScriptBlockText="iex", MessageNumber=1, MessageTotal=2))), ("ag", T0, xml.format(4104, data(ScriptBlockText=" "))), ("ag", T0, xml.format(1, ""))]
    w = normalise.windows_events(spark.createDataFrame(rows, "agent_id string, ts timestamp, xml string"))
    assert sorted((r.event_id, r.username) for r in w.collect()) == [(4104, None), (4625, "bob")]


def test_views(spark):
    alerts = spark.createDataFrame([("a1", at(0), "r", 4, "e1", "A", "i1", 2), ("a2", at(5), "r", 2, "e2", "A", "i1", 1)], "id string, ts timestamp, rule_id string, severity int, event_id string, asset_id string, incident_id string, count long")
    rules = spark.createDataFrame([("r", "Title|x")], "rule_id string, title string")
    inc = spark.createDataFrame([("i1", T0, "open", '{"verdict":"malicious","confidence":95}', "Case")], "id string, created_at timestamp, status string, ai_verdict string, title string")
    commands = spark.createDataFrame([("c1", T0, "isolate", "sent", "A", "i1", "auto", None, None)], "id string, created_at timestamp, kind string, status string, asset_id string, incident_id string, issued_by string, detail string, completed_at timestamp")
    now = F.lit(at(30)).cast("timestamp")
    trend = views.alert_trend(alerts, now)
    assert trend.count() == 24 and trend.agg(F.sum("hits")).head()[0] == 3
    nodes = spark.createDataFrame([("i1", "asset:A", "asset", "A", T0)], "incident_id string, id string, type string, label string, first_ts timestamp")
    report = views.incident_reports(inc, alerts, nodes, commands, rules, now).head().report
    assert "# Case" in report and "Title\\|x" in report and "Hosts: `A`" in report and "- isolate sent" in report
    assert "x2" in views.incident_context(inc, alerts, rules).head().context
    decided = views.notification_decisions(inc.withColumn("severity", F.lit(4)), F.lit(at(-1)).cast("timestamp"))
    assert decided.head().decision == "send"
    for fmt in ("generic", "dingtalk", "feishu", "wecom"):
        assert "Case" in views.notification_payloads(decided, fmt, "https://h/").head().payload
    assert views.isolation_candidates(inc, alerts, commands).count() == 0 and views.isolation_candidates(inc, alerts, commands.limit(0)).count() == 1
    assets = spark.createDataFrame([("A", "ag")], "id string, agent_id string")
    assert views.pending_commands(commands, assets).count() == 1
    done = views.apply_command_results(commands, spark.createDataFrame([("c1", "weird", "d", at(1)), ("zz", "done", "d", at(1))], "id string, status string, detail string, ts timestamp"))
    assert [(r.status, r.detail) for r in done.collect()] == [("failed", "d")]
    events = spark.createDataFrame([("e1", at(-99999)), ("e0", at(-99999)), ("e9", at(0))], "id string, ts timestamp")
    kept, gone = views.retention(events, alerts, now, timedelta(days=30))
    assert sorted(r.id for r in kept.collect()) == ["e1", "e9"] and [r.id for r in gone.collect()] == ["e0"]
    assert views.retention(events, alerts, now, None)[1].count() == 0


def test_context_details_and_status(spark):
    alerts = spark.createDataFrame([("a1", at(0), "r", 4, "e1", "A", "i1", 2, at(1)), ("a2", at(5), "r", 2, "e2", None, "i2", 1, at(5)), ("a3", at(7), "q", 2, None, "A", "i1", 1, at(7))], "id string, ts timestamp, rule_id string, severity int, event_id string, asset_id string, incident_id string, count long, last_ts timestamp")
    events = spark.createDataFrame([("e1", 4003, None, None, "t", '{"query":{"hostname":"h.example"}}'), ("e2", 1007, "p", "q", None, '{"process":{"name":"sh","pid":7}}')], "id string, class_uid int, process_guid string, parent_process_guid string, conn_tuple string, raw string")
    assets = spark.createDataFrame([("A", "hostA")], "id string, hostname string")
    rules = spark.createDataFrame([("r", "Title")], "rule_id string, title string")
    inc = spark.createDataFrame([("i1", "open", "One"), ("i2", "false_positive", "Two")], "id string, status string, title string")
    known = views.alerts_with_event_asset(alerts, events, assets).cache()
    labels = {r.id: r.l for r in known.select("id", correlate.graph_label(F.col("class_uid"), F.col("raw")).alias("l")).collect()}
    assert labels == {"a1": "DNS h.example", "a2": "sh (7)", "a3": "process"}
    assigned = known.withColumns({"label": correlate.graph_label(F.col("class_uid"), F.col("raw")), "parent_alert_id": F.lit(None).cast("string"), "reason": F.lit("new")})
    nodes, edges, _ = correlate.incident_graph(assigned)
    assert {(r.type, r.label) for r in nodes.collect()} >= {("asset", "hostA"), ("connection", "DNS h.example"), ("process", "sh (7)")}
    history = views.false_positive_history(alerts, inc, rules, F.lit(at(30)).cast("timestamp"))
    got = {r.id: r.context for r in views.incident_context(inc, known, rules, graph=(nodes, edges), history=history, max_raw=12).collect()}
    assert got["i1"].splitlines()[0] == "Incident i1 Open One" and "connection DNS h.example" in got["i1"] and "conn" in got["i1"] and 'event={"query":{"h…' in got["i1"]
    assert "Judged false positive before:\nTitle 2024-01-01 (Two)" in got["i1"] and "Judged" not in got["i2"]
    detail = views.incident_alerts(alerts, events, rules).collect()
    assert sorted((r.incident_id, r.position, r.title, r.evidence != "") for r in detail) == [("i1", 1, "Title", True), ("i1", 2, "q", False), ("i2", 1, "Title", True)]
    changes = spark.createDataFrame([("i1", "triaged", at(1)), ("i1", "closed", at(2)), ("i2", "open", at(3)), ("zz", "open", at(1)), ("i2", None, at(9))], "id string, status string, ts timestamp")
    now, bad = views.apply_status_changes(inc, changes)
    assert {r.id: r.status for r in now.collect()} == {"i1": "closed", "i2": "open"} and sorted(r.reason for r in bad.collect()) == ["id", "status", "status"]
    summary = {r.id: (r.alerts, r.severity) for r in views.incident_summary(inc.withColumns({"created_at": F.lit(None).cast("timestamp"), "ai_verdict": F.lit(None).cast("string")}), alerts.where("id <> 'a2'")).collect()}
    assert summary == {"i1": (2, 4), "i2": (0, 0)}
    rows = views.rule_rows(spark.createDataFrame([("a", 4002), ("b", None), ("c", 1007)], "rule_id string, class_uid int"))
    assert {r.rule_id: (r.ingested, r.source) for r in rows.collect()} == {"a": (False, None), "b": (True, "all classes"), "c": (True, "process activity")}
    listed = views.list_rows(spark.createDataFrame([("s", "r")], "id string, rule_id string"), "suppressions", rules).head()
    assert listed.rule_title == "Title" and listed.reason is None
    assert [r.hostname for r in views.assets_by_hostname(spark.createDataFrame([("1", "b"), ("2", "a")], "id string, hostname string")).collect()] == ["a", "b"]


def test_ancestors_on_a_cycle(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "guid string, parent string")
    got = sorted((r.guid, r.ancestor, r.level) for r in correlate.ancestors(spark.createDataFrame([("a",), ("x",), ("z",)], "guid string"), parents, 16).collect())
    assert got == [("a", "b", 1), ("a", "c", 2), ("x", "y", 1)]


def test_repeated_process_starts(spark):
    rows = [("g", "h", at(0), 10, 1), ("g", "h", at(2), 10, 20), ("k", "h", at(1), 20, 10)]
    got = sorted((r.guid, r.pid, r.parent_guid) for r in windows.resolve_process_instance(spark.createDataFrame(rows, "guid string, host string, ts timestamp, pid int, ppid int")).collect() if r.parent_guid)
    assert got == [("g", 10, "k"), ("k", 20, "g")]


def test_addresses_as_numbers_and_in_one_spelling(spark):
    rng = random.Random(1)
    given = ["::", "::1", "1::", "1:0:0:2::3", "fe80::1%eth0", "::ffff:10.1.2.3", "0:0:0:0:0:ffff:0a01:0203", "64:ff9b::1.2.3.4", "10.0.0.1", "255.255.255.255", "2001:DB8:0:1:0:0:0:1"]
    for _ in range(200):
        number = [rng.choice((0, 0, rng.randrange(65536))) for _ in range(8)]
        address = ipaddress.IPv6Address(b"".join(x.to_bytes(2, "big") for x in number))
        given += [address.exploded.upper(), address.compressed]
    rows = spark.createDataFrame([(x,) for x in given + ["no address", "1:2", "1::2::3", "300.1.1.1", None]], "a string").select("a", S.ip_hex("a").alias("h"), S.ip_text("a").alias("t")).collect()
    for a, h, t in rows:
        try:
            parsed = ipaddress.ip_address((a or "").split("%")[0])
        except ValueError:
            assert h is None and t == a
            continue
        four = parsed if parsed.version == 4 else parsed.ipv4_mapped
        assert h == (b"\0" * 10 + b"\xff\xff" + four.packed if four else parsed.packed).hex(), a
        assert t == str(four or parsed), a
