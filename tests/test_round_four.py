"""Queries on tables unlike the given ones, against their SQL."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F
from tracehold.operators import correlate, views
from tracehold.plans import records, registry  # noqa: F401  (records adds its queries to the registry)


def tables(spark, folder, rows: list[tuple[int, str, int]]) -> str:
    """events, one a minute, of (user_id, event_type, k), and two pages."""
    start = datetime(2024, 1, 1)
    events = [(i, start + timedelta(minutes=i), user, kind, 1.0, f'{{"k": {k}}}') for i, (user, kind, k) in enumerate(rows)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(0, "https://a.example.org/"), (1, "https://b.test/")], "page_id long, url string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def by_sql(d: str, name: str) -> Counter:
    con = duckdb.connect()
    for table in ("events", "pages"):
        con.sql(f"create view {table} as select * from '{d}/{table}.parquet/*.parquet'")
    return Counter(con.sql(registry.oracle_sql()[name]).fetchall())


def by_query(spark, d: str, name: str) -> Counter:
    return Counter(tuple(r) for r in registry.queries()[name](spark, d).collect())


def test_flows_of_hosts_beyond_one_group(spark, tmp_path):
    users = [0, 254, 65533, 65534, 65535, 65536, 66809, 89999, 1_048_575]
    d = tables(spark, tmp_path, [(u, "click", k) for u in users for k in range(7)])
    got = by_query(spark, d, "flows_six")
    assert got == by_sql(d, "flows_six") and len(got) == len(users)


def most_joined(df) -> int:
    """df is collected; the rows that the largest of its joins made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        made = node.metrics().get("numOutputRows")
        if name.endswith("JoinExec") and made.isDefined():
            most = max(most, made.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_false_positives_do_not_multiply_by_incidents(spark):
    start, rng = datetime(2024, 1, 1), random.Random(4)
    alerts = [(i, start + timedelta(minutes=rng.randrange(3000)), rng.choice("abc"), rng.choice([*range(40)] * 3 + [*range(400)] + [None])) for i in range(3000)]
    alerts += [(3000 + i, start + timedelta(days=3, minutes=i), "a", 0) for i in range(60)]  # the newest are one incident's own
    incidents = [(i, "false_positive" if i % 3 == 0 else "open", rng.choice(["x", "y", "z", None])) for i in range(400)]
    frame = spark.createDataFrame(alerts, "id long, ts timestamp, rule_id string, incident_id long")
    found = views.false_positive_history(frame, spark.createDataFrame(incidents, "id long, status string, title string"), spark.createDataFrame([("a", "A")], "rule_id string, title string"), F.lit(start + timedelta(days=4)).cast("timestamp"))
    false = {i: title for i, status, title in incidents if status == "false_positive"}
    newest = sorted(((ts, i, rule, incident) for i, ts, rule, incident in alerts if incident in false), reverse=True)
    expected = set()
    for incident in {a[3] for a in alerts} - {None}:
        own = {a[2] for a in alerts if a[3] == incident}
        cases = dict.fromkeys((rule, false[other]) for _, _, rule, other in [p for p in newest if p[2] in own and p[3] != incident][:20])
        expected |= {(incident, rule, title, k + 1) for k, (rule, title) in enumerate([*cases][:5])}
    assert {(r.incident_id, r.rule_id, r.fp_title, r.position) for r in found.collect()} == expected
    assert most_joined(found) <= 2000  # rows of alerts, or of incidents; 400 incidents and 40 false positives a rule are far more


def test_only_new_alerts_look_for_parents(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(1, at(0), "A", None, 1), (2, at(5), "A", None, 1), (3, at(6), "B", None, 3), (4, at(9), "A", None, None), (5, at(12), "C", None, None), (6, at(13), "C", None, None), (7, at(14), "B", None, None), (8, at(99), "D", "p2", None), (9, at(7), "Z", "p1", 9)]
    alerts = spark.createDataFrame(rows, "id long, ts timestamp, asset_id string, process_guid string, incident_id long")
    # The connection at 0 is more than the window before the first new alert; that from A to C at 11 is not.
    events = spark.createDataFrame([(1, at(-30), "B", None, None, "tcp:10.0.0.2:1>10.0.0.3:2"), (2, at(11), "A", None, None, "tcp:10.0.0.1:1>10.0.0.3:2"), (3, at(1), "Z", "p2", "p1", None)], "event_id long, ts timestamp, asset_id string, process_guid string, parent_process_guid string, conn_tuple string")
    assets = spark.createDataFrame([("A", ["10.0.0.1"]), ("B", ["10.0.0.2"]), ("C", ["10.0.0.3"])], "asset_id string, ip_addrs array<string>")
    existing = spark.createDataFrame([(1, "open"), (3, "closed"), (9, "triaged")], "id long, status string")
    found = correlate.assign_incidents(alerts, events, assets, timedelta(minutes=20), existing=existing)
    got = {r.id: (r.parent_alert_id, r.reason, r.incident_id) for r in found.collect()}
    assert {k: v for k, v in got.items() if k > 3 and k < 9} == {4: (2, "asset", 1), 5: (4, "lateral", 1), 6: (5, "asset", 1), 7: (None, "new", 7), 8: (9, "lineage", 9)}
    assert {k: got[k] for k in (1, 2, 3, 9)} == {1: (None, None, 1), 2: (None, None, 1), 3: (None, None, 3), 9: (None, None, 9)}
