"""Queries over the driver's tables, one for each operator, with DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.rules import TACTICS, compile_rule
from ..operators import correlate, detect, flows, normalise, views, windows
from ..operators.sinks import stored
from .adapter import HITS, RULES, T, address, assets_of, events_of, telemetry

DAY, HOURS12 = timedelta(days=1), timedelta(hours=12)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_R = tuple(compile_rule(r) for r in RULES)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """sql: text after the adapter's CTEs; `@` at its start leaves them out."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql[1:] if sql.startswith("@") else f"with recursive {T}, {sql}"
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


FIELDS = lambda: {"dst_endpoint.port": F.col("dst_port"), "query.hostname": F.col("hostname"), "process.file.path": F.when(F.col("class_uid") == 1007, F.col("exe_path")), "file.path": F.when(F.col("class_uid") == 1001, F.col("exe_path")), "actor.user.name": F.col("username"), "status_id": F.col("status_id")}
KEEP = ("event_id", "asset_id", "exe_path", "username", "process_guid", "conn_tuple")


def hits_of(t: DataFrame) -> DataFrame:
    return detect.match_rules(t.withColumn("id", F.col("event_id")), _R, FIELDS(), KEEP, raw=None, os="os")


def hits(spark: SparkSession, d: str) -> DataFrame:
    return hits_of(telemetry(spark, d))


def now_of(t: DataFrame):
    return F.lit(t.agg(F.max("ts")).head()[0])


# Rules


@query("match_rules", f"{HITS} select event_id, rule_id, severity from hits")
def match_rules(spark, d):
    return hits(spark, d).select("event_id", "rule_id", "severity")


@query("match_rules_json", f"{HITS} select event_id, rule_id, severity from hits")
def match_rules_json(spark, d):
    """The same rules, read out of the nested JSON body."""
    return detect.match_rules(events_of(telemetry(spark, d)), _R, None, ("event_id",), os="os").select("event_id", "rule_id", "severity")


@query("keyword_rule", "@select doc_id, lang from documents where contains(lower(text), 'password') or contains(lower(text), 'licensed under')")
def keyword_rule(spark, d):
    rule = compile_rule({"id": "kw", "logsource": {"product": "linux"}, "detection": {"kw": ["password", "Licensed under"], "condition": "kw"}})
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(None).cast("timestamp").alias("ts"), F.lit(100001).alias("class_uid"), "lang", "text")
    return detect.match_rules(docs, [rule], {"message": F.col("text")}, ("lang",), raw=None).select(F.col("id").alias("doc_id"), "lang")


@query("rule_hit_totals", f"{HITS} select rule_id, count(*) as hits, max(severity) as severity from hits group by 1")
def rule_hit_totals(spark, d):
    h = hits(spark, d).withColumn("count", F.lit(1).cast("long"))
    return views.rule_hit_totals(h).join(h.groupBy("rule_id").agg(F.max("severity").alias("severity")), "rule_id")


@query("attack_coverage", f"{HITS}, tag(rule_id, tactic, technique) as (values ('r-port', 'command-and-control', 'T1571'), ('r-name', 'command-and-control', 'T1071.004'), ('r-tool', 'execution', 'T1059'), ('r-file', 'persistence', 'T1543'), ('r-fail', 'credential-access', 'T1110')) select tactic, technique, 1::bigint as rules, count(h.rule_id) as hits from tag left join hits h using (rule_id) group by 1, 2")
def attack_coverage(spark, d):
    rules = detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df
    cells, _, _ = detect.attack_coverage(rules, TACTICS)
    counts = hits(spark, d).groupBy("rule_id").count().join(rules.select("rule_id", F.explode("techniques").alias("technique")), "rule_id")
    return cells.join(counts.groupBy("technique").agg(F.sum("count").alias("hits")), "technique", "left").select("tactic", "technique", "rules", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("with_rule_title", f"{HITS} select event_id, rule_id, case rule_id when 'r-port' then 'Uncommon port' when 'r-name' then 'Watched domain' when 'r-tool' then 'Watched tools' when 'r-file' then 'Application file' else 'Failed login on Linux' end as title from hits")
def with_rule_title(spark, d):
    return detect.with_rule_title(hits(spark, d), detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df).select("event_id", "rule_id", "title")


@query("technique_replay", f"{HITS} select t.event_id, bool_or(h.rule_id in ('r-tool', 'r-fail') and h.rule_id is not null) as detected from t left join hits h using (event_id) group by 1")
def technique_replay(spark, d):
    """Every event as a labelled case of T1059.001 or T1110.003; rules carry the parent technique."""
    t = events_of(telemetry(spark, d))
    technique = F.when(F.col("class_uid") == 3002, "T1110.003").otherwise("T1059.001")
    cases = t.select(F.col("event_id").cast("string").alias("name"), F.lit("").alias("case_name"), technique.alias("technique"), "class_uid", "os", F.col("raw").alias("event"), F.lit("detected").alias("expect"))
    return detect.replay_corpus(cases, detect.rule_set(spark, [(r["id"], r) for r in RULES])).select(F.col("name").cast("long").alias("event_id"), "detected")


# Indicators and suppressions

INTEL = """
intel as (
  select 'd' || page_id as id, 'domain' as kind, host as value, 4 as severity, case when page_id % 3 = 0 then (select min(ts) from t) + interval 10 day end as expires_at from pg where page_id % 25 = 0
  union all select 'x', 'domain', 'example.org', 3, null
  union all select 'i' || asset_id, 'ip', '10.0.' || (asset_id // 250) || '.' || (asset_id % 250), 5, null from (select distinct asset_id from t) where asset_id % 20 = 0),
probe as (
  select event_id, ts, 'ip' as kind, unnest([src_ip, dst_ip]) as value from t where src_ip is not null
  union select event_id, ts, 'domain', array_to_string(list_slice(string_split(lower(hostname), '.'), i, 99), '.') from (select event_id, ts, hostname, unnest(range(1, len(string_split(hostname, '.')) + 1)) as i from t where hostname is not null)),
ioc as (select distinct p.event_id, p.ts, 'intel:' || kind || ':' || value as rule_id, severity, id as ioc_id from probe p join intel i using (kind, value) where expires_at is null or p.ts <= expires_at)"""


def intel_of(t: DataFrame, pages: DataFrame) -> DataFrame:
    start = F.lit(t.agg(F.min("ts")).head()[0])
    host = F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1)
    none = F.lit(None).cast("timestamp")
    domains = pages.where("page_id % 25 = 0").select(F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("id"), F.lit("domain").alias("kind"), host.alias("value"), F.lit(4).alias("severity"), F.when(F.col("page_id") % 3 == 0, start + F.expr("interval 10 days")).alias("expires_at"))
    fixed = t.sparkSession.range(1).select(F.lit("x").alias("id"), F.lit("domain").alias("kind"), F.lit("example.org").alias("value"), F.lit(3).alias("severity"), none.alias("expires_at"))
    ips = t.select("asset_id").distinct().where("asset_id % 20 = 0").select(F.concat(F.lit("i"), F.col("asset_id").cast("string")).alias("id"), F.lit("ip").alias("kind"), address(F.col("asset_id")).alias("value"), F.lit(5).alias("severity"), none.alias("expires_at"))
    return domains.unionByName(fixed).unionByName(ips)


def ioc_hits(spark, d) -> DataFrame:
    t = telemetry(spark, d)
    return detect.match_intel(events_of(t), intel_of(t, spark.read.parquet(f"{d}/pages.parquet")), keep=("event_id", "asset_id"))


@query("match_intel", f"{INTEL} select event_id, rule_id, severity, ioc_id from ioc")
def match_intel(spark, d):
    """Indicators found in the nested bodies by key name, with all parent domains."""
    return ioc_hits(spark, d).select("event_id", "rule_id", "severity", "ioc_id")


@query("intel_counters", f"{INTEL} select ioc_id, count(*) as hits, max(ts) as last from ioc group by 1")
def intel_counters(spark, d):
    return detect.match_counters(ioc_hits(spark, d), "ioc_id")


@query("union_detections", f"{HITS}, {INTEL} select event_id, rule_id, severity from hits union all select event_id, rule_id, severity from ioc")
def union_detections(spark, d):
    return detect.union_detections(hits(spark, d), ioc_hits(spark, d)).select("event_id", "rule_id", "severity")


@query("import_intel", "@with l as (select distinct case when regexp_matches(v, '^[0-9.]+$') then 'ip' else 'domain' end as kind, lower(v) as value from (select regexp_extract(url, '^[a-z]+://([^/:]+)', 1) as v from pages)) select kind, value from l where value <> ''")
def import_intel(spark, d):
    lines = spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("# page\n\n"), F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1), F.lit("\r\n")).alias("text"))
    existing = spark.createDataFrame([], "kind string, value string")
    return detect.import_intel(lines, existing, now=F.lit("2024-01-01").cast("timestamp"))[0].select("kind", "value")


SUPP = """
supp as (
  select 's' || asset_id as id, 'r-fail' as rule_id, asset_id, cast(null as timestamp) as expires_at, asset_id as created from (select distinct asset_id from t) where asset_id % 4 = 0
  union all select 'g', 'r-name', null, (select min(ts) from t) + interval 15 day, -1
  union all select 'h', 'r-fail', 8, null, 1000000000),
credit as (select h.event_id, h.rule_id, arg_min(s.id, (s.created, s.id)) as suppression_id from hits h join supp s on s.rule_id = h.rule_id and (s.asset_id is null or s.asset_id = h.asset_id) and (s.expires_at is null or h.ts <= s.expires_at) group by 1, 2)"""


def suppressed(spark, d):
    t = telemetry(spark, d)
    start, none = F.lit(t.agg(F.min("ts")).head()[0]), F.lit(None).cast("timestamp")
    created = lambda c: F.timestamp_seconds(c)
    per = t.select("asset_id").distinct().where("asset_id % 4 = 0").select(F.concat(F.lit("s"), F.col("asset_id").cast("string")).alias("id"), created(F.col("asset_id")).alias("created_at"), F.lit("r-fail").alias("rule_id"), "asset_id", none.alias("expires_at"))
    one = spark.range(1)
    whole = one.select(F.lit("g").alias("id"), created(F.lit(-1)).alias("created_at"), F.lit("r-name").alias("rule_id"), F.lit(None).cast("long").alias("asset_id"), (start + F.expr("interval 15 days")).alias("expires_at"))
    late = one.select(F.lit("h").alias("id"), created(F.lit(1000000000)).alias("created_at"), F.lit("r-fail").alias("rule_id"), F.lit(8).cast("long").alias("asset_id"), none.alias("expires_at"))
    return detect.apply_suppressions(hits_of(t), per.unionByName(whole).unionByName(late))


@query("apply_suppressions", f"{HITS}, {SUPP} select event_id, rule_id from hits anti join credit using (event_id, rule_id)")
def apply_suppressions(spark, d):
    return suppressed(spark, d)[0].select("event_id", "rule_id")


@query("suppressed_hits", f"{HITS}, {SUPP} select event_id, rule_id, suppression_id from credit")
def suppressed_hits(spark, d):
    return suppressed(spark, d)[1].select("event_id", "rule_id", "suppression_id")


@query("suppression_counters", f"{HITS}, {SUPP} select suppression_id, count(*) as hits, max(ts) as last from credit join hits using (event_id, rule_id) group by 1")
def suppression_counters(spark, d):
    return detect.match_counters(suppressed(spark, d)[1], "suppression_id")


# Windows

WINDOWED = """
nxt as (select a.rule_id, a.asset_id, a.ts, min(b.ts) as nx from (select distinct rule_id, asset_id, ts from hits) a left join (select distinct rule_id, asset_id, ts from hits) b on a.rule_id = b.rule_id and a.asset_id = b.asset_id and b.ts >= a.ts + interval 1 day group by 1, 2, 3),
op as (select rule_id, asset_id, min(ts) as ts, 1::bigint as n from hits group by 1, 2 union all select op.rule_id, op.asset_id, nxt.nx, n + 1 from op join nxt using (rule_id, asset_id, ts) where nxt.nx is not null),
win as (select h.*, o.n as window_no, o.ts as first_ts from hits h asof join op o on h.rule_id = o.rule_id and h.asset_id = o.asset_id and h.ts >= o.ts),
alerts as (select rule_id, asset_id, window_no, count(*) as count, min(ts) as ts, max(ts) as last_ts, max(severity) as severity, arg_min(event_id, (ts, event_id)) as id, arg_min(process_guid, (ts, event_id)) as process_guid, arg_min(conn_tuple, (ts, event_id)) as conn_tuple from win group by 1, 2, 3)"""


@query("dedup_window", f"{HITS}, {WINDOWED} select event_id, rule_id, window_no, first_ts from win")
def dedup_window(spark, d):
    return windows.dedup_window(hits(spark, d), ["rule_id", "asset_id"], "ts", DAY).select("event_id", "rule_id", "window_no", "first_ts")


@query("alert_rollup", f"{HITS}, {WINDOWED} select rule_id, asset_id, window_no, count, ts as first_ts, last_ts, severity, id as event_id from alerts")
def alert_rollup(spark, d):
    return windows.alert_rollup(hits(spark, d), ["rule_id", "asset_id"], "ts", DAY, "event_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts and hits per rule: events through rules and the de-duplication window."""
    alerts = windows.alert_rollup(hits(spark, sf_dir), ["rule_id", "asset_id"], "ts", DAY, "event_id")
    return alerts.groupBy("rule_id").agg(F.count("*").alias("alerts"), F.sum("count").alias("hits"))


@query("funnel", f"{HITS}, {WINDOWED} select rule_id, count(*) as alerts, sum(count)::bigint as hits from alerts group by 1")
def funnel(spark, d):
    return flagship(spark, d)


@query("conn_sample", """c as (select event_id, ts, asset_id, dst_ip, dst_port from t where class_uid = 4001),
nxt as (select a.asset_id, a.dst_ip, a.dst_port, a.ts, min(b.ts) as nx from c a left join c b on a.asset_id = b.asset_id and a.dst_ip = b.dst_ip and a.dst_port = b.dst_port and b.ts >= a.ts + interval 1 day group by 1, 2, 3, 4),
op as (select asset_id, dst_ip, dst_port, min(ts) as ts from c group by 1, 2, 3 union all select op.asset_id, op.dst_ip, op.dst_port, nxt.nx from op join nxt using (asset_id, dst_ip, dst_port, ts) where nxt.nx is not null)
select event_id from c semi join op using (asset_id, dst_ip, dst_port, ts)""")  # fmt: skip
def conn_sample(spark, d):
    return windows.sample_first(telemetry(spark, d).where("class_uid = 4001"), ["asset_id", "dst_ip", "dst_port"], "ts", DAY).select("event_id")


@query("brute_force_success", "a as (select *, count(*) filter (status_id = 2) over (partition by asset_id, username order by ts range between interval 10 day preceding and current row) as failures from t where class_uid = 3002) select event_id, failures, 'bruteforce:success' as rule_id, 5 as severity from a where status_id = 1 and failures >= 5")
def brute_force_success(spark, d):
    return windows.brute_force_success(telemetry(spark, d), timedelta(days=10), 5).select("event_id", "failures", "rule_id", "severity")


FIRST = "f as (select asset_id, exe_path, min(ts) as first_seen, arg_min(event_id, (ts, event_id)) as event_id from t where exe_path is not null group by 1, 2), l as (select asset_id, min(first_seen) as s from f group by 1)"


@query("first_seen", f"{FIRST} select event_id, asset_id, exe_path, first_seen as ts, 2 as severity from f join l using (asset_id) where first_seen >= s + interval 7 day")
def first_seen(spark, d):
    return windows.first_seen(telemetry(spark, d).withColumn("id", F.col("event_id")))[1].select("event_id", "asset_id", "exe_path", "ts", "severity")


@query("first_seen_baseline", f"{FIRST} select asset_id, exe_path, first_seen from f")
def first_seen_baseline(spark, d):
    return windows.first_seen(telemetry(spark, d).withColumn("id", F.col("event_id")))[0]


@query("learning_start", f"{FIRST} select asset_id, s as learning_start from l")
def learning_start(spark, d):
    return windows.learning_start(windows.first_seen(telemetry(spark, d).withColumn("id", F.col("event_id")))[0])


@query("gap_sessions", f"{HITS}, g as (select *, case when ts - lag(ts) over w <= interval 12 hour then 0 else 1 end as n from hits window w as (partition by asset_id order by ts, event_id)) select event_id, rule_id, sum(n) over (partition by asset_id order by ts, event_id)::bigint as session_no from g")
def gap_sessions(spark, d):
    return windows.gap_sessions(hits(spark, d), "asset_id", "ts", HOURS12, "event_id").select("event_id", "rule_id", "session_no")


@query("latest_state", "s as (select asset_id, arg_max(class_uid, (ts, event_id)) as class_uid, arg_max(event_id, (ts, event_id)) as event_id from t group by 1) select * from s")
def latest_state(spark, d):
    return windows.latest_state(telemetry(spark, d), "asset_id", "ts", "event_id").select("asset_id", "class_uid", "event_id")


@query("process_instance_asof", "p as (select event_id, ts, asset_id % 10 as host, k % 40 as pid, (k + 7) % 40 as ppid, process_guid as guid from t where process_guid is not null), a as (select p.guid, q.guid as parent_guid from p asof left join p q on p.host = q.host and p.ppid = q.pid and p.ts > q.ts) select guid, parent_guid from a")
def process_instance_asof(spark, d):
    starts = telemetry(spark, d).where("process_guid is not null").select(F.col("process_guid").alias("guid"), "ts", (F.col("asset_id") % 10).alias("host"), (F.col("k") % 40).alias("pid"), ((F.col("k") + 7) % 40).alias("ppid"))
    return windows.resolve_process_instance(starts).select("guid", "parent_guid")


@query("ingest_loss", "g as (select asset_id, k, lag(k) over (partition by asset_id order by ts, event_id) as b from t) select asset_id, sum(case when b is null or k < b then k else k - b end)::bigint as dropped from g group by 1")
def ingest_loss(spark, d):
    """k as each asset's running counter."""
    return windows.ingest_loss(telemetry(spark, d).select("asset_id", F.struct("ts", "event_id").alias("ts"), F.col("k").cast("long").alias("k")), "asset_id", "ts", "k")


# Correlation

_LINEAGE = """
pp as (select process_guid as guid, parent_process_guid as parent from t where parent_process_guid is not null),
up as (select a.id, a.ts, pp.parent as anc, 1 as level from alerts a join pp on pp.guid = a.process_guid union all select up.id, up.ts, pp.parent, level + 1 from up join pp on pp.guid = up.anc where level < 16),
lin as (select id, arg_max(pid, (pts, pid)) as lineage_parent from (select up.id, up.level, b.id as pid, b.ts as pts, min(up.level) over (partition by up.id) as nearest from up join alerts b on b.process_guid = up.anc where (b.ts, b.id) < (up.ts, up.id)) where level = nearest group by 1)"""
_GAP = "gap as (select id, case when ts - lag(ts) over w <= interval 12 hour then lag(id) over w end as gap_parent from alerts window w as (partition by asset_id order by ts, id))"
_LATERAL = """
mine as (select id, ts, asset_id, '10.0.' || (asset_id // 250) || '.' || (asset_id % 250) as ip from alerts),
near as (select m.id, m.ts, c.asset_id as other, c.ts as cts, c.event_id as cid, row_number() over (partition by m.id order by c.ts desc, c.event_id desc) as n from mine m join t c on c.dst_ip = m.ip and c.class_uid = 4001 and c.asset_id <> m.asset_id and c.ts <= m.ts and c.ts >= m.ts - interval 12 hour),
lat as (select n.id, arg_max(b.id, (n.cts, n.cid, b.ts, b.id)) as lateral_parent from near n join alerts b on b.asset_id = n.other and (b.ts, b.id) < (n.ts, n.id) and b.ts >= n.ts - interval 12 hour where n.n <= 5 group by 1)"""
_ASSIGN = f"""{_LINEAGE}, {_GAP}, {_LATERAL},
par2 as (select a.id, coalesce(lineage_parent, gap_parent, lateral_parent) as parent, case when lineage_parent is not null then 'lineage' when gap_parent is not null then 'asset' when lateral_parent is not null then 'lateral' else 'new' end as reason from alerts a left join lin using (id) left join gap using (id) left join lat using (id)),
rt as (select id, id as root from par2 where parent is null union all select p.id, rt.root from par2 p join rt on p.parent = rt.id)"""


def alerts_of(spark, d) -> tuple[DataFrame, DataFrame]:
    """(telemetry, alerts); rule hits of one event would share the id, but each event hits one rule at most here."""
    t = telemetry(spark, d)
    rolled = windows.alert_rollup(hits_of(t), ["rule_id", "asset_id"], "ts", DAY, "event_id")
    more = t.select(F.col("event_id"), "process_guid", "conn_tuple")
    return t, stored(rolled.join(more, "event_id").select(F.col("event_id").alias("id"), F.col("first_ts").alias("ts"), "rule_id", "asset_id", "severity", "count", "last_ts", "process_guid", "conn_tuple"), "alerts")


@query("lineage_parent", f"{HITS}, {WINDOWED}, {_LINEAGE} select * from lin")
def lineage_parent(spark, d):
    t, alerts = alerts_of(spark, d)
    return correlate.lineage_parent(alerts, t)


@query("lateral_parent", f"{HITS}, {WINDOWED}, {_LATERAL} select * from lat")
def lateral_parent(spark, d):
    t, alerts = alerts_of(spark, d)
    return correlate.lateral_parent(alerts, assets_of(t), t.where("conn_tuple is not null"), HOURS12)


def incidents_of(spark, d) -> tuple[DataFrame, DataFrame]:
    t, alerts = alerts_of(spark, d)
    return t, stored(correlate.assign_incidents(alerts, t, assets_of(t), HOURS12), "incidents")


@query("incident_assign", f"{HITS}, {WINDOWED}, {_ASSIGN} select p.id, p.parent as parent_alert_id, p.reason, rt.root as incident_id from par2 p join rt using (id)")
def incident_assign(spark, d):
    return incidents_of(spark, d)[1].select("id", "parent_alert_id", "reason", "incident_id")


@query("incident_severity_count", f"{HITS}, {WINDOWED}, {_ASSIGN} select rt.root as incident_id, count(*) as alerts, max(a.severity) as severity from rt join alerts a using (id) group by 1")
def incident_severity_count(spark, d):
    return views.incident_severity_count(incidents_of(spark, d)[1])


_OWN = """
own as (select a.*, rt.root as incident_id, p.parent, p.reason from alerts a join rt using (id) join par2 p using (id)),
nd as (select incident_id, id, ts, unnest(list_filter(['asset:' || asset_id, 'alert:' || id, 'process:' || process_guid, 'connection:' || conn_tuple], lambda x: x is not null)) as node from own)"""


@query("incident_graph_nodes", f"{HITS}, {WINDOWED}, {_ASSIGN}, {_OWN} select incident_id, node as id, split_part(node, ':', 1) as type, min(ts) as first_ts from nd group by 1, 2, 3")
def incident_graph_nodes(spark, d):
    return correlate.incident_graph(incidents_of(spark, d)[1])[0].select("incident_id", "id", "type", "first_ts")


@query("incident_graph_edges", f"""{HITS}, {WINDOWED}, {_ASSIGN}, {_OWN}
select distinct incident_id, e.f as "from", e.t as "to", e.r as rel from (select incident_id, unnest([
  {{'f': 'asset:' || asset_id, 't': coalesce('process:' || process_guid, 'connection:' || conn_tuple), 'r': 'hosts'}},
  {{'f': coalesce('process:' || process_guid, 'connection:' || conn_tuple, 'asset:' || asset_id), 't': 'alert:' || id, 'r': 'triggered'}},
  {{'f': case when reason = 'lineage' then 'alert:' || parent end, 't': 'alert:' || id, 'r': 'spawned'}},
  {{'f': case when reason = 'lateral' then 'alert:' || parent end, 't': 'alert:' || id, 'r': 'lateral'}}]) as e from own) where e.f is not null and e.t is not null""")  # fmt: skip
def incident_graph_edges(spark, d):
    return correlate.incident_graph(incidents_of(spark, d)[1])[1]


@query("incident_graph_overflow", f"""{HITS}, {WINDOWED}, {_ASSIGN}, {_OWN},
fr as (select incident_id, arg_min(id, (ts, id)) as id, node from nd group by 1, 3), cnt as (select incident_id, id, count(*) as fresh from fr group by 1, 2),
b as (select o.incident_id, coalesce(sum(fresh) over (partition by o.incident_id order by o.ts, o.id rows between unbounded preceding and 1 preceding), 0) as before from own o left join cnt using (incident_id, id))
select incident_id, count(*) as overflow from b where before >= 6 group by 1""")  # fmt: skip
def incident_graph_overflow(spark, d):
    return correlate.incident_graph(incidents_of(spark, d)[1], max_nodes=6)[2]


@query("incident_entities", f"{HITS}, {WINDOWED}, {_ASSIGN}, {_OWN} select incident_id, array_to_string(list_sort(list_distinct(list(asset_id::varchar))), ',') as hosts, coalesce(array_to_string(list_sort(list_distinct(list(process_guid) filter (process_guid is not null))), ','), '') as processes from own group by 1")
def incident_entities(spark, d):
    e = views.incident_entities(correlate.incident_graph(incidents_of(spark, d)[1])[0])
    return e.select("incident_id", F.array_join("hosts", ",").alias("hosts"), F.array_join("processes", ",").alias("processes"))


@query("process_tree", "g as (select process_guid as guid from t where class_uid = 1001), pp as (select process_guid as guid, parent_process_guid as parent from t where parent_process_guid is not null), up as (select g.guid, pp.parent as anc, 1 as level from g join pp using (guid) union all select up.guid, pp.parent, level + 1 from up join pp on pp.guid = up.anc where level < 10) select guid, 'self' as relation, 0 as level, guid as process_guid from g union all select guid, 'ancestor', level, anc from up union all select g.guid, 'child', 1, pp.guid from g join pp on pp.parent = g.guid")
def process_tree(spark, d):
    t = telemetry(spark, d)
    return views.process_tree(t, t.where("class_uid = 1001").select(F.col("process_guid").alias("guid")))


# Views


@query("overview_stats", f"{HITS}, {WINDOWED}, n as (select max(ts) as now from t) select (select count(*) from t, n where ts >= now - interval 24 hour) as events_24h, (select coalesce(sum(count), 0)::bigint from alerts, n where ts >= now - interval 24 hour) as alerts_24h, (select count(distinct asset_id) from t) as assets, (select count(*) from (select asset_id, max(ts) as last from t group by 1), n where last >= now - interval 1 day) as assets_online")
def overview_stats(spark, d):
    t, alerts = alerts_of(spark, d)
    incidents = alerts.select("id", F.lit("open").alias("status"))
    out = views.overview_stats(t, alerts, incidents, assets_of(t), now_of(t), DAY)
    return out.select("events_24h", "alerts_24h", "assets", "assets_online")


@query("incident_status_count", f"{HITS}, {WINDOWED} select case severity when 5 then 'open' when 4 then 'triaged' else 'closed' end as status, count(*) as incidents from alerts group by 1")
def incident_status_count(spark, d):
    t, alerts = alerts_of(spark, d)
    status = F.when(F.col("severity") == 5, "open").when(F.col("severity") == 4, "triaged").otherwise("closed")
    out = views.overview_stats(t, alerts, alerts.select("id", status.alias("status")), assets_of(t), now_of(t))
    return out.select(F.explode("incidents").alias("status", "incidents"))


@query("alert_trend", f"{HITS}, {WINDOWED}, n as (select max(ts) as now from t), b as (select greatest(0, floor((epoch_us(ts) - epoch_us(date_trunc('hour', now) - interval 23 hour)) / 3600000000.0))::int as bucket, sum(count)::bigint as hits from alerts, n where ts >= now - interval 24 hour and ts <= now group by 1) select r.i::int as bucket, coalesce(hits, 0) as hits from range(24) r(i) left join b on b.bucket = r.i")
def alert_trend(spark, d):
    t, alerts = alerts_of(spark, d)
    return views.alert_trend(alerts, now_of(t)).select("bucket", "hits")


@query("top_rules", f"{HITS}, {WINDOWED}, n as (select max(ts) as now from t) select rule_id, sum(count)::bigint as hits from alerts, n where ts >= now - interval 24 hour group by 1 order by hits desc, rule_id limit 5")
def top_rules(spark, d):
    t, alerts = alerts_of(spark, d)
    return views.top_rules(alerts, detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df, now_of(t)).select("rule_id", "hits")


@query("search_events", "s as (select event_id, ts from t where class_uid = 4001 and contains(lower(props), '\"k\": 7') order by ts desc, event_id desc limit 100) select * from s")
def search_events(spark, d):
    t = telemetry(spark, d).withColumns({"id": F.col("event_id"), "raw": F.col("props")})
    return views.search_events(t, class_uid=4001, q='"K": 7').select("event_id", "ts")


@query("search_documents", "@select doc_id from documents where contains(lower(text), 'licensed') order by doc_id desc limit 200")
def search_documents(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.timestamp_seconds("doc_id").alias("ts"), F.col("text").alias("raw"))
    return views.search_events(docs, q="LICENSED", limit=500).select(F.col("id").alias("doc_id"))


@query("host_alert_history", f"{HITS}, {WINDOWED}, n as (select max(ts) as now from t) select id, rule_id, ts from alerts, n where asset_id = 8 and ts >= now - interval 90 day order by ts desc, id desc limit 20")
def host_alert_history(spark, d):
    t, alerts = alerts_of(spark, d)
    return views.host_alert_history(alerts, detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df, 8, now_of(t), 90).select("id", "rule_id", "ts")


@query("latest_alerts", f"{HITS}, {WINDOWED} select id, ts from alerts order by ts desc, id desc limit 50")
def latest_alerts(spark, d):
    return views.latest(alerts_of(spark, d)[1], 50, "ts").select("id", "ts")


@query("oldest_alerts", f"{HITS}, {WINDOWED} select id, ts from alerts order by ts, id limit 500")
def oldest_alerts(spark, d):
    return views.oldest(alerts_of(spark, d)[1], 500, "ts").select("id", "ts")


@query("event_brief", "b as (select event_id, case when length(props) > 8 then substr(props, 1, 8) || '…' else props end as raw from t) select * from b")
def event_brief(spark, d):
    t = telemetry(spark, d)
    return t.select("event_id", S.cut("props", 8).alias("raw"))


@query("retention", f"{HITS}, {WINDOWED}, n as (select max(ts) as now from t) select event_id from t, n where ts >= now - interval 10 day or event_id in (select id from alerts)")
def retention(spark, d):
    t, alerts = alerts_of(spark, d)
    return views.retention(t.withColumn("id", F.col("event_id")), alerts.select(F.col("id").alias("event_id")), now_of(t), timedelta(days=10))[0].select("event_id")


@query("retention_removed", f"{HITS}, {WINDOWED}, n as (select max(ts) as now from t) select event_id from t, n where ts < now - interval 10 day and event_id not in (select id from alerts)")
def retention_removed(spark, d):
    t, alerts = alerts_of(spark, d)
    return views.retention(t.withColumn("id", F.col("event_id")), alerts.select(F.col("id").alias("event_id")), now_of(t), timedelta(days=10))[1].select("event_id")


@query("pilot_metrics", f"{HITS}, {WINDOWED}, n as (select max(ts) as now from t) select (select count(*) from t) as events, (select count(*) from t, n where ts >= now - interval 1 hour) as events_1h, (select count(*) from alerts) as alerts, (select sum(count)::bigint from alerts) as alert_hits, (select count(distinct asset_id) from t) as assets")
def pilot_metrics(spark, d):
    t, alerts = alerts_of(spark, d)
    return views.pilot_metrics(t, alerts, alerts.select("id", F.lit("open").alias("status")), assets_of(t), now_of(t)).select("events", "events_1h", "alerts", "alert_hits", "assets")


_FP = "inc as (select id, case severity when 4 then 'false_positive' else 'open' end as status, 'case ' || (id % 7) as title from alerts), "


@query("false_positive_history", f"""{HITS}, {WINDOWED}, n as (select max(ts) as now from t), i as (select id, ts, rule_id, asset_id as incident_id from alerts),
inc as (select distinct incident_id, 'case ' || (incident_id % 7) as title from i where incident_id % 5 = 0),
past as (select rule_id, ts, id, inc.incident_id as fp, title from i join inc using (incident_id), n where ts >= now - interval 90 day),
pairs as (select m.incident_id, p.rule_id, p.title, row_number() over (partition by m.incident_id order by p.ts desc, p.id desc) as n from (select distinct incident_id, rule_id from i) m join past p on p.rule_id = m.rule_id and p.fp <> m.incident_id),
cs as (select incident_id, rule_id, title, min(n) as n from pairs where n <= 20 group by 1, 2, 3)
select incident_id, rule_id, title as fp_title from (select *, row_number() over (partition by incident_id order by n) as k from cs) where k <= 5""")  # fmt: skip
def false_positive_history(spark, d):
    """Each asset's alerts as one incident; every fifth is a false positive."""
    t, alerts = alerts_of(spark, d)
    i = alerts.withColumn("incident_id", F.col("asset_id"))
    incidents = i.select("incident_id").distinct().select(F.col("incident_id").alias("id"), F.when(F.col("incident_id") % 5 == 0, "false_positive").otherwise("open").alias("status"), F.concat(F.lit("case "), (F.col("incident_id") % 7).cast("string")).alias("title"))
    return views.false_positive_history(i, incidents, detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df, now_of(t)).select("incident_id", "rule_id", "fp_title")


@query("latest_open_alert", f"{HITS}, {WINDOWED}, n as (select max(ts) as now from t) select asset_id, max(ts) as ts, arg_max(id, (ts, id)) as id from alerts, n where severity <> 4 and ts >= now - interval 5 day group by 1")
def latest_open_alert(spark, d):
    t, alerts = alerts_of(spark, d)
    incidents = alerts.select(F.col("id"), F.when(F.col("severity") == 4, "closed").otherwise("open").alias("status"))
    return windows.latest_open_alert(alerts.withColumn("incident_id", F.col("id")), incidents, now_of(t) - F.expr("interval 5 days")).select("asset_id", "ts", "id")


_VERDICT = "case (id % 4) when 0 then '{\"verdict\":\"malicious\",\"confidence\":95}' when 1 then 'so: {\"verdict\":\"benign\",\"confidence\":50}' when 2 then 'no idea' end"


def judged_incidents(alerts: DataFrame) -> DataFrame:
    verdict = F.expr("case (id % 4) when 0 then '{\"verdict\":\"malicious\",\"confidence\":95}' when 1 then 'so: {\"verdict\":\"benign\",\"confidence\":50}' when 2 then 'no idea' end")
    return alerts.select("id", F.col("ts").alias("created_at"), F.when(F.col("severity") == 1, "closed").otherwise("open").alias("status"), "severity", verdict.alias("ai_verdict"), F.lit(None).cast("string").alias("title"))


@query("notification_decisions", f"{HITS}, {WINDOWED}, n as (select min(ts) + interval 3 day as s from t), r as (select id, case when ts < s then 'older than the service' when severity = 1 then 'closed' when id % 4 = 3 then 'verdict pending' when id % 4 = 1 then 'benign' when severity < 3 then 'low severity' else 'due' end as reason from alerts, n) select id, reason, case reason when 'due' then 'send' when 'verdict pending' then 'wait' else 'skip' end as decision from r")
def notification_decisions(spark, d):
    t, alerts = alerts_of(spark, d)
    start = F.lit(t.agg(F.min("ts")).head()[0]) + F.expr("interval 3 days")
    return views.notification_decisions(judged_incidents(alerts), start).select("id", "reason", "decision")


@query("isolation_candidates", f"{HITS}, {WINDOWED} select id as incident_id, asset_id from alerts where id % 4 = 0 and asset_id not in (8, 12) and id % 3 <> 0")
def isolation_candidates(spark, d):
    _, alerts = alerts_of(spark, d)
    commands = alerts.where("id % 3 = 0").select(F.col("id").alias("incident_id"), "asset_id", F.lit("isolate").alias("kind"), F.lit("auto").alias("issued_by"))
    return views.isolation_candidates(judged_incidents(alerts), alerts.withColumn("incident_id", F.col("id")), commands, exempt=(8, 12))


# Normalisation and scalars


@query("ioc_kind", "@with v as (select page_id, unnest([regexp_extract(url, '^[a-z]+://([^/:]+)', 1) || '.', md5(url), '10.0.' || (page_id % 200) || '.7', upper(sha256(url))]) as v from pages) select page_id, case when regexp_matches(v, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') then 'ip' when regexp_matches(v, '^([0-9A-Fa-f]{32}|[0-9A-Fa-f]{64})$') then 'hash' else 'domain' end as kind, regexp_replace(lower(v), '\\.$', '') as value from v")
def ioc_kind(spark, d):
    url = F.col("url")
    values = F.array(F.concat(F.regexp_extract(url, r"^[a-z]+://([^/:]+)", 1), F.lit(".")), F.md5(url), F.concat(F.lit("10.0."), (F.col("page_id") % 200).cast("string"), F.lit(".7")), F.upper(F.sha2(url, 256)))
    v = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(values).alias("v"))
    return v.select("page_id", S.ioc_kind("v").alias("k")).select("page_id", "k.kind", "k.value")


@query("parent_domains", "@with h as (select page_id, string_split(lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)), '.') as p from pages), i as (select page_id, p, unnest(range(1, len(p) + 1)) as i from h) select page_id, array_to_string(list_slice(p, i, len(p)), '.') as name from i")
def parent_domains(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(S.parent_domains(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1))).alias("name"))


@query("stable_id", "h as (select event_id, substr(sha256(event_id || chr(0) || coalesce(process_guid, '') || chr(0)), 1, 32) as h from t) select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h")
def stable_id(spark, d):
    return telemetry(spark, d).select("event_id", S.stable_id("event_id", "process_guid").alias("id"))


@query("conn_tuple_parse", "c as (select event_id, src_ip, 40000 + k as src_port, dst_ip, dst_port from t where conn_tuple is not null) select * from c")
def conn_tuple_parse(spark, d):
    return telemetry(spark, d).where("conn_tuple is not null").select("event_id", S.parse_conn_tuple("conn_tuple").alias("c")).select("event_id", "c.src_ip", "c.src_port", "c.dst_ip", "c.dst_port")


@query("fingerprint", f"{HITS} select event_id, rule_id || '|' || asset_id || case when class_uid = 1001 then '|' || exe_path else '' end as fingerprint from hits")
def fingerprint(spark, d):
    return hits(spark, d).select("event_id", S.fingerprint(F.col("rule_id"), F.col("asset_id").cast("string"), F.col("class_uid"), F.col("exe_path"), F.col("username")).alias("fingerprint"))


@query("md_cell", "@select conv_id, turn, case when text is null or text = '' then '-' else '`' || (case when length(c) > 160 then substr(c, 1, 157) || '…' else c end) || '`' end as cell from (select *, replace(replace(replace(text, chr(13), ''), chr(10), ' '), '|', '\\|') as c from conversations)")
def md_cell(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", S.md_cell("text").alias("cell"))


@query("parse_verdict", """@with c as (select conv_id, turn, case when turn % 2 = 0 then text || ' {"verdict": "benign", "confidence": ' || (turn * 10) || '} ' || text else text end as full_text from conversations),
v as (select conv_id, turn, regexp_extract(full_text, '\\{.*\\}', 0, 's') as j from c)
select conv_id, turn, case when j <> '' and json_valid(j) then j ->> '$.verdict' end as verdict, case when j <> '' and json_valid(j) then try_cast(j ->> '$.confidence' as int) end as confidence from v""")  # fmt: skip
def parse_verdict(spark, d):
    """Verdicts put inside the conversations' texts, and texts without one."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    text = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(' {"verdict": "benign", "confidence": '), (F.col("turn") * 10).cast("string"), F.lit("} "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", views.verdict_of(text).alias("v")).select("conv_id", "turn", "v.verdict", "v.confidence")


@query("syslog_parse", "s as (select event_id, (k + 10) // 8 as facility, (k + 10) % 8 as severity, date_trunc('second', ts) as ts, 'host' || asset_id as hostname, 'app' as app, (k + 1)::varchar as procid, props as content from t) select * from s")
def syslog_parse(spark, d):
    """Lines in the 3164 form for even events and the 5424 form for odd ones, built from the events."""
    t = telemetry(spark, d)
    pri = F.concat(F.lit("<"), (F.col("k") + 10).cast("string"), F.lit(">"))
    host, pid = F.concat(F.lit("host"), F.col("asset_id").cast("string")), (F.col("k") + 1).cast("string")
    old = F.concat(pri, F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.date_format("ts", "d"), 2, " "), F.lit(" "), F.date_format("ts", "HH:mm:ss"), F.lit(" "), host, F.lit(" app["), pid, F.lit("]: "), F.col("props"))
    new = F.concat(pri, F.lit("1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), host, F.lit(" app "), pid, F.lit(" - - "), F.col("props"))
    lines = t.select("event_id", "ts", F.when(F.col("event_id") % 2 == 0, old).otherwise(new).alias("line"))
    return lines.select("event_id", S.parse_syslog("line", F.col("ts")).alias("m")).select("event_id", "m.facility", "m.severity", "m.ts", "m.hostname", "m.app", "m.procid", "m.content")


_SNAP = "s as (select asset_id % 20 as host, date_trunc('day', ts) as snap_ts, k % 25 as key, (count(*) % 3)::varchar as value from t group by 1, 2, 3), tm as (select host, snap_ts, lag(snap_ts) over (partition by host order by snap_ts) as prev from (select distinct host, snap_ts from s))"


@query("snapshot_changes", f"{_SNAP}, cur as (select s.* from s join tm using (host, snap_ts) where prev is not null), bef as (select tm.host, tm.snap_ts, s.key, s.value from tm join s on s.host = tm.host and s.snap_ts = tm.prev), j as (select coalesce(c.host, b.host) as host, coalesce(c.snap_ts, b.snap_ts) as snap_ts, coalesce(c.key, b.key) as key, case when b.host is null then 1 when c.host is null then 4 when c.value <> b.value then 3 end as activity, coalesce(c.value, b.value) as value from cur c full join bef b on c.host = b.host and c.snap_ts = b.snap_ts and c.key = b.key) select * from j where activity is not null")
def snapshot_changes(spark, d):
    t = telemetry(spark, d)
    s = t.groupBy((F.col("asset_id") % 20).alias("host"), F.date_trunc("day", "ts").alias("snap_ts"), (F.col("k") % 25).alias("key")).agg((F.count("*") % 3).cast("string").alias("value"))
    return normalise.snapshot_changes(s, ["host"], ["key"], "snap_ts", "value").select("host", "snap_ts", "key", "activity", "value")


@query("appeared_and_gone", "n as (select max(ts) as now from t), a as (select distinct asset_id, exe_path from t, n where exe_path is not null and ts < now - interval 10 day), b as (select distinct asset_id, exe_path from t, n where exe_path is not null and ts >= now - interval 10 day) select asset_id, exe_path, 1 as activity from (select * from b except select * from a) union all select asset_id, exe_path, 4 from (select * from a except select * from b)")
def appeared_and_gone(spark, d):
    t = telemetry(spark, d)
    edge = now_of(t) - F.expr("interval 10 days")
    some = t.where("exe_path is not null")
    new, gone = normalise.appeared_and_gone(some.where(F.col("ts") < edge), some.where(F.col("ts") >= edge), ["asset_id", "exe_path"])
    return new.withColumn("activity", F.lit(1)).unionByName(gone.withColumn("activity", F.lit(4)))


@query("flow_assembly", """p as (select distinct asset_id, dst_ip, ts from t where class_uid = 4001),
r as (select *, sum(n) over (partition by asset_id, dst_ip order by ts) as run from (select *, case when ts - lag(ts) over (partition by asset_id, dst_ip order by ts) < interval 12 hour then 0 else 1 end as n from p)),
nx as (select a.asset_id, a.dst_ip, a.run, a.ts, min(b.ts) as nx from r a left join r b on a.asset_id = b.asset_id and a.dst_ip = b.dst_ip and a.run = b.run and b.ts >= a.ts + interval 5 day group by 1, 2, 3, 4),
op as (select asset_id, dst_ip, run, min(ts) as ts from r group by 1, 2, 3 union all select op.asset_id, op.dst_ip, op.run, nx.nx from op join nx using (asset_id, dst_ip, run, ts) where nx.nx is not null),
f as (select c.asset_id, c.dst_ip, o.ts as first_ts, c.ts, c.k from (select * from t where class_uid = 4001) c asof join op o on c.asset_id = o.asset_id and c.dst_ip = o.dst_ip and c.ts >= o.ts)
select '10.0.' || (asset_id // 250) || '.' || (asset_id % 250) as src_ip, dst_ip, first_ts, max(ts) as last_ts, count(*) as src_packets, sum(100 + k)::bigint as src_bytes from f group by 1, 2, 3""")  # fmt: skip
def flow_assembly(spark, d):
    packets = telemetry(spark, d).where("class_uid = 4001").select("ts", "src_ip", F.lit(40000).alias("sport"), "dst_ip", F.lit(443).alias("dport"), F.lit(6).alias("proto"), F.lit(16).alias("tcp_flags"), (F.col("k") + 100).cast("long").alias("frame_len"))
    out = flows.orient_flow(flows.assemble_flows(packets, HOURS12, timedelta(days=5)))
    return out.select("src_ip", "dst_ip", "first_ts", "last_ts", "src_packets", "src_bytes")


@query("attach_asset_by_ip", "a as (select event_id, dst_ip from t where class_uid = 4001), s as (select asset_id, '10.0.' || (asset_id // 250) || '.' || (asset_id % 250) as ip from (select distinct asset_id from t)) select a.event_id, s.asset_id as dst_asset from a left join s on s.ip = a.dst_ip")
def attach_asset_by_ip(spark, d):
    t = telemetry(spark, d)
    rows = t.where("class_uid = 4001").select("event_id", "dst_ip")
    return normalise.attach_asset_by_ip(rows, assets_of(t), "dst_ip").select("event_id", F.col("asset_id").alias("dst_asset"))


@query("decode_envelopes", "e as (select event_id, case when k % 10 = 3 then 'not JSON' when k % 10 = 5 then 'version' when k % 10 = 7 then 'partition_key' end as reason from t) select coalesce(reason, 'valid') as outcome, count(*) as events from e group by 1")
def decode_envelopes(spark, d):
    from ..schemas import ENVELOPE

    e = events_of(telemetry(spark, d))
    last = F.col("k") % 10
    wire = F.to_json(F.struct(F.when(last == 5, 2).otherwise(1).alias("version"), S.stable_id("event_id").alias("id"), F.when(last == 7, "").otherwise(F.col("asset_id").cast("string")).alias("partition_key"), F.col("ts").alias("timestamp"), "class_uid", F.lit("agent").alias("source"), "raw"))
    good, bad = normalise.decode_envelopes(e.select(F.when(last == 3, F.concat(F.lit("x"), wire)).otherwise(wire).alias("value")), "value", ENVELOPE)
    return good.groupBy().count().select(F.lit("valid").alias("outcome"), F.col("count").alias("events")).unionByName(bad.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("events")))
