"""Queries over source records: the events rendered as what agents, sensors and hosts send, through the normalisers, lists and batches."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..functions.rules import Body, compile_rule
from ..operators import correlate, detect, flows, normalise, sinks, views, windows
from ..sources import readers
from ..streaming import pipeline
from .adapter import HITS, RULES, address, assets_of, events_of, telemetry
from .registry import _ASSIGN, DAY, FIRST, HOURS12, WINDOWED, _R, alerts_of, hits, incidents_of, judged_incidents, now_of, query

_IP = lambda a: f"'10.0.' || ({a} // 250) || '.' || ({a} % 250)"


def _stable_sql(*parts: str) -> str:
    """stable_id in SQL."""
    h = "substr(sha256(" + " || ".join(f"coalesce(({p})::varchar, '') || chr(0)" for p in parts) + "), 1, 32)"
    return f"(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) from (select {h} as h))"


def with_ids(t):
    return t.withColumn("id", F.col("event_id"))


def body_fields(df, **paths: str):
    """Typed columns out of the JSON in raw: name="$.path:type"."""
    v = F.try_parse_json("raw")
    return {name: F.try_variant_get(v, p.rsplit(":", 1)[0], p.rsplit(":", 1)[1]).alias(name) for name, p in paths.items()}


# Agents, sensors, hosts

_AGENT_RAW = "case when k % 10 = 3 then 'bad {' when k % 10 = 4 then '{\"a\":\"x\\u0000y\"}' else '{\"file\":{\"path\":\"/opt/x' || k || '\"}}' end"


@query("agent_events", f"""r as (select *, 'ag' || asset_id as agent_id, epoch_us(ts) * 1000 as ns, {_AGENT_RAW} as raw_json from t)
select {_stable_sql('agent_id', 'ns', 'class_uid', 'guid', "'parent' || k % 3", 'conn_tuple', "case when k % 10 = 3 then '{}' else raw_json end")} as id, case when asset_id % 5 = 0 then agent_id else asset_id::varchar end as partition_key, ts, class_uid, case when asset_id % 5 <> 0 then asset_id end as asset_id, case when asset_id % 5 <> 0 then os end as asset_os,
  case when k % 2 = 0 then lower(substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)) end as process_guid, username, conn_tuple,
  case when class_uid = 1001 and k % 10 not in (3, 4) then '|/opt/x' || k end as fingerprint_suffix, case when k % 10 = 3 then '{{}}' when k % 10 = 4 then '{{"a":"xy"}}' else raw_json end as raw
from (select *, case when k % 2 = 0 then upper(substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)) else 'no guid' end as guid from (select *, md5(event_id::varchar) as m from r))""")  # fmt: skip
def agent_events(spark, d):
    t = telemetry(spark, d)
    raw = F.expr("case when k % 10 = 3 then 'bad {' when k % 10 = 4 then '{\"a\":\"x\\\\u0000y\"}' else concat('{\"file\":{\"path\":\"/opt/x', k, '\"}}') end")
    m = F.upper(F.md5(F.col("event_id").cast("string")))
    guid = F.when(F.col("k") % 2 == 0, F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12))).otherwise("no guid")
    agent = F.concat(F.lit("ag"), F.col("asset_id").cast("string"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    records = t.select(agent.alias("agent_id"), (F.unix_micros("ts") * 1000).alias("ts_unix_ns"), "class_uid", guid.alias("process_guid"), blank("username").alias("username"), blank("conn_tuple").alias("conn_tuple"), raw.alias("raw_json"), F.concat(F.lit("parent"), (F.col("k") % 3).cast("string")).alias("parent_process_guid"), F.lit(0).cast("long").alias("dropped_events"))
    assets = assets_of(t).where("asset_id % 5 <> 0").withColumn("agent_id", agent).withColumn("os", F.initcap("os"))
    return normalise.agent_events(records, assets).select("id", "partition_key", "ts", "class_uid", "asset_id", "asset_os", "process_guid", "username", "conn_tuple", "fingerprint_suffix", "raw")


def flow_records(t):
    none = F.lit("")
    of = lambda rest, value: F.when(F.col("k") % 4 == rest, value).otherwise(none)
    k = F.col("k").cast("string")
    start = F.unix_micros("ts") * 1000
    columns = {
        "start_unix_ns": start, "end_unix_ns": start + F.col("k").cast("long") * 1_000_000, "src_port": F.lit(40000), "protocol": F.when(F.col("k") % 3 == 0, 17).otherwise(6),
        "src_packets": F.lit(2).cast("long"), "src_bytes": F.col("k").cast("long"), "dst_packets": F.lit(1).cast("long"), "dst_bytes": F.lit(100).cast("long"), "tcp_flags": F.lit(18),
        "dns_query": of(0, F.concat(F.lit("q"), k, F.lit(".example"))), "tls_sni": of(1, F.concat(F.lit("s"), k)), "ja3": none, "http_host": of(2, F.concat(F.lit("h"), k)), "http_uri": of(2, F.lit("/x")), "http_user_agent": none, "dns_rcode": F.col("k") % 3,
        "dns_answers": F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lit("1.1.1."), k))), "ja3s": none, "tls_cert_subject": of(1, F.lit("cn")), "tls_cert_issuer": none, "tls_cert_self_signed": F.lit(True), "tls_cert_not_before": none, "tls_cert_not_after": none,
    }
    return t.where("class_uid = 4001").select("src_ip", "dst_ip", "dst_port", *[v.alias(c) for c, v in columns.items()])


_FLOW_RAW = """'{"activity_id":6,' || case when k % 4 = 0 then '"answers":[{"ip":"1.1.1.' || k || '"}],' else '' end || '"connection_info":{"protocol_num":' || case when k % 3 = 0 then 17 else 6 end || ',"tcp_flags":18},"dst_endpoint":{"ip":"' || dst_ip || '","port":' || dst_port || '},"duration_ms":' || k
  || case when k % 4 = 2 then ',"http_request":{"hostname":"h' || k || '","url":{"path":"/x"},"user_agent":""}' else '' end || case when k % 4 = 0 then ',"query":{"hostname":"q' || k || '.example","rcode_id":' || k % 3 || '}' else '' end || ',"src_endpoint":{"ip":"' || src_ip || '","port":40000}'
  || case when k % 4 = 1 then ',"tls":{"cert":{"issuer":"","not_after":"","not_before":"","self_signed":true,"subject":"cn"},"sni":"s' || k || '"}' else '' end || ',"traffic":{"bytes":' || (100 + k) || ',"bytes_in":100,"bytes_out":' || k || ',"packets":3,"packets_in":1,"packets_out":2}}'"""


@query("read_flows", f"""c as (select *, case when k % 3 = 0 then 'udp' else 'tcp' end || ':' || src_ip || ':40000>' || dst_ip || ':' || dst_port as tuple, {_FLOW_RAW} as raw from t where class_uid = 4001)
select {_stable_sql("'sensor'", 'epoch_us(ts) * 1000', 'epoch_us(ts) * 1000 + k::bigint * 1000000', 'tuple', 'raw')} as id, asset_id::varchar as partition_key, ts, case when k % 4 = 0 then 4003 else 4001 end as class_uid, asset_id, os as asset_os, tuple as conn_tuple, raw from c""")  # fmt: skip
def read_flows(spark, d):
    """Whole bodies, with names in order, and ids over all of them."""
    t = telemetry(spark, d)
    return normalise.read_flows(flow_records(t), assets_of(t)).select("id", "partition_key", "ts", "class_uid", "asset_id", "asset_os", "conn_tuple", "raw")


@query("read_syslog", f"""l as (select *, case when k % 3 = 0 then 'nobody' else 'HOST' || asset_id end as host from t)
select {_stable_sql("'syslog'", 'host', "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "'app'", '(k + 1)::varchar', 'event_id')} as id, event_id, date_trunc('second', ts) as ts, (k + 10) % 8 as severity_id, (k + 10) // 8 as facility, 'app' as app, (k + 1)::varchar as pid, case when k % 2 = 0 then 'ID' || k else '' end as log_name, host as hostname,
  case when k % 3 = 0 and k % 2 = 0 then null else asset_id end as asset_id, case when k % 3 = 0 and k % 2 = 0 then 'nobody' else asset_id::varchar end as partition_key from l""")  # fmt: skip
def read_syslog(spark, d):
    """Hosts are known by name in any case, else by address, else neither. Every line comes twice, an hour apart: both have one id."""
    t = telemetry(spark, d)
    host = F.when(F.col("k") % 3 == 0, "nobody").otherwise(F.concat(F.lit("HOST"), F.col("asset_id").cast("string")))
    message_id = F.when(F.col("k") % 2 == 0, F.concat(F.lit("ID"), F.col("k").cast("string"))).otherwise("-")
    line = F.concat(F.lit("<"), (F.col("k") + 10).cast("string"), F.lit(">1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), host, F.lit(" app "), (F.col("k") + 1).cast("string"), F.lit(" "), message_id, F.lit(" - "), F.col("event_id").cast("string"), F.lit("\r\n"))
    lines = t.select(line.alias("line"), F.when(F.col("k") % 2 == 0, "192.168.0.1").otherwise(address(F.col("asset_id"))).alias("from_ip"), F.explode(F.array(F.col("ts"), F.col("ts") + F.expr("interval 1 hour"))).alias("received_at"))
    out = normalise.read_syslog(lines, assets_of(t)).dropDuplicates(["id"])
    f = body_fields(out, event_id="$.message:bigint", severity_id="$.severity_id:int", facility="$.facility:int", app="$.metadata.product.name:string", pid="$.actor.process.pid:string", log_name="$.metadata.log_name:string", hostname="$.device.hostname:string")
    return out.select("id", "ts", "asset_id", "partition_key", *f.values())


def _xml(event, fields):
    data = F.concat(*[F.concat(F.lit(f"<Data Name='{name}'>"), F.coalesce(value.cast("string"), F.lit("")), F.lit("</Data>")) for name, value in fields.items()])
    return F.concat(F.lit("<Event><System><EventID>"), event.cast("string"), F.lit("</EventID><Execution ProcessID='77'/></System><EventData>"), data, F.lit("</EventData></Event>"))


@query("windows_events", """w as (select event_id as source_event, case when status_id = 2 then 4625 when status_id = 1 then 4624 when class_uid in (1001, 1007) then 4104 when class_uid = 4001 then [4720, 4732, 1102, 4648, 4719][1 + k % 5] else 1 end as event_id, coalesce(username, 'who' || k) || case when k % 9 = 0 then '$' else '' end as username, k % 6 as logon_type, exe_path, k from t)
select source_event, event_id, case event_id when 4104 then 1007 else 3002 end as class_uid, case event_id when 4104 then null when 4732 then case when k % 2 = 0 then '' else 'CN=m' || k end when 1102 then 'by' || k when 4719 then 'by' || k else username end as username,
  case event_id when 4625 then 2 when 4104 then null else 1 end as status_id, case event_id when 4624 then 1 when 4625 then 1 when 4720 then 10 when 4732 then 12 when 1102 then 13 when 4648 then 14 when 4719 then 15 else 1 end as activity_id, case when event_id in (4624, 4625) then 'logon-type-' || logon_type end as service, case event_id when 4732 then username end as group_name,
  case when event_id in (4720, 4732, 4648) then 'by' || k end as actor_user, case event_id when 1102 then true end as log_cleared, case event_id when 4648 then 'srv' end as target_server, case event_id when 4719 then 'c1' end as policy_category, case event_id when 4625 then '0xC000006A' end as status_code, case when event_id = 4104 then exe_path end as cmd_line, case when event_id = 4104 then 77 end as pid
from w where event_id <> 1 and not (event_id in (4624, 4625, 4720, 4648) and k % 9 = 0) and not (event_id = 4624 and logon_type in (0, 5)) and not (event_id = 4104 and k % 10 = 0)""")  # fmt: skip
def windows_events(spark, d):
    """Machine accounts, service logons and empty blocks are left out; a change of a group is about its new member."""
    t = telemetry(spark, d)
    k = F.col("k")
    others = F.element_at(F.array(*[F.lit(x) for x in (4720, 4732, 1102, 4648, 4719)]), (k % 5 + 1).cast("int"))
    event = F.when(F.col("status_id") == 2, 4625).when(F.col("status_id") == 1, 4624).when(F.col("class_uid").isin(1001, 1007), 4104).when(F.col("class_uid") == 4001, others).otherwise(1)
    user = F.concat(F.coalesce("username", F.concat(F.lit("who"), k.cast("string"))), F.when(k % 9 == 0, "$").otherwise(""))
    member = F.when(k % 2 == 0, "-").otherwise(F.concat(F.lit("CN=m"), k.cast("string")))
    script = F.when(k % 10 == 0, "  ").otherwise(F.col("exe_path"))
    fields = {"TargetUserName": user, "LogonType": k % 6, "IpAddress": F.lit("-"), "MemberName": member, "SubjectUserName": F.concat(F.lit("by"), k.cast("string")), "TargetServerName": F.lit("srv"), "CategoryId": F.lit("c1"), "Status": F.when(event == 4625, "0xC000006A").otherwise("")}
    xml = F.when(event == 4104, _xml(event, {"ScriptBlockText": script, "MessageNumber": F.lit(1)})).otherwise(_xml(event, fields))
    out = normalise.windows_events(t.select(F.col("event_id").cast("string").alias("agent_id"), "ts", xml.alias("xml")))
    text = {c: f"$.{c}:string" for c in ("group_name", "actor_user", "target_server", "policy_category", "status_code")}
    f = body_fields(out, status_id="$.status_id:int", activity_id="$.activity_id:int", service="$.service.name:string", log_cleared="$.log_cleared:boolean", cmd_line="$.process.cmd_line:string", pid="$.process.pid:int", **text)
    return out.select(F.col("agent_id").cast("long").alias("source_event"), "event_id", "class_uid", "username", *f.values())


@query("login_records", "l as (select ts, username, status_id, 'tty' || (k % 5) as terminal, case when k % 2 = 0 then src else '' end as ip from (select *, '10.1.1.' || k as src from t where class_uid = 3002)) select * from l")
def login_records(spark, d):
    t = telemetry(spark, d).where("class_uid = 3002")
    rows = t.select("ts", F.col("username").alias("user"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("10.1.1."), F.col("k").cast("string"))).otherwise("").alias("host"), F.concat(F.lit("tty"), (F.col("k") % 5).cast("string")).alias("line"), (F.col("status_id") == 2).alias("failure"))
    out = normalise.login_records(rows)
    return out.select("ts", "username", *body_fields(out, status_id="$.status_id:int", terminal="$.service.name:string", ip="$.src_endpoint.ip:string").values())


@query("process_body", "p as (select event_id, 1 + k % 2 as activity_id, k as pid, exe_path as path, 'bin' || (k % 20) as name, case when k % 3 = 0 then 'u' end as user_name, case when k % 2 = 0 then k + 1 end as parent_pid, case when k % 2 = 0 then '/sbin/init' end as parent_path from t where exe_path is not null) select * from p")
def process_body(spark, d):
    k = F.col("k")
    rows = telemetry(spark, d).where("exe_path is not null").select("event_id", (k % 2 + 1).alias("activity"), k.alias("pid"), F.col("exe_path").alias("path"), F.lit("").alias("cmd_line"), F.lit("").alias("sha256"), F.when(k % 3 == 0, "u").otherwise("").alias("user"), (k + 1).alias("parent_pid"), F.lit("/sbin/init").alias("parent_path"), F.lit("").alias("parent_cmd_line"))
    b = F.col("body")
    return normalise.process_body(rows).select("event_id", b["activity_id"].alias("activity_id"), b["process"]["pid"].alias("pid"), b["process"]["file"]["path"].alias("path"), b["process"]["file"]["name"].alias("name"), b["actor"]["user"]["name"].alias("user_name"), b["process"]["parent_process"]["pid"].alias("parent_pid"), b["process"]["parent_process"]["file"]["path"].alias("parent_path"))


@query("conn_body", "c as (select event_id, k as pid, case when k % 3 = 0 then 'udp' else 'tcp' end as protocol_name, src_ip, dst_ip, dst_port, 'outbound' as direction from t where class_uid = 4001) select * from c")
def conn_body(spark, d):
    rows = telemetry(spark, d).where("class_uid = 4001").select("event_id", F.col("k").alias("pid"), F.lit("/x").alias("path"), F.when(F.col("k") % 3 == 0, 17).otherwise(6).alias("protocol"), "src_ip", F.lit(1).alias("src_port"), "dst_ip", "dst_port")
    b = F.col("body")
    return normalise.conn_body(rows).select("event_id", b["process"]["pid"].alias("pid"), b["connection_info"]["protocol_name"].alias("protocol_name"), b["src_endpoint"]["ip"].alias("src_ip"), b["dst_endpoint"]["ip"].alias("dst_ip"), b["dst_endpoint"]["port"].alias("dst_port"), b["connection_info"]["direction"].alias("direction"))


@query("change_body", """c as (select event_id, ['registry', 'file', 'module', 'service', 'wmi'][1 + k % 5] as kind, 'key' || k as key, case when k % 3 = 0 then null else 'v' || k end as value, 'o' || k as old_value, 1 + k % 3 as activity from t)
select event_id, case kind when 'registry' then 201002 when 'file' then 1001 when 'wmi' then 1001 when 'module' then 1005 else 100001 end as class_uid, activity as activity_id, key, case kind when 'file' then value when 'module' then value else coalesce(value, old_value) end as data from c""")  # fmt: skip
def change_body(spark, d):
    k = F.col("k")
    rows = telemetry(spark, d).select("event_id", F.get(F.array(*[F.lit(x) for x in ("registry", "file", "module", "service", "wmi")]), (k % 5).cast("int")).alias("kind"), F.concat(F.lit("key"), k.cast("string")).alias("key"), F.when(k % 3 != 0, F.concat(F.lit("v"), k.cast("string"))).alias("value"), F.concat(F.lit("o"), k.cast("string")).alias("old_value"), (k % 3 + 1).alias("activity"))
    out = normalise.change_body(rows)
    v = F.try_parse_json("raw")
    at = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    return out.select("event_id", "class_uid", F.try_variant_get(v, "$.activity_id", "int").alias("activity_id"), at("$.reg_key.path", "$.file.path", "$.module.file.path", "$.name").alias("key"), at("$.reg_value.data", "$.file.sha256", "$.module.base_address", "$.wmi.data", "$.data").alias("data"))


# Rules

_MORE_RULES = [
    {"id": "m-all", "logsource": {"category": "process_creation"}, "detection": {"s": {"Image|contains|all": ["BIN", "1"]}, "condition": "s"}},
    {"id": "m-null", "logsource": {"product": "linux"}, "detection": {"s": {"User": None}, "f": {"DestinationPort": [443, 4444]}, "condition": "s and not f"}},
    {"id": "m-re", "logsource": {"category": "dns_query"}, "detection": {"s": {"QueryName|re": r"^[a-z]+\d+\.EXAMPLE\.(org|net)$"}, "condition": "s"}},
    {"id": "m-two", "logsource": {"category": "process_creation"}, "detection": {"a1": {"Image|endswith": "1?"}, "a2": {"Image|contains": "app"}, "b": {"Image": "*bin2*"}, "condition": "2 of a* or all of b*"}},
]


@query("match_more_rules", r"""m as (select event_id, 'm-all' as rule_id from t where class_uid = 1007 and contains(exe_path, 'bin') and contains(exe_path, '1')
union all select event_id, 'm-null' from t where os = 'linux' and username is null and coalesce(dst_port, 0) not in (443, 4444)
union all select event_id, 'm-re' from t where class_uid = 4003 and regexp_matches(lower(hostname), '^[a-z]+[0-9]+\.example\.(org|net)$')
union all select event_id, 'm-two' from t where class_uid = 1007 and (regexp_matches(exe_path, '1.$') or contains(exe_path, 'bin2'))) select * from m""")  # fmt: skip
def match_more_rules(spark, d):
    """`all`, null, `re`, wildcards and counted selections over the nested bodies."""
    return detect.match_rules(events_of(telemetry(spark, d)), [compile_rule(r) for r in _MORE_RULES], None, ("event_id",), os="os").select("event_id", "rule_id")


@query("match_many_rules", "m as (select event_id, 'n' || r.i as rule_id, 3 as severity from t, range(500) r(i) where class_uid = 1007 and k = r.i % 100 and (r.i // 100) <> k % 7) select * from m")
def match_many_rules(spark, d):
    """Five hundred rules over the nested bodies: each body is parsed once."""
    t = events_of(telemetry(spark, d))
    body = F.concat(F.lit('{"process":{"pid":'), F.col("k").cast("string"), F.lit(',"integrity":"level'), (F.col("k") % 7).cast("string"), F.lit('"}}'))
    some = [{"id": f"n{i}", "logsource": {"category": "process_creation"}, "detection": {"s": {"ProcessId": i % 100}, "f": {"IntegrityLevel|endswith": f"l{i // 100}"}, "condition": "s and not f"}} for i in range(500)]
    return detect.match_rules(t.withColumn("raw", body), [compile_rule(r) for r in some], None, ("event_id",)).select("event_id", "rule_id", "severity")


_MIXED = """c as (select *, 'run --job ' || k || ' as u' || (asset_id % 50) as line from t where class_uid = 1007),
m as (select event_id, 'm' || r.i as rule_id from c, range(2000) r(i) where case r.i % 8
  when 0 then k = r.i // 8 when 1 then contains(line, '--job ' || (r.i // 8) || ' ') when 2 then starts_with(line, 'run --job ' || (r.i // 8) || ' ') when 3 then ends_with(line, ' as u' || (r.i // 8))
  when 4 then k < 10 and ends_with(line, ' as u' || (r.i // 8)) when 5 then k = r.i // 8 and asset_id % 50 < 10
  when 6 then ends_with(exe_path, 'bin' || (r.i // 8)) and k % 7 <> 3
  else (k = r.i // 8 and k % 7 = (r.i // 8) % 7) or (contains(line, 'job ' || (r.i // 8)) and ends_with(line, 'u' || ((r.i // 8) % 50))) end) select * from m"""


@query("match_mixed_rules", _MIXED)
def match_mixed_rules(spark, d):
    """Two thousand rules of all kinds of tests; which of them an event is held against, an index of their literals says."""
    t = events_of(telemetry(spark, d))
    line = F.concat(F.lit("run --job "), F.col("k").cast("string"), F.lit(" as u"), (F.col("asset_id") % 50).cast("string"))
    level = F.concat(F.lit("level"), (F.col("k") % 7).cast("string"))
    body = F.to_json(F.struct(F.struct(F.col("k").alias("pid"), level.alias("integrity"), line.alias("cmd_line"), F.struct(F.col("exe_path").alias("path")).alias("file")).alias("process")))

    def detection(i: int) -> dict:
        n = i // 8
        return (
            {"s": {"ProcessId": n}, "condition": "s"},
            {"s": {"CommandLine|contains": f"--JOB {n} "}, "condition": "s"},
            {"s": {"CommandLine|startswith": [f"run --job {n} ", "never"]}, "condition": "s"},
            {"s": {"CommandLine|endswith": f" as u{n}"}, "condition": "all of them"},
            {"s": {"CommandLine": f"run --job ? as u{n}"}, "condition": "s"},
            {"s": {"CommandLine|re": f"job {n} as u[0-9]$"}, "condition": "s"},
            {"s": {"Image|endswith": f"bin{n}"}, "f": {"IntegrityLevel": "level3"}, "condition": "s and not f"},
            {"s1": {"ProcessId": n, "IntegrityLevel": f"Level{n % 7}"}, "s2": {"CommandLine|contains": f"job {n}", "CommandLine|endswith": f"u{n % 50}"}, "condition": "1 of s*"},
        )[i % 8]

    some = [compile_rule({"id": f"m{i}", "logsource": {"category": "process_creation"}, "detection": detection(i)}) for i in range(2000)]
    return detect.match_rules(t.withColumn("raw", body), some, None, ("event_id",)).select("event_id", "rule_id")


@query("flatten_scalars", "@select conv_id, turn, md5(role || chr(10) || text || chr(10) || turn) as flat from conversations where text is not null and role is not null")
def flatten_scalars(spark, d):
    """The scalars of a nested body, strings first, of every turn."""
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null and role is not null")
    raw = F.to_json(F.struct(F.struct(F.col("role").alias("name")).alias("actor"), F.array("text").alias("lines"), F.col("turn").alias("count")))
    return c.select("conv_id", "turn", F.md5(R.flatten_scalars(raw)).alias("flat"))


@query("suppression_of_asset", f"{HITS} select rule_id, count(*) filter (asset_id % 3 = 0) as quiet, count(*) filter (asset_id % 3 <> 0) as loud from hits group by 1")
def suppression_of_asset(spark, d):
    """Every third asset is suppressed for every rule."""
    t = telemetry(spark, d)
    hits = detect.match_rules(with_ids(t), _R, _fields(), ("event_id", "asset_id"), raw=None, os="os")
    rules = detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df.select("rule_id")
    some = t.select("asset_id").distinct().where("asset_id % 3 = 0").crossJoin(F.broadcast(rules)).select(F.concat_ws("-", "rule_id", F.col("asset_id").cast("string")).alias("id"), F.lit(None).cast("timestamp").alias("created_at"), "rule_id", "asset_id", F.lit(None).cast("timestamp").alias("expires_at"))
    loud, quiet = detect.apply_suppressions(hits, some)
    both = loud.select("rule_id", F.lit(0).alias("q")).unionByName(quiet.select("rule_id", F.lit(1).alias("q")))
    return both.groupBy("rule_id").agg(F.sum("q").alias("quiet"), F.sum(1 - F.col("q")).alias("loud"))


def _fields():
    from .registry import FIELDS

    return FIELDS()


@query("rule_load_report", "p as (select event_id % 8 as r from t) select count(*) as total, count(*) filter (r in (1, 2, 3, 5, 7)) as loaded, count(*) filter (r in (2, 3, 5, 7)) as live, round(count(*) filter (r in (1, 2, 3, 5, 7)) / count(*)::double, 6) as rate from p")
def rule_load_report(spark, d):
    """A rule for each event, compiled in tasks: some can't be read, some have a class without a source, some have the id of a stored rule."""
    t = telemetry(spark, d)
    n = F.col("event_id") % 8
    field = F.when(n == 0, "Image|cidr").otherwise("Image")
    text = F.concat(F.lit('{"id":"n'), F.col("event_id").cast("string"), F.lit('","logsource":{"category":"'), F.when(n == 1, "proxy").otherwise("process_creation"), F.lit('"},"detection":{"s":{"'), field, F.lit('":"x"},"condition":"s"}}'))
    sources = t.select(F.col("event_id").cast("string").alias("name"), F.when(n == 4, "{no JSON").otherwise(text).alias("rule"))
    stored = t.where(n == 6).select(F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("rule_id"))
    return detect.rule_load_report(detect.check_rules(sources, stored))[0].select("total", "loaded", "live", F.round("rate", 6).alias("rate"))


@query("corpus_report", f"{HITS}, c as (select t.event_id, class_uid = 3002 as auth, bool_or(coalesce(h.rule_id in ('r-tool', 'r-fail'), false)) as found from (select event_id, class_uid from t) t left join hits h using (event_id, class_uid) group by 1, 2) select count(*) filter (found) as detected, 0::bigint as known_gap, count(*) filter (not found) as mismatch, count(distinct auth) filter (found) as covered, count(distinct auth) as techniques from c")
def corpus_report(spark, d):
    t = events_of(telemetry(spark, d))
    technique = F.when(F.col("class_uid") == 3002, "T1110.003").otherwise("T1059.001")
    cases = t.select(F.col("event_id").cast("string").alias("name"), F.lit("").alias("case_name"), technique.alias("technique"), "class_uid", "os", F.col("raw").alias("event"), F.lit("detected").alias("expect"))
    return detect.corpus_report(detect.replay_corpus(cases, detect.rule_set(spark, [(r["id"], r) for r in RULES])))


@query("attack_totals", "r as (values ('reconnaissance', 0, 0), ('command-and-control', 2, 2), ('execution', 1, 1), ('persistence', 1, 1), ('credential-access', 1, 1)) select col0 as tactic, col1::bigint as techniques, col2::bigint as rules, (select count(*) from t) as events from r")
def attack_totals(spark, d):
    rules = detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df
    _, totals, _ = detect.attack_coverage(rules, ["reconnaissance", "command-and-control", "execution", "persistence", "credential-access"])
    return totals.select("tactic", "techniques", "rules").crossJoin(telemetry(spark, d).agg(F.count("*").alias("events")))


# Scalars


@query("ja3_hashes", "j as (select event_id, md5('771,' || k || '-' || (k + 1) || ',' || k || ',29,0') as ja3, md5('771,' || k || ',' || (k + 2)) as ja3s from t) select * from j")
def ja3_hashes(spark, d):
    k = F.col("k")
    grease = F.lit(0x1A1A)
    return telemetry(spark, d).select("event_id", S.ja3(F.lit(771), F.array(grease, k, k + 1), F.array(k, grease), F.array(F.lit(29), grease), F.array(F.lit(0))).alias("ja3"), S.ja3s(F.lit(771), k, F.array(grease, k + 2)).alias("ja3s"))


@query("http_heads", "@with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) as host from pages) select page_id, case page_id % 3 when 0 then 'GET' else 'POST' end as method, '/p/' || page_id || '?q=1' as uri, nullif(host, '') as host, case when page_id % 2 = 0 then 'agent ' || page_id end as user_agent from p where page_id % 5 <> 0")
def http_heads(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    n = F.col("page_id").cast("string")
    head = F.concat(F.when(F.col("page_id") % 3 == 0, "GET").otherwise("POST"), F.lit(" /p/"), n, F.lit("?q=1 HTTP/1.1\r\nHost: "), F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("\r\nUSER-AGENT:  agent "), n)).otherwise(""), F.lit("\r\n\r\n"), F.col("html"))
    return p.select("page_id", S.http_head(F.when(F.col("page_id") % 5 == 0, F.col("html")).otherwise(head)).alias("h")).where("h is not null").select("page_id", "h.method", "h.uri", "h.host", "h.user_agent")


@query("wmi_items", "w as (select event_id, 'a' || k as name from t union all select event_id, 'b' from t where k % 2 = 0) select * from w")
def wmi_items(spark, d):
    name = F.concat(F.lit('{"Name":"a'), F.col("k").cast("string"), F.lit('","Q":1}'))
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("["), name, F.lit(',{"Q":2},{"Name":"b"},{"Name":""}]'))).otherwise(name)
    return telemetry(spark, d).select("event_id", F.explode(S.wmi_items(text)).alias("i")).select("event_id", "i.name")


@query("graph_labels", "g as (select event_id, case when class_uid = 4003 then coalesce('DNS ' || nullif(hostname, ''), 'connection') when class_uid = 4001 then dst_ip || ':' || dst_port when k % 3 = 0 then 'process' when k % 3 = 1 then 'bin' || k else 'bin' || k || ' (' || k || ')' end as label from t) select * from g")
def graph_labels(spark, d):
    """What each event's node is called."""
    e = events_of(telemetry(spark, d))
    k = F.col("k").cast("string")
    process = F.when(F.col("k") % 3 == 0, F.lit("{}")).when(F.col("k") % 3 == 1, F.concat(F.lit('{"process":{"name":"bin'), k, F.lit('"}}'))).otherwise(F.concat(F.lit('{"process":{"name":"bin'), k, F.lit('","pid":'), k, F.lit("}}")))
    raw = F.when(F.col("class_uid").isin(4001, 4003), F.col("raw")).otherwise(process)
    return e.select("event_id", correlate.graph_label(F.col("class_uid"), raw).alias("label"))


@query("shards", "s as (select distinct asset_id from t) select count(*) as assets, 1 as shards_of_each from s")
def shards(spark, d):
    """Every asset has one of eight shards, whatever the event."""
    s = telemetry(spark, d).select("asset_id", S.shard_of(F.col("asset_id"), 8).alias("shard")).groupBy("asset_id").agg(F.count_distinct("shard").alias("n"), F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    return s.agg(F.count("*").alias("assets"), F.max(F.when((F.col("lo") >= 0) & (F.col("hi") < 8), F.col("n")).otherwise(99)).cast("int").alias("shards_of_each"))


@query("client_side", "c as (select event_id, k % 3 as r, src_ip, dst_ip, 40000 + event_id as port from t where class_uid = 4001) select event_id, case when r = 1 then dst_ip else src_ip end as src_ip, case when r = 1 then 443 else port end as src_port, (case when r = 1 then 0 else 1 end)::bigint as src_packets, (case when r = 1 then 1 else 0 end)::bigint as dst_packets, case r when 0 then 2 when 1 then 18 else 16 end as tcp_flags from c")
def client_side(spark, d):
    """One packet a flow, seen from either side: who began is told by its flags; the server name is the first that is not null."""
    r = F.col("k") % 3
    packets = telemetry(spark, d).where("class_uid = 4001").select("ts", "src_ip", (F.col("event_id") + 40000).alias("sport"), "dst_ip", F.lit(443).alias("dport"), F.lit(6).alias("proto"), F.when(r == 0, 2).when(r == 1, 18).otherwise(16).alias("tcp_flags"), F.lit(60).cast("long").alias("frame_len"), F.col("event_id").alias("seen"))
    out = flows.orient_flow(flows.assemble_flows(packets, timedelta(days=99), timedelta(days=99), meta=("seen",)), ("seen",))
    return out.select(F.col("seen").alias("event_id"), "src_ip", "src_port", "src_packets", "dst_packets", "tcp_flags")


_SIX = """v as (select event_id, ts, asset_id, lpad(to_hex(asset_id), 4, '0') as g, k from t where class_uid = 4001)"""


@query("addresses_six", f"""{_SIX} select event_id, lower('20010db80000000000000000' || g || lpad(to_hex(k), 4, '0')) as number, case when asset_id = 0 then '2001:db8::' else '2001:db8::' || lower(to_hex(asset_id)) || ':' end || lower(to_hex(k)) as spelled, case when k % 4 = 3 then '10.0.0.' || k else 'none' end as mapped from v""")
def addresses_six(spark, d):
    """IPv6 addresses in four spellings: one number, one text; addresses of IPv4 inside them are those of IPv4."""
    t = telemetry(spark, d).where("class_uid = 4001")
    g, k = F.lower(F.hex("asset_id")), F.lower(F.hex("k"))
    long = F.concat(F.lit("2001:0DB8:0:0:0000:0:"), F.lpad(g, 4, "0"), F.lit(":"), F.upper(F.lpad(k, 4, "0")))
    given = F.when(F.col("k") % 3 == 0, long).when(F.col("k") % 3 == 1, F.concat(F.lit("2001:db8::"), g, F.lit(":"), k)).otherwise(F.concat(F.lit("2001:DB8:0::"), g, F.lit(":"), k, F.lit("%eth0")))
    mapped = F.when(F.col("k") % 4 == 3, F.concat(F.lit("::FFFF:10.0.0."), F.col("k").cast("string"))).otherwise("none")
    return t.select("event_id", S.ip_hex(given).alias("number"), S.ip_text(given).alias("spelled"), S.ip_text(mapped).alias("mapped"))


@query("flows_six", f"{_SIX} select '2001:db8::' || lower(to_hex(asset_id + 1)) as src_ip, '2001:db8::ffff:1' as dst_ip, count(*) as src_packets from v group by asset_id")
def flows_six(spark, d):
    """Packets whose ends are spelled in two ways are one flow. A host of more than four digits fits no group: such an end is no address, but a name with one spelling."""
    t = telemetry(spark, d).where("class_uid = 4001")
    host = F.lower(F.hex(F.col("asset_id") + 1))
    src = F.when((F.col("k") % 2 == 0) | (F.length(host) > 4), F.concat(F.lit("2001:db8::"), host)).otherwise(F.concat(F.lit("2001:0db8:0:0:0:0:0:"), F.lpad(host, 4, "0")))
    dst = F.when(F.col("k") % 3 == 0, "2001:DB8:0:0:0:0:FFFF:1").otherwise("2001:db8::ffff:0001")
    packets = t.select("ts", src.alias("src_ip"), F.lit(40000).alias("sport"), dst.alias("dst_ip"), F.lit(443).alias("dport"), F.lit(6).alias("proto"), F.lit(16).alias("tcp_flags"), F.lit(60).cast("long").alias("frame_len"))
    return flows.orient_flow(flows.assemble_flows(packets, timedelta(days=99), timedelta(days=999))).select("src_ip", "dst_ip", (F.col("src_packets") + F.col("dst_packets")).alias("src_packets"))


# Lists, details, sources


@query("read_events", "n as (select max(ts) as now from t) select event_id, ts, class_uid from t, n where ts >= now - interval 10 day and ts <= now - interval 2 day and class_uid in (1007, 4003)")
def read_events(spark, d):
    """Stored by date and class, read back by time and class."""
    t = events_of(telemetry(spark, d))
    path = sinks.scratch(spark, "events")
    rows = t.select(F.col("event_id").cast("string").alias("id"), "ts", "class_uid", F.lit("agent").alias("source"), F.col("asset_id").cast("string").alias("asset_id"), "process_guid", "parent_process_guid", "username", "conn_tuple", "raw")
    sinks.write_events_idempotent(rows, path)
    now = now_of(t)
    found = readers.read_events(spark, path, now - F.expr("interval 10 days"), now - F.expr("interval 2 days"), (1007, 4003))
    return found.select(F.col("id").cast("long").alias("event_id"), "ts", "class_uid")


@query("event_rows", "e as (select event_id as id, ts, class_uid, asset_id, username, conn_tuple, case when length(props) > 9 then substr(props, 1, 9) || '…' else props end as raw from t) select * from e")
def event_rows(spark, d):
    t = with_ids(telemetry(spark, d)).withColumns({"source": F.lit("agent"), "raw": F.col("props")})
    rows = views.list_rows(t, "events")
    brief = views.event_brief(rows, 9).select("id", "raw")
    return rows.drop("raw").join(brief, "id").select("id", "ts", "class_uid", "asset_id", "username", "conn_tuple", "raw")


@query("rule_rows", f"{HITS}, r(rule_id, severity, source, ingested) as (values ('r-port', 4, 'network activity', true), ('r-name', 3, 'dns activity', true), ('r-tool', 2, 'process activity', true), ('r-file', 5, 'file activity', true), ('r-fail', 1, 'authentication', true)) select r.*, (select count(*) from hits h where h.rule_id = r.rule_id) as hits from r")
def rule_rows(spark, d):
    rules = views.rule_listing(views.rule_rows(detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df))
    counts = detect.match_rules(with_ids(telemetry(spark, d)), _R, _fields(), ("event_id",), raw=None, os="os").groupBy("rule_id").agg(F.count("*").alias("hits"))
    return rules.join(counts, "rule_id", "left").select("rule_id", "severity", "source", "ingested", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("assets_by_hostname", "a as (select asset_id as id, 'host' || asset_id as hostname, max(os) as os, min(ts) as first_seen, max(ts) as last_seen from t group by 1) select * from a")
def assets_by_hostname(spark, d):
    return views.assets_by_hostname(assets_of(telemetry(spark, d))).select("id", "hostname", "os", "first_seen", "last_seen")


@query("incident_summary", f"{HITS}, {WINDOWED}, i as (select distinct asset_id as id from t) select i.id, case when i.id % 5 = 0 then 'closed' else 'open' end as status, count(a.id) as alerts, coalesce(max(severity), 0) as severity from i left join alerts a on a.asset_id = i.id group by 1, 2")
def incident_summary(spark, d):
    """Each asset as one incident."""
    t, alerts = alerts_of(spark, d)
    incidents = t.select(F.col("asset_id").alias("id")).distinct().withColumns({"created_at": F.lit(None).cast("timestamp"), "status": F.when(F.col("id") % 5 == 0, "closed").otherwise("open"), "title": F.lit(None).cast("string"), "ai_verdict": F.lit(None).cast("string")})
    return views.incident_summary(incidents, alerts.withColumn("incident_id", F.col("asset_id"))).select("id", "status", "alerts", "severity")


@query("alerts_with_event_asset", f"{HITS}, {WINDOWED} select a.id, a.rule_id, t.class_uid, t.process_guid, t.parent_process_guid, t.conn_tuple, 'host' || a.asset_id as hostname from alerts a join t on t.event_id = a.id")
def alerts_with_event_asset(spark, d):
    t, alerts = alerts_of(spark, d)
    own = alerts.select("id", F.col("id").alias("event_id"), "rule_id", "asset_id")
    return views.alerts_with_event_asset(own, events_of(t), assets_of(t)).select("id", "rule_id", "class_uid", "process_guid", "parent_process_guid", "conn_tuple", "hostname")


@query("incident_alerts", f"{HITS}, {WINDOWED}, r as (select *, row_number() over (partition by asset_id order by ts, id) as position from alerts) select r.asset_id as incident_id, position, r.ts, r.last_ts, r.count, r.severity, t.props as evidence from r join t on t.event_id = r.id where position <= 4")
def incident_alerts(spark, d):
    t, alerts = alerts_of(spark, d)
    own = alerts.withColumns({"event_id": F.col("id"), "incident_id": F.col("asset_id")})
    rules = detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df
    return views.incident_alerts(own, with_ids(t).withColumn("raw", F.col("props")), rules, 4).select("incident_id", "position", "ts", "last_ts", "count", "severity", "evidence")


def commands_of(t):
    """Program starts as commands: sent, or answered."""
    bought = t.where("exe_path is not null")
    status = F.when(F.col("k") % 3 == 0, "sent").otherwise("done")
    return bought.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.lit("isolate").alias("kind"), status.alias("status"), F.lit(False).alias("dry_run"), "asset_id", F.when(F.col("k") % 2 == 0, F.col("asset_id")).alias("incident_id"), F.lit("auto").alias("issued_by"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("timestamp").alias("completed_at"))


_COMMANDS = "cmd as (select event_id as id, ts as created_at, case when k % 3 = 0 then 'sent' else 'done' end as status, asset_id, case when k % 2 = 0 then asset_id end as incident_id, k from t where exe_path is not null)"


@query("incident_commands", f"{_COMMANDS} select incident_id, row_number() over (partition by incident_id order by created_at, id)::int as position, created_at, status, '' as detail from cmd where incident_id is not null")
def incident_commands(spark, d):
    return views.incident_commands(commands_of(telemetry(spark, d))).select("incident_id", "position", "created_at", "status", "detail")


@query("pending_commands", f"{_COMMANDS} select id, asset_id, 'ag' || asset_id as agent_id from cmd where status = 'sent' and asset_id % 5 <> 0")
def pending_commands(spark, d):
    t = telemetry(spark, d)
    assets = assets_of(t).where("asset_id % 5 <> 0").select("id", F.concat(F.lit("ag"), F.col("id").cast("string")).alias("agent_id"))
    return views.pending_commands(commands_of(t), assets).select("id", "asset_id", "agent_id")


@query("apply_command_results", f"{_COMMANDS} select id, case when k % 4 = 0 then 'failed' when k % 4 = 1 then 'done' else status end as status, case when k % 4 in (0, 1) then 'last' end as detail from cmd")
def apply_command_results(spark, d):
    """Two answers for some commands, of which the last counts; an unknown status is a failure; answers to unknown commands are left out."""
    t = telemetry(spark, d)
    r = F.col("k") % 4
    answer = lambda status, detail, late: t.where(r.isin(0, 1)).select(F.col("event_id").alias("id"), status.alias("status"), F.lit(detail).alias("detail"), (F.col("ts") + F.expr(f"interval {late} minutes")).alias("ts"))
    results = answer(F.lit("done"), "first", 1).unionByName(answer(F.when(r == 0, "weird").otherwise("done"), "last", 2))
    return views.apply_command_results(commands_of(t), results).select("id", "status", "detail")


@query("status_changes", f"{HITS}, {WINDOWED} select id, case when id % 3 = 0 then 'closed' when id % 3 = 1 then 'triaged' else 'false_positive' end as status from alerts")
def status_changes(spark, d):
    """Triaged incidents: some are closed, some set to a status that analysts can't set, some changed twice."""
    _, alerts = alerts_of(spark, d)
    incidents = alerts.select("id", F.lit("triaged").alias("status"))
    r = F.col("id") % 3
    first = alerts.select("id", F.when(r == 0, "open").when(r == 1, "triaged").otherwise("closed").alias("status"), "ts")
    second = alerts.select("id", F.when(r == 0, "closed").when(r == 1, "resolved").otherwise("false_positive").alias("status"), (F.col("ts") + F.expr("interval 1 minute")).alias("ts"))
    unknown = alerts.select((-1 - F.col("id")).alias("id"), F.lit("closed").alias("status"), "ts")
    return views.apply_status_changes(incidents, first.unionByName(second).unionByName(unknown))[0]


@query("incident_context", f"""{HITS}, {WINDOWED}, r as (select *, row_number() over (partition by asset_id order by ts, id) as n from alerts),
l as (select asset_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || case severity when 1 then 'informational' when 2 then 'low' when 3 then 'medium' when 4 then 'high' else 'critical' end || '] ' || case rule_id when 'r-port' then 'Uncommon port' when 'r-name' then 'Watched domain' when 'r-tool' then 'Watched tools' when 'r-file' then 'Application file' else 'Failed login on Linux' end || ' x' || count, chr(10) order by n) as t from r where n <= 50 group by 1)
select asset_id as id, md5('Incident ' || asset_id || ' Open' || chr(10) || 'Alerts:' || chr(10) || t) as context from l""")  # fmt: skip
def incident_context(spark, d):
    """Each asset's alerts as one incident."""
    _, alerts = alerts_of(spark, d)
    own = alerts.withColumn("incident_id", F.col("asset_id"))
    incidents = own.select(F.col("incident_id").alias("id"), F.lit("open").alias("status")).distinct()
    out = views.incident_context(incidents, own, detect.rule_set(spark, [(r["id"], r) for r in RULES]).rules_df)
    return out.select("id", F.md5("context").alias("context"))


@query("import_intel_counts", "@with l as (select case when regexp_matches(v, '^[0-9.]+$') then 'ip' else 'domain' end as kind, lower(v) as value from (select regexp_extract(url, '^[a-z]+://([^/:]+)', 1) as v from pages)) select count(distinct (kind, value)) as imported, count(*) - count(distinct (kind, value)) as skipped from l where value <> ''")
def import_intel_counts(spark, d):
    lines = spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("text"))
    return detect.import_intel(lines, spark.createDataFrame([], "kind string, value string"), now=F.lit("2024-01-01").cast("timestamp"))[1]


@query("first_seen_again", """n as (select min(ts) + interval 15 day as edge from t), b as (select asset_id, exe_path, min(ts) as first_seen from t, n where exe_path is not null and ts < edge group by 1, 2),
f as (select asset_id, exe_path, min(ts) as first_seen, arg_min(event_id, (ts, event_id)) as event_id from t, n where exe_path is not null and ts >= edge group by 1, 2),
fresh as (select * from f anti join b using (asset_id, exe_path)), s as (select asset_id, min(first_seen) as s from (select asset_id, first_seen from b union all select asset_id, first_seen from fresh) group by 1)
select event_id, asset_id, exe_path from fresh join s using (asset_id) where first_seen >= s + interval 7 day""")  # fmt: skip
def first_seen_again(spark, d):
    """The second half of the events against the baseline of the first."""
    t = with_ids(telemetry(spark, d))
    edge = F.lit(t.agg(F.min("ts")).head()[0]) + F.expr("interval 15 days")
    base, _ = windows.first_seen(t.where(F.col("ts") < edge))
    return windows.first_seen(t.where(F.col("ts") >= edge), baseline=base)[1].select("event_id", "asset_id", "exe_path")


# Batches, as a stream gives them


def parts_of(t, n: int):
    """Events in n batches by time, the second one twice, as after a failure, with a few rows of the batch before."""
    span = t.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).head()
    width = (span["b"] - span["a"]) / n if span["a"] is not None else timedelta(1)
    edges = [span["a"] + width * k if span["a"] is not None else None for k in range(n)]
    for k in range(n):
        low = F.lit(edges[k])
        rows = t.where((F.col("ts") >= low) & (F.col("ts") < F.lit(edges[k + 1]))) if k + 1 < n else t.where(F.col("ts") >= low)
        yield k, rows if k == 0 else rows.unionByName(t.where((F.col("ts") < low) & (F.col("ts") >= low - F.expr("interval 6 hours"))))
        if k == 1:
            yield k, rows


def thirds(t):
    """Events in three parts by time, none twice."""
    span = t.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).head()
    edges = [F.lit(span["a"] + (span["b"] - span["a"]) / 3 * k) if span["a"] is not None else F.current_timestamp() for k in (1, 2)]
    return [t.where(F.col("ts") < edges[0]), t.where((F.col("ts") >= edges[0]) & (F.col("ts") < edges[1])), t.where(F.col("ts") >= edges[1])]


_FINGERPRINT = "rule_id || '|' || asset_id || case when class_uid = 1001 then '|' || exe_path else '' end"


def sent_events(t):
    """Events as decoded envelopes."""
    return events_of(t).select(F.col("event_id").cast("string").alias("id"), "ts", "class_uid", F.lit("agent").alias("source"), F.col("asset_id").cast("string").alias("asset_id"), F.col("asset_id").cast("string").alias("partition_key"), F.col("os").alias("asset_os"), F.when(F.col("class_uid") == 1001, F.concat(F.lit("|"), F.col("exe_path"))).alias("fingerprint_suffix"), "username", "raw")


def stream_out(spark, d, name: str):
    out = sinks.scratch(spark, name)
    e = sent_events(telemetry(spark, d))
    run = pipeline.detection_batch(spark, lambda: detect.rule_set(spark, [(r["id"], r) for r in RULES]), None, None, out, DAY, failures_within=timedelta(days=10))
    for number, part in parts_of(e, 3):
        run(part, number)
    return out


@query("alerts_in_batches", f"""{HITS}, tries as (select *, count(*) filter (status_id = 2) over (partition by asset_id, username order by ts range between interval 10 day preceding and current row) as failures from t where class_uid = 3002),
fh as (select event_id, ts, rule_id, severity, {_FINGERPRINT} as fp from hits union all select event_id, ts, 'bruteforce:success', 5, 'bruteforce:success|' || asset_id || '|' || username from tries where status_id = 1 and failures >= 5),
nxt as (select a.fp, a.ts, min(b.ts) as nx from (select distinct fp, ts from fh) a left join (select distinct fp, ts from fh) b on a.fp = b.fp and b.ts >= a.ts + interval 1 day group by 1, 2),
op as (select fp, min(ts) as ts from fh group by 1 union all select op.fp, nxt.nx from op join nxt using (fp, ts) where nxt.nx is not null),
win as (select h.*, o.ts as first_ts from fh h asof join op o on h.fp = o.fp and h.ts >= o.ts)
select fp as fingerprint, first_ts, rule_id, max(severity) as severity, count(*) as count, max(ts) as last_ts, arg_min(event_id, (ts, event_id)) as event_id from win group by 1, 2, 3""")  # fmt: skip
def alerts_in_batches(spark, d):
    """Three batches of events, one of which comes twice: the alerts are those of the whole table, with logins after failures in earlier batches."""
    alerts = sinks.read_alerts(spark, f"{stream_out(spark, d, 'detection')}/alerts")
    return alerts.select("fingerprint", "first_ts", "rule_id", "severity", F.col("count").cast("long").alias("count"), "last_ts", F.col("event_id").cast("long").alias("event_id"))


_LATE = f"""{HITS}, edge as (select min(ts) as lo, max(ts) as hi from t), fh0 as (select *, {_FINGERPRINT} as fp, ts >= lo + (hi - lo) / 3 and ts < lo + (hi - lo) / 3 * 2 as middle, ts >= lo + (hi - lo) / 3 * 2 as latest from hits, edge),
fh as (select event_id, ts, rule_id, severity, fp, middle and bool_or(latest) over (partition by fp) as late from fh0),
nxt as (select a.fp, a.late, a.ts, min(b.ts) as nx from (select distinct fp, late, ts from fh) a left join (select distinct fp, late, ts from fh) b on a.fp = b.fp and a.late = b.late and b.ts >= a.ts + interval 1 day group by 1, 2, 3),
op as (select fp, late, min(ts) as ts from fh group by 1, 2 union all select op.fp, op.late, nxt.nx from op join nxt using (fp, late, ts) where nxt.nx is not null),
win as (select h.*, o.ts as first_ts from fh h asof join op o on h.fp = o.fp and h.late = o.late and h.ts >= o.ts)
select fp as fingerprint, first_ts, rule_id, count(*) as count, max(ts) as last_ts, arg_min(event_id, (ts, event_id)) as event_id from win group by 1, 2, 3
union all select 'r-port|999999', lo + interval 3000 day, 'r-port', 3, lo + interval 3000 day + interval 2 minute, -1 from edge where lo is not null"""


@query("alerts_out_of_order", _LATE)
def alerts_out_of_order(spark, d):
    """The middle third of the events comes last, and each batch has an event from a wrong clock: late hits take the place of the open window, and no other event's time ends one."""
    t = telemetry(spark, d)
    e = sent_events(t)
    span = t.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).head()
    out = sinks.scratch(spark, "late")
    run = pipeline.detection_batch(spark, lambda: detect.rule_set(spark, [(r["id"], r) for r in RULES]), None, None, out, DAY)
    if span["a"] is None:
        span = {"a": datetime(2024, 1, 1), "b": datetime(2024, 1, 1)}
    edges = [span["a"] + (span["b"] - span["a"]) / 3 * k for k in (1, 2)]
    body = F.lit('{"dst_endpoint":{"port":4444}}')
    for number, part in enumerate((0, 2, 1)):
        rows = e.where((F.col("ts") < F.lit(edges[0])) if part == 0 else (F.col("ts") >= F.lit(edges[1])) if part == 2 else (F.col("ts") >= F.lit(edges[0])) & (F.col("ts") < F.lit(edges[1])))
        wrong = t.groupBy().agg((F.min("ts") + F.expr(f"interval 3000 days {part} minutes")).alias("ts")).where("ts is not null")
        wrong = wrong.select(F.lit(str(-1 - part)).alias("id"), "ts", F.lit(4001).alias("class_uid"), F.lit("agent").alias("source"), F.lit("999999").alias("asset_id"), F.lit("999999").alias("partition_key"), F.lit("linux").alias("asset_os"), F.lit(None).cast("string").alias("fingerprint_suffix"), F.lit(None).cast("string").alias("username"), body.alias("raw"))
        run(rows.unionByName(wrong), number)
    alerts = sinks.read_alerts(spark, f"{out}/alerts").where("rule_id <> 'bruteforce:success'")
    return alerts.select("fingerprint", "first_ts", "rule_id", F.col("count").cast("long").alias("count"), "last_ts", F.col("event_id").cast("long").alias("event_id"))


@query("events_in_batches", "m as (select count(*) as n from t) select 'stored' as stage, n as rows from m union all select 'processed', n from m")
def events_in_batches(spark, d):
    """Every event is stored and counted once, though many come twice."""
    out = stream_out(spark, d, "detection")
    metrics = spark.read.parquet(f"{out}/metrics").where("stage = 'processed'").groupBy("stage").agg(F.sum("rows").alias("rows"))
    return spark.read.parquet(f"{out}/events").agg(F.count("*").alias("rows")).select(F.lit("stored").alias("stage"), "rows").unionByName(metrics.select("stage", "rows"))


@query("incidents_in_batches", f"{HITS}, {WINDOWED}, {_ASSIGN} select p.id, p.reason, rt.root as incident_id from par2 p join rt using (id)")
def incidents_in_batches(spark, d):
    """Alerts correlated in two batches by time: the incidents are those of the whole table. Events and assets are stored once, as batches find them."""
    t, alerts = alerts_of(spark, d)
    events = sinks.stored(t.select("event_id", "ts", "asset_id", "process_guid", "parent_process_guid", "conn_tuple"), "events")
    assets = sinks.stored(assets_of(events), "assets")
    out = sinks.scratch(spark, "correlation")
    run = pipeline.correlation_batch(spark, lambda: events, lambda: assets, out, HOURS12)
    rows = alerts.select("id", "ts", "asset_id", "process_guid", "rule_id")
    for number, part in parts_of(rows, 2):
        run(part, number)
    return spark.read.parquet(f"{out}/assigned").select("id", "reason", "incident_id")


@query("flows_in_batches", """p as (select distinct asset_id, dst_ip, ts from t where class_uid = 4001),
r as (select *, sum(n) over (partition by asset_id, dst_ip order by ts) as run from (select *, case when ts - lag(ts) over (partition by asset_id, dst_ip order by ts) < interval 12 hour then 0 else 1 end as n from p))
select '10.0.' || (asset_id // 250) || '.' || (asset_id % 250) as src_ip, dst_ip, min(ts) as first_ts, max(ts) as last_ts, count(*) as src_packets from r group by asset_id, dst_ip, run""")  # fmt: skip
def flows_in_batches(spark, d):
    """Packets in three batches, with open flows carried over."""
    out = sinks.scratch(spark, "flows")
    packets = telemetry(spark, d).where("class_uid = 4001").select("ts", "src_ip", F.lit(40000).alias("sport"), "dst_ip", F.lit(443).alias("dport"), F.lit(6).alias("proto"), F.lit(16).alias("tcp_flags"), F.lit(60).cast("long").alias("frame_len")).distinct()
    span = packets.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).head()
    run = pipeline.flow_batch(out, HOURS12, timedelta(days=999))
    edges = [span["a"] + (span["b"] - span["a"]) / 3 * k for k in (1, 2)] if span["a"] is not None else []
    for number, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = packets if low is None else packets.where(F.col("ts") >= F.lit(low))
        run(part if high is None else part.where(F.col("ts") < F.lit(high)), number, drain=high is None)
    return spark.read.parquet(f"{out}/flows").select("src_ip", "dst_ip", "first_ts", "last_ts", "src_packets")


@query("brute_force_streamed", "a as (select *, count(*) filter (status_id = 2) over (partition by asset_id, username order by ts range between interval 10 day preceding and current row) as failures from t where class_uid = 3002) select event_id, asset_id, username, failures from a where status_id = 1 and failures >= 5")
def brute_force_streamed(spark, d):
    """Authentication events of the whole table as a stream in three runs by time: failures lie in a state store, and hits are those of the batch operator."""
    t = with_ids(telemetry(spark, d)).where("class_uid = 3002").select("id", "ts", "asset_id", "username", "status_id")
    hits = pipeline.in_runs(thirds(t), sinks.scratch(spark, "failures"), lambda s: pipeline.stream_brute_force(s, timedelta(days=10), forget=None))
    return hits.select(F.col("id").cast("long").alias("event_id"), "asset_id", "username", "failures")


@query("first_seen_streamed", f"{FIRST} select asset_id, exe_path, first_seen as ts from f join l using (asset_id) where first_seen >= s + interval 7 day")
def first_seen_streamed(spark, d):
    """Programs of the whole table as a stream in three runs by time, against the baselines in a state store."""
    t = with_ids(telemetry(spark, d)).where("exe_path is not null").select("id", "ts", "asset_id", "exe_path")
    return pipeline.in_runs(thirds(t), sinks.scratch(spark, "programs"), pipeline.stream_first_seen).select("asset_id", "exe_path", "ts")


@query("hits_in_many_batches", f"{HITS} select rule_id, count(*) as hits, max(ts) as last from hits group by 1")
def hits_in_many_batches(spark, d):
    """Counters of all hits over ten batches by time, one of which comes twice: segments that are merged as they grow, against one aggregate."""
    h = hits(spark, d)
    at, width = sinks.scratch(spark, "counters"), 10
    span = h.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).head()
    step = (span["b"] - span["a"]) / width if span["a"] is not None else timedelta(1)
    place = F.lit(0) if span["a"] is None else F.least(F.lit(width - 1), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(span["a"]))) / max(round(step.total_seconds() * 1e6), 1)))
    for number in (0, 1, 2, 2, *range(3, width)):
        part = h.where(place == number).groupBy("rule_id").agg(F.count("*").alias("hits"), F.max("ts").alias("last"))
        sinks.write_counters(part, at, "rule_id", number)
    return sinks.read_counters(spark, at, "rule_id")
