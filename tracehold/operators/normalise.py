"""Normalisation: source records to canonical events with nested bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import conn_tuple, empty_to_null, event_xml_field, event_xml_id, event_xml_pid, ip_text, os_lower, parse_syslog, partition_key, stable_id, strip_nul

NIL = "00000000-0000-0000-0000-000000000000"
GUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def guid_or_null(c: str) -> Column:
    return F.when(F.col(c).rlike(GUID), F.lower(c))


def ns_to_ts(c: str) -> Column:
    return F.timestamp_micros(F.expr(f"{c} div 1000"))


def decode_envelopes(df: DataFrame, value_col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine with a reason) of wire records in JSON."""
    e = F.from_json(F.col(value_col).cast("string"), schema)
    rows = df.withColumn("e", e)
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = (
        F.when(F.col("e").isNull() | F.try_parse_json(F.col(value_col).cast("string")).isNull(), "not JSON")
        .when(F.coalesce(F.col("e.version"), F.lit(0)) != 1, "version")
        .when(blank("e.id") | (F.col("e.id") == NIL), "id")
        .when(F.col("e.timestamp").isNull() | (F.col("e.timestamp") < F.lit("1970-01-01").cast("timestamp")), "timestamp")
        .when(F.coalesce(F.col("e.class_uid"), F.lit(0)) <= 0, "class_uid")
        .when(blank("e.source"), "source")
        .when(blank("e.partition_key"), "partition_key")
        .when(F.col("e.raw").isNull() | F.try_parse_json("e.raw").isNull(), "raw")
    )
    judged = rows.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).select("e.*").withColumnRenamed("timestamp", "ts"), judged.where(F.col("reason").isNotNull()).drop("e")


def attach_asset_by_agent(df: DataFrame, assets: DataFrame) -> DataFrame:
    return df.join(assets.where(F.col("agent_id").isNotNull()).select("agent_id", F.col("id").alias("asset_id"), os_lower("os").alias("asset_os")), "agent_id", "left")


def attach_asset_by_ip(df: DataFrame, assets: DataFrame, ip: str) -> DataFrame:
    """Of several assets with one address, however it is spelled, the one last seen."""
    by_ip = assets.select(F.explode("ip_addrs").alias("_ip"), "id", "os", "last_seen").select(ip_text("_ip").alias("_ip"), "id", "os", "last_seen").groupBy("_ip").agg(F.max_by(F.struct("id", "os"), F.struct("last_seen", "id")).alias("_a"))
    return df.join(by_ip, ip_text(ip) == F.col("_ip"), "left").withColumns({"asset_id": F.col("_a.id"), "asset_os": os_lower(F.col("_a.os"))}).drop("_ip", "_a")


def attach_asset_host_then_ip(df: DataFrame, assets: DataFrame, host: str, ip: str) -> DataFrame:
    by_host = assets.groupBy(F.lower("hostname").alias("_host")).agg(F.max_by("id", F.struct("last_seen", "id")).alias("_h"))
    with_host = df.join(by_host, F.lower(host) == F.col("_host"), "left").drop("_host")
    both = attach_asset_by_ip(with_host, assets, ip)
    return both.withColumn("asset_id", F.coalesce("_h", "asset_id")).drop("_h")


def agent_events(df: DataFrame, assets: DataFrame) -> DataFrame:
    """Agent records to envelopes: times from nanoseconds, bad GUIDs to null, bad bodies to {}, ids fixed by all that tells two events apart."""
    rows = attach_asset_by_agent(df, assets)
    raw = strip_nul("raw_json")
    path = F.try_variant_get(F.try_parse_json(raw), "$.file.path", "string")
    return rows.select(
        F.lit(1).alias("version"),
        stable_id("agent_id", "ts_unix_ns", "class_uid", "process_guid", "parent_process_guid", "conn_tuple", F.when(F.try_parse_json("raw_json").isNotNull(), F.col("raw_json")).otherwise("{}")).alias("id"),
        partition_key(F.col("asset_id"), F.col("agent_id")).alias("partition_key"),
        ns_to_ts("ts_unix_ns").alias("ts"),
        "class_uid", F.lit("agent").alias("source"), "asset_id", "asset_os",
        guid_or_null("process_guid").alias("process_guid"), guid_or_null("parent_process_guid").alias("parent_process_guid"),
        empty_to_null("username").alias("username"), empty_to_null("conn_tuple").alias("conn_tuple"),
        F.when(F.col("class_uid") == 1001, F.concat(F.lit("|"), path)).alias("fingerprint_suffix"), raw.alias("raw"),
    )


def _object(**fields: Column) -> Column:
    """A struct that is null if all its fields are."""
    return F.when(F.coalesce(*[F.when(f.isNotNull(), F.lit(1)) for f in fields.values()]).isNotNull(), F.struct(*[f.alias(k) for k, f in fields.items()]))


def flow_body(df: DataFrame) -> DataFrame:
    """df of flow records with `class_uid` and `body`: duration, totals, both directions, and DNS, TLS and HTTP blocks where they have anything; names in order."""
    e = empty_to_null
    c = F.col
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    end = lambda ip, port: F.struct(c(ip).alias("ip"), c(port).alias("port"))
    named = text("dns_query") != ""
    answers = F.when(named & (F.size(F.coalesce("dns_answers", F.array().cast("array<string>"))) > 0), F.transform("dns_answers", lambda a: F.struct(a.alias("ip"))))
    cert = F.when(text("tls_cert_subject") != "", F.struct(text("tls_cert_issuer").alias("issuer"), text("tls_cert_not_after").alias("not_after"), text("tls_cert_not_before").alias("not_before"), c("tls_cert_self_signed").alias("self_signed"), c("tls_cert_subject").alias("subject")))
    request = F.struct(text("http_host").alias("hostname"), F.struct(text("http_uri").alias("path")).alias("url"), text("http_user_agent").alias("user_agent"))
    body = F.struct(
        F.lit(6).alias("activity_id"),
        answers.alias("answers"),
        F.struct(c("protocol").alias("protocol_num"), c("tcp_flags").alias("tcp_flags")).alias("connection_info"),
        end("dst_ip", "dst_port").alias("dst_endpoint"),
        F.expr("(end_unix_ns - start_unix_ns) div 1000000").alias("duration_ms"),
        F.when((text("http_host") != "") | (text("http_uri") != ""), request).alias("http_request"),
        F.when(named, F.struct(c("dns_query").alias("hostname"), F.coalesce(c("dns_rcode").try_cast("int"), F.lit(0)).alias("rcode_id"))).alias("query"),
        end("src_ip", "src_port").alias("src_endpoint"),
        _object(cert=cert, ja3_hash=e("ja3"), ja3s_hash=e("ja3s"), sni=e("tls_sni")).alias("tls"),
        F.struct((c("src_bytes") + c("dst_bytes")).alias("bytes"), c("dst_bytes").alias("bytes_in"), c("src_bytes").alias("bytes_out"), (c("src_packets") + c("dst_packets")).alias("packets"), c("dst_packets").alias("packets_in"), c("src_packets").alias("packets_out")).alias("traffic"),
    )
    return df.withColumns({"class_uid": F.when(named, 4003).otherwise(4001), "body": body})


def read_flows(df: DataFrame, assets: DataFrame, sensor: str = "sensor") -> DataFrame:
    """Flow records to envelopes, at the time the flow began."""
    rows = attach_asset_by_ip(flow_body(df), assets, "src_ip")
    key = conn_tuple(F.col("protocol"), F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    raw = F.to_json("body")
    return rows.select(F.lit(1).alias("version"), stable_id(F.lit(sensor), "start_unix_ns", "end_unix_ns", key, raw).alias("id"), partition_key(F.col("asset_id"), F.col("src_ip")).alias("partition_key"), ns_to_ts("start_unix_ns").alias("ts"), "class_uid", F.lit("sensor").alias("source"), "asset_id", "asset_os", key.alias("conn_tuple"), raw.alias("raw"))


def _rfc3339(ts: Column) -> Column:
    """The time in UTC with as many digits after the second as it has."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat(F.regexp_replace(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0*$", ""), F.lit("Z"))


def read_syslog(df: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Lines (line, from_ip, received_at), cut at 65536 characters, to application events. A line with a time of its own has the same id whenever it comes."""
    rows = df.withColumn("m", parse_syslog(F.substring("line", 1, 65536), F.col("received_at")))
    rows = rows.withColumns({"hostname": F.col("m.hostname"), "ts": F.col("m.ts")})
    rows = attach_asset_host_then_ip(rows, assets, "hostname", "from_ip") if assets is not None else rows.withColumns({"asset_id": F.lit(None).cast("string"), "asset_os": F.lit(None).cast("string")})
    part = lambda name: F.coalesce(F.col(f"m.{name}"), F.lit(""))
    body = F.struct(
        F.lit(1).alias("activity_id"),
        F.struct(F.struct(part("procid").alias("pid")).alias("process")).alias("actor"),
        F.struct(part("hostname").alias("hostname")).alias("device"),
        F.col("m.facility").alias("facility"),
        F.col("m.content").alias("message"),
        F.struct(part("msgid").alias("log_name"), F.struct(part("app").alias("name")).alias("product")).alias("metadata"),
        F.col("m.severity").alias("severity_id"),
    )
    origin = F.coalesce(empty_to_null("hostname"), F.col("from_ip"), F.lit(""))
    return rows.select(stable_id(F.lit("syslog"), origin, _rfc3339(F.col("ts")), part("app"), part("procid"), part("content")).alias("id"), partition_key(F.col("asset_id"), origin).alias("partition_key"), "ts", F.lit(100001).alias("class_uid"), F.lit("syslog").alias("source"), "asset_id", "asset_os", body.alias("body"), F.to_json(body).alias("raw"))


def process_body(df: DataFrame) -> DataFrame:
    """df: activity (1 launch, 2 terminate), pid, path, cmd_line, sha256, user, parent_pid, parent_path, parent_cmd_line; and where it has them uid, parent_uid (process GUIDs) and exit_code."""
    c = F.col
    own = lambda name, kind: c(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    parent = F.struct(c("parent_pid").alias("pid"), empty_to_null(own("parent_uid", "string")).alias("uid"), _object(path=empty_to_null("parent_path")).alias("file"), empty_to_null("parent_cmd_line").alias("cmd_line"))
    process = F.struct(c("pid"), empty_to_null(own("uid", "string")).alias("uid"), own("exit_code", "int").alias("exit_code"), _object(path=empty_to_null("path"), name=empty_to_null(F.element_at(F.split("path", r"[\\/]"), -1)), sha256=empty_to_null("sha256")).alias("file"), empty_to_null("cmd_line").alias("cmd_line"), F.when(c("activity") == 1, parent).alias("parent_process"))
    return df.withColumn("body", F.struct(F.lit(1007).alias("class_uid"), c("activity").alias("activity_id"), process.alias("process"), _object(user=_object(name=empty_to_null("user"))).alias("actor")))


def conn_body(df: DataFrame) -> DataFrame:
    """df: pid, path, protocol, src_ip, src_port, dst_ip, dst_port of an outbound connection."""
    c = F.col
    end = lambda ip, port: F.struct(c(ip).alias("ip"), c(port).alias("port"))
    return df.withColumn("body", F.struct(F.lit(4001).alias("class_uid"), F.lit(1).alias("activity_id"), F.struct(c("pid"), F.struct(c("path")).alias("file")).alias("process"), end("src_ip", "src_port").alias("src_endpoint"), end("dst_ip", "dst_port").alias("dst_endpoint"), F.struct(F.lit("outbound").alias("direction"), F.when(c("protocol") == 6, "tcp").otherwise("udp").alias("protocol_name")).alias("connection_info")))


def change_body(df: DataFrame) -> DataFrame:
    """Bodies of snapshot changes (kind, key, value, old_value, activity): registry value, file, module, WMI subscription (a file event with the instance beside its path), or another persistence object."""
    c = F.col
    registry = F.struct(F.lit(201002).alias("class_uid"), c("activity").alias("activity_id"), F.struct(c("key").alias("path")).alias("reg_key"), F.struct(F.coalesce("value", "old_value").alias("data")).alias("reg_value"))
    file = F.struct(F.lit(1001).alias("class_uid"), c("activity").alias("activity_id"), F.struct(c("key").alias("path"), c("value").alias("sha256")).alias("file"))
    module = F.struct(F.lit(1005).alias("class_uid"), c("activity").alias("activity_id"), F.struct(F.struct(c("key").alias("path")).alias("file"), c("value").alias("base_address")).alias("module"))
    wmi = F.struct(F.lit(1001).alias("class_uid"), c("activity").alias("activity_id"), F.struct(c("key").alias("path")).alias("file"), F.struct(F.coalesce("value", "old_value").alias("data")).alias("wmi"))
    other = F.struct(F.lit(100001).alias("class_uid"), c("activity").alias("activity_id"), c("kind").alias("object"), c("key").alias("name"), F.coalesce("value", "old_value").alias("data"))
    kind = c("kind")
    class_uid = F.when(kind == "registry", 201002).when(kind.isin("file", "wmi"), 1001).when(kind == "module", 1005).otherwise(100001)
    raw = F.when(kind == "registry", F.to_json(registry)).when(kind == "file", F.to_json(file)).when(kind == "module", F.to_json(module)).when(kind == "wmi", F.to_json(wmi)).otherwise(F.to_json(other))
    return df.withColumns({"class_uid": class_uid, "raw": raw})


#: Security-log event ids and their activities.
AUTH_ACTIVITIES = {4624: 1, 4625: 1, 4720: 10, 4726: 11, 4732: 12, 1102: 13, 4648: 14, 4719: 15}


def windows_events(df: DataFrame) -> DataFrame:
    """df (agent_id, ts, xml) to authentication (3002) and script block (1007) events.

    Logons, accounts and explicit credentials of machine and service accounts, service logons and empty blocks are dropped. A change of a group
    is about the member (- is none), and names the group; audit policy and cleared logs are about who did it.
    """
    event, xml = F.col("event_id"), F.col("xml")
    field = lambda name: event_xml_field(xml, name)
    given = lambda name: F.coalesce(field(name), F.lit(""))
    only = lambda *ids: lambda c: F.when(event.isin(*ids), c)
    activity = F.element_at(F.create_map(*[F.lit(x) for kv in AUTH_ACTIVITIES.items() for x in kv]), event)
    logon, failed, account, group, policy, explicit = only(4624, 4625), only(4625), only(4720, 4726), only(4732), only(4719), only(4648)
    member = F.when(given("MemberName") == "-", "").otherwise(given("MemberName"))
    target = given("TargetUserName")
    user = F.when(event == 4732, member).when(event.isin(1102, 4719), given("SubjectUserName")).otherwise(target)
    auth = F.struct(
        F.lit(3002).alias("class_uid"), activity.alias("activity_id"), F.when(event == 4625, 2).otherwise(1).alias("status_id"), F.struct(user.alias("name")).alias("user"),
        only(4720, 4726, 4732, 4648)(given("SubjectUserName")).alias("actor_user"), account(given("TargetDomainName")).alias("target_domain"), group(target).alias("group_name"),
        only(4624, 4625, 4648)(F.struct(given("IpAddress").alias("ip"))).alias("src_endpoint"), logon(F.struct(F.concat(F.lit("logon-type-"), given("LogonType")).alias("name"))).alias("service"),
        logon(empty_to_null(given("Status"))).alias("status_code"), logon(empty_to_null(given("SubStatus"))).alias("status_detail"), only(1102)(F.lit(True)).alias("log_cleared"),
        explicit(given("TargetServerName")).alias("target_server"), explicit(given("ProcessName")).alias("process_name"),
        policy(F.coalesce(field("Category"), given("CategoryId"))).alias("policy_category"), policy(F.coalesce(field("Subcategory"), given("SubcategoryId"))).alias("policy_subcategory"), policy(given("AuditPolicyChanges")).alias("policy_changes"),
    )
    script = F.struct(F.lit(1007).alias("class_uid"), F.lit(1).alias("activity_id"), F.struct(event_xml_pid(xml).alias("pid"), field("ScriptBlockText").alias("cmd_line"), F.struct(field("Path").alias("path")).alias("file")).alias("process"), F.struct(field("MessageNumber").try_cast("int").alias("number"), field("MessageTotal").try_cast("int").alias("total")).alias("fragment"))
    is_script = event == 4104
    machine = target.isin("", "-") | target.endswith("$") | (F.upper(target) == "SYSTEM")
    dropped = (event.isin(4624, 4625, 4720, 4726, 4648) & machine) | ((event == 4732) & member.endswith("$")) | ((event == 4624) & given("LogonType").isin("0", "5")) | (is_script & (F.trim(given("ScriptBlockText")) == ""))
    rows = df.withColumn("event_id", event_xml_id("xml")).where(is_script | activity.isNotNull()).where(~dropped)
    return rows.select("agent_id", "ts", "event_id", F.when(is_script, 1007).otherwise(3002).alias("class_uid"), F.when(~is_script, user).alias("username"), F.when(is_script, F.to_json(script)).otherwise(F.to_json(auth)).alias("raw"))


def login_records(df: DataFrame) -> DataFrame:
    """df (user, host, line, failure, ts) to authentication events; the terminal is the service."""
    text = lambda name: F.coalesce(name, F.lit(""))
    body = F.struct(F.lit(3002).alias("class_uid"), F.lit(1).alias("activity_id"), F.when(F.col("failure"), 2).otherwise(1).alias("status_id"), F.struct(F.col("user").alias("name")).alias("user"), F.struct(text("host").alias("ip")).alias("src_endpoint"), F.struct(text("line").alias("name")).alias("service"))
    return df.select("ts", F.lit(3002).alias("class_uid"), F.col("user").alias("username"), F.to_json(body).alias("raw"))


# Snapshots


def snapshot_diff(prev: DataFrame, cur: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Changes between two snapshots: activity 1 created, 3 modified, 4 deleted; a deletion carries the old value."""
    a = prev.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = cur.select(*keys, F.col(value).alias("value"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    activity = F.when(F.col("_a").isNull(), 1).when(F.col("_b").isNull(), 4).when(~F.col("value").eqNullSafe(F.col("old_value")), 3)
    return both.withColumn("activity", activity).where(F.col("activity").isNotNull()).select(*keys, "activity", F.when(F.col("activity") == 4, F.col("old_value")).otherwise(F.col("value")).alias("value"), "old_value")


def snapshot_changes(snapshots: DataFrame, groups: list[str], keys: list[str], ts: str, value: str) -> DataFrame:
    """Changes between each snapshot of a group and the one before it; the first is silent, and a group without a snapshot at a time is not taken as empty."""
    order = Window.partitionBy(*groups).orderBy(ts)
    times = snapshots.select(*groups, ts).distinct().withColumn("_prev", F.lag(ts).over(order)).where(F.col("_prev").isNotNull())
    now = snapshots.join(times, [*groups, ts]).select(*groups, ts, *keys, value)
    before = times.join(snapshots.select(*groups, F.col(ts).alias("_prev"), *keys, value), [*groups, "_prev"]).select(*groups, ts, *keys, value)
    return snapshot_diff(before, now, [*groups, ts, *keys], value)


def appeared_and_gone(prev: DataFrame, cur: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return cur.select(*keys).distinct().join(prev, keys, "left_anti"), prev.select(*keys).distinct().join(cur, keys, "left_anti")
