"""The driver's tables as telemetry: the same adapter in Spark (`telemetry`) and DuckDB (`T`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = r"""
pg as (select page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) as host from pages),
npg as (select count(*) as n from pages),
ev as (select event_id, ts, user_id as asset_id, event_type, value, props, coalesce(try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) as int), 0) as k from events),
par as (select event_id, lag(event_id) over (partition by asset_id order by ts, event_id) as p from ev where event_type = 'purchase'),
t as (select ev.event_id, ev.ts, ev.asset_id, ev.k, ev.value, ev.props,
  case when event_type in ('error', 'signup') then 3002 when event_type = 'purchase' and k >= 90 then 1001 when event_type = 'purchase' then 1007 when event_type = 'click' then 4001 when event_type = 'view' then 4003 end as class_uid,
  case event_type when 'error' then 2 when 'signup' then 1 end as status_id,
  case when event_type in ('error', 'signup') then 'user' || (asset_id % 2) end as username,
  case when event_type = 'purchase' then '/opt/app/bin' || (k % 20) end as exe_path,
  case when event_type = 'purchase' then 'p' || ev.event_id end as process_guid,
  'p' || par.p as parent_process_guid,
  case when event_type = 'click' then 'tcp:10.0.' || (asset_id // 250) || '.' || (asset_id % 250) || ':' || (40000 + k) || '>10.0.' || ((asset_id + 1 + k % 3) // 250) || '.' || ((asset_id + 1 + k % 3) % 250) || ':' || (case when k % 10 = 0 then 4444 else 443 end) end as conn_tuple,
  case when event_type = 'click' then '10.0.' || (asset_id // 250) || '.' || (asset_id % 250) end as src_ip,
  case when event_type = 'click' then '10.0.' || ((asset_id + 1 + k % 3) // 250) || '.' || ((asset_id + 1 + k % 3) % 250) end as dst_ip,
  case when event_type = 'click' then (case when k % 10 = 0 then 4444 else 443 end) end as dst_port,
  case when event_type = 'view' then pg.host end as hostname,
  case when asset_id % 2 = 0 then 'linux' else 'windows' end as os
  from ev left join par using (event_id) cross join npg left join pg on pg.page_id = ev.event_id % npg.n)"""


def with_t(rest: str) -> str:
    return f"with recursive {T}, {rest}" if not rest.lstrip().lower().startswith("select") else f"with {T} {rest}"


def address(a: Column) -> Column:
    return F.concat(F.lit("10.0."), F.floor(a / 250).cast("string"), F.lit("."), (a % 250).cast("string"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("host"))
    n = pages.count()
    k = F.coalesce(F.regexp_extract("props", r'"k": *([0-9]+)', 1).try_cast("int"), F.lit(0))
    e = events.withColumns({"k": k, "ts": F.col("ts").cast("timestamp")}).withColumnRenamed("user_id", "asset_id")
    kind = F.col("event_type")
    bought, clicked = kind == "purchase", kind == "click"
    before = e.where(bought).select("event_id", F.lag("event_id").over(Window.partitionBy("asset_id").orderBy("ts", "event_id")).alias("p"))
    src, dst = address(F.col("asset_id")), address(F.col("asset_id") + 1 + F.col("k") % 3)
    port = F.when(F.col("k") % 10 == 0, 4444).otherwise(443)
    own = F.col("event_id") % F.lit(max(n, 1))
    joined = e.join(before, "event_id", "left").join(pages, own == F.col("page_id"), "left")
    return joined.select(
        "event_id", "ts", "asset_id", "k", "value", "props",
        F.when(kind.isin("error", "signup"), 3002).when(bought & (F.col("k") >= 90), 1001).when(bought, 1007).when(clicked, 4001).when(kind == "view", 4003).alias("class_uid"),
        F.when(kind == "error", 2).when(kind == "signup", 1).alias("status_id"),
        F.when(kind.isin("error", "signup"), F.concat(F.lit("user"), (F.col("asset_id") % 2).cast("string"))).alias("username"),
        F.when(bought, F.concat(F.lit("/opt/app/bin"), (F.col("k") % 20).cast("string"))).alias("exe_path"),
        F.when(bought, F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("process_guid"),
        F.concat(F.lit("p"), F.col("p").cast("string")).alias("parent_process_guid"),
        F.when(clicked, F.concat(F.lit("tcp:"), src, F.lit(":"), (F.col("k") + 40000).cast("string"), F.lit(">"), dst, F.lit(":"), port.cast("string"))).alias("conn_tuple"),
        F.when(clicked, src).alias("src_ip"), F.when(clicked, dst).alias("dst_ip"), F.when(clicked, port).alias("dst_port"),
        F.when(kind == "view", F.col("host")).alias("hostname"),
        F.when(F.col("asset_id") % 2 == 0, "linux").otherwise("windows").alias("os"),
    )


def events_of(t: DataFrame) -> DataFrame:
    """Canonical events with a nested JSON body."""
    o = lambda **f: F.struct(*[c.alias(k) for k, c in f.items()])
    c = F.col
    body = F.to_json(o(status_id=c("status_id"), actor=o(user=o(name=c("username"))), process=o(file=o(path=F.when(c("class_uid") == 1007, c("exe_path")))), file=o(path=F.when(c("class_uid") == 1001, c("exe_path"))), src_endpoint=o(ip=c("src_ip")), dst_endpoint=o(ip=c("dst_ip"), port=c("dst_port")), query=o(hostname=c("hostname"))))
    return t.withColumns({"id": c("event_id"), "raw": body})


def assets_of(t: DataFrame) -> DataFrame:
    return t.groupBy("asset_id").agg(F.max("ts").alias("last_seen"), F.min("ts").alias("first_seen")).select("asset_id", F.col("asset_id").alias("id"), F.concat(F.lit("host"), F.col("asset_id").cast("string")).alias("hostname"), F.when(F.col("asset_id") % 2 == 0, "linux").otherwise("windows").alias("os"), F.array(address(F.col("asset_id"))).alias("ip_addrs"), "first_seen", "last_seen")


RULES = [
    {"id": "r-port", "title": "Uncommon port", "level": "high", "tags": ["attack.command_and_control", "attack.t1571"], "logsource": {"category": "network_connection"}, "detection": {"s": {"DestinationPort": 4444}, "condition": "s"}},
    {"id": "r-name", "title": "Watched domain", "level": "medium", "tags": ["attack.command_and_control", "attack.t1071.004"], "logsource": {"category": "dns_query"}, "detection": {"s": {"QueryName|contains": ["example.org"]}, "condition": "s"}},
    {"id": "r-tool", "title": "Watched tools", "level": "low", "tags": ["attack.execution", "attack.t1059"], "logsource": {"category": "process_creation"}, "detection": {"a": {"Image|endswith": ["bin7", "BIN13"]}, "b": {"Image": "/opt/app/bin?5"}, "condition": "1 of them"}},
    {"id": "r-file", "title": "Application file", "level": "critical", "tags": ["attack.persistence", "attack.t1543"], "logsource": {"category": "file_event"}, "detection": {"sel": {"TargetFilename|startswith": "/opt/app/"}, "filter": {"TargetFilename|re": "bin1[0-4]$"}, "condition": "sel and not filter"}},
    {"id": "r-fail", "title": "Failed login on Linux", "level": "informational", "tags": ["attack.credential_access", "attack.t1110"], "logsource": {"category": "authentication", "product": "linux"}, "detection": {"s": {"status_id": 2, "User": "user*"}, "condition": "s"}},
]
#: The same rules in SQL over T.
HITS = """
hits as (
  select event_id, ts, asset_id, class_uid, exe_path, username, process_guid, conn_tuple, 'r-port' as rule_id, 4 as severity from t where class_uid = 4001 and dst_port = 4444
  union all select event_id, ts, asset_id, class_uid, exe_path, username, process_guid, conn_tuple, 'r-name', 3 from t where class_uid = 4003 and contains(lower(hostname), 'example.org')
  union all select event_id, ts, asset_id, class_uid, exe_path, username, process_guid, conn_tuple, 'r-tool', 2 from t where class_uid = 1007 and regexp_matches(exe_path, '(bin7|bin13)$|^/opt/app/bin.5$')
  union all select event_id, ts, asset_id, class_uid, exe_path, username, process_guid, conn_tuple, 'r-file', 5 from t where class_uid = 1001 and starts_with(exe_path, '/opt/app/') and not regexp_matches(exe_path, 'bin1[0-4]$')
  union all select event_id, ts, asset_id, class_uid, exe_path, username, process_guid, conn_tuple, 'r-fail', 1 from t where class_uid = 3002 and os = 'linux' and status_id = 2 and starts_with(username, 'user'))"""
