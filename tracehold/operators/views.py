"""Analyst views: search, overview, histories, process trees, contexts, reports, decisions, retention."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cut, md_cell, parse_verdict, severity_name, status_name, verdict_name
from ..functions.rules import CLASS_SOURCES
from .correlate import ancestors, process_parents
from .detect import with_rule_title

MAX_LIMIT = 200


def search_events(events: DataFrame, frm: Column | None = None, to: Column | None = None, asset_id=None, class_uid: int | None = None, source: str | None = None, q: str | None = None, limit: int = 100) -> DataFrame:
    """Newest events that meet all conditions given; q is a literal part of the body in either case. 1 to 200 rows."""
    df = events
    for given, cond in ((frm, lambda: F.col("ts") >= frm), (to, lambda: F.col("ts") <= to), (asset_id, lambda: F.col("asset_id") == asset_id), (class_uid, lambda: F.col("class_uid") == class_uid), (source, lambda: F.col("source") == source), (q, lambda: F.lower("raw").contains(q.lower()))):
        if given is not None and given != "":
            df = df.where(cond())
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(max(1, min(limit, MAX_LIMIT)))


def overview_stats(events: DataFrame, alerts: DataFrame, incidents: DataFrame, assets: DataFrame, now: Column, online: timedelta = timedelta(minutes=5)) -> DataFrame:
    """One row: events and alert hits of 24 hours, open incidents, incidents by status, assets and those online."""
    day = now - F.expr("interval 24 hours")
    e = events.where(F.col("ts") >= day).agg(F.count("*").alias("events_24h"))
    a = alerts.where(F.col("ts") >= day).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("alerts_24h"))
    by = incidents.groupBy("status").count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "count")))).alias("incidents"), F.coalesce(F.sum(F.when(F.col("status").isin("open", "triaged"), F.col("count"))), F.lit(0)).alias("open_incidents"))
    s = assets.agg(F.count("*").alias("assets"), F.count_if(F.col("last_seen") >= now - F.make_dt_interval(secs=F.lit(online.total_seconds()))).alias("assets_online"))
    return e.join(a).join(by).join(s)


def alert_trend(alerts: DataFrame, now: Column) -> DataFrame:
    """24 hourly buckets that end with the present hour, empty ones too, weighted by count; hits before the first bucket but within 24 hours fall into it."""
    first = F.date_trunc("hour", now) - F.expr("interval 23 hours")
    recent = alerts.where((F.col("ts") >= now - F.expr("interval 24 hours")) & (F.col("ts") <= now))
    hour = F.greatest(F.lit(0), F.floor((F.unix_micros("ts") - F.unix_micros(first)) / 3_600_000_000)).cast("int")
    sums = recent.groupBy(hour.alias("bucket")).agg(F.sum("count").alias("hits"))
    every = alerts.sparkSession.range(24).select(F.col("id").cast("int").alias("bucket"))
    return every.join(sums, "bucket", "left").select("bucket", (first + F.make_dt_interval(hours=F.col("bucket"))).alias("hour"), F.coalesce("hits", F.lit(0)).alias("hits"))


def top_rules(alerts: DataFrame, rules: DataFrame, now: Column, k: int = 5) -> DataFrame:
    recent = alerts.where(F.col("ts") >= now - F.expr("interval 24 hours")).groupBy("rule_id").agg(F.sum("count").alias("hits"))
    return with_rule_title(recent.orderBy(F.desc("hits"), "rule_id").limit(k), rules).orderBy(F.desc("hits"), "rule_id")


def rule_hit_totals(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule_id").agg(F.sum("count").alias("hits"))


def incident_severity_count(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("incident_id").isNotNull()).groupBy("incident_id").agg(F.count("*").alias("alerts"), F.max("severity").alias("severity"))


def latest(df: DataFrame, n: int, ts: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest n rows; one bounded top-k a task."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def oldest(df: DataFrame, n: int, ts: str = "created_at", tie: str = "id") -> DataFrame:
    return df.orderBy(ts, tie).limit(n)


def host_alert_history(alerts: DataFrame, rules: DataFrame, asset_id, now: Column, days: int = 7, limit: int = 20) -> DataFrame:
    since = now - F.make_dt_interval(days=F.lit(max(1, min(days, 90))))
    mine = alerts.where((F.col("asset_id") == asset_id) & (F.col("ts") >= since)).orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    return with_rule_title(mine, rules)


def rule_listing(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("severity"), "title")


def process_tree(events: DataFrame, guids: DataFrame, depth: int = 10, children: int = 10) -> DataFrame:
    """(guid, relation, level, process_guid): each guid itself, its ancestors, and its first `children` children."""
    parents = process_parents(events)
    own = guids.select("guid", F.lit("self").alias("relation"), F.lit(0).alias("level"), F.col("guid").alias("process_guid"))
    up = ancestors(guids, parents, depth).select("guid", F.lit("ancestor").alias("relation"), "level", F.col("ancestor").alias("process_guid"))
    starts = events.where(F.col("process_guid").isNotNull() & F.col("parent_process_guid").isNotNull()).groupBy("parent_process_guid", "process_guid").agg(F.min("ts").alias("ts"))
    down = guids.join(starts, F.col("guid") == F.col("parent_process_guid")).withColumn("_n", F.row_number().over(Window.partitionBy("guid").orderBy("ts", "process_guid"))).where(F.col("_n") <= children)
    return own.unionByName(up).unionByName(down.select("guid", F.lit("child").alias("relation"), F.lit(1).alias("level"), "process_guid"))


def false_positive_history(alerts: DataFrame, incidents: DataFrame, rules: DataFrame, now: Column, days: int = 90, newest: int = 20, keep: int = 5) -> DataFrame:
    """For each incident up to `keep` distinct (rule, title) of recent false positives with one of its rules.

    Before incidents meet them, false positives are cut to 2 * newest a rule, of one incident `newest` at most: without
    an incident's own ones, `newest` of those are always left, and they are the newest. Incidents with the same rules meet the same ones, so that
    these are cut once more for each set of rules that occurs, and an incident gets its set's as one list: no row is made of an incident and a false positive.
    """
    false = incidents.where(F.col("status") == "false_positive").select(F.col("id").alias("fp_incident"), F.col("title").alias("fp_title"))
    past = alerts.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days))).select("rule_id", F.col("ts").alias("fp_ts"), F.col("id").alias("fp_alert"), F.col("incident_id").alias("fp_incident")).join(false, "fp_incident")
    ranked = lambda df, keys, n: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fp_ts"), F.desc("fp_alert")))).where(F.col("_n") <= n)
    newest_of = lambda df, key: ranked(ranked(df, [key, "fp_incident"], newest), [key], 2 * newest).drop("_n")
    mine = alerts.where(F.col("incident_id").isNotNull() & F.col("rule_id").isNotNull()).select("incident_id", "rule_id").distinct()
    mine = mine.groupBy("incident_id").agg(F.sort_array(F.collect_list("rule_id")).alias("_rules"))
    # Dealt by number, as few small sets become 2 * newest rows a rule.
    parts = int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = mine.select("_rules").distinct().repartition(parts, "_rules").select("_rules", F.explode("_rules").alias("rule_id"))
    entry = F.struct("fp_ts", "fp_alert", "rule_id", "fp_title", "fp_incident")
    lists = newest_of(sets.join(newest_of(past, "rule_id"), "rule_id"), "_rules").groupBy("_rules").agg(F.sort_array(F.collect_list(entry), asc=False).alias("_past"))

    def step(acc: Column, p: Column) -> Column:
        known = F.exists(acc, lambda q: (q["rule_id"] == p["rule_id"]) & q["fp_title"].eqNullSafe(p["fp_title"]))
        return F.when(known | (F.size(acc) >= keep), acc).otherwise(F.concat(acc, F.array(p)))

    others = F.slice(F.filter("_past", lambda p: p["fp_incident"] != F.col("incident_id")), 1, newest)
    cases = mine.join(lists, "_rules").select("incident_id", F.posexplode(F.aggregate(others, F.slice("_past", 1, 0), step)).alias("_k", "_c"))
    return with_rule_title(cases.select("incident_id", "_c.rule_id", "_c.fp_title", "_c.fp_ts", (F.col("_k") + 1).alias("position")), rules)


def incident_context(incidents: DataFrame, alerts: DataFrame, rules: DataFrame, per_incident: int = 50, graph: tuple[DataFrame, DataFrame] | None = None, history: DataFrame | None = None, max_raw: int = 500) -> DataFrame:
    """(id, context): header, graph, up to `per_incident` alert lines in order of time, with the event's body if alerts have `raw`, and the false positives of the same rules.

    graph: nodes and edges of `incident_graph`, which caps them; history: of `false_positive_history`.
    """
    own = F.col("incident_id")
    order = Window.partitionBy("incident_id").orderBy("ts", "id")
    some = with_rule_title(alerts.where(own.isNotNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_incident), rules)
    body = [F.concat(F.lit("event="), cut("raw", max_raw))] if "raw" in alerts.columns else []
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("["), severity_name(F.col("severity")), F.lit("]")), "title", F.concat(F.lit("x"), F.col("count").cast("string")), *body)

    def joined(df: DataFrame, head: str, text: Column, *by: str) -> DataFrame:
        """(incident_id, text) of bounded groups, under a head line."""
        lines = df.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct(*by, text.alias("_line")))).alias("_l"))
        return lines.select("incident_id", F.concat(F.lit(head + "\n"), F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")).alias("_text"))

    parts = []
    if graph is not None:
        nodes, edges = graph
        parts.append(joined(nodes, "Nodes:", F.concat_ws(" ", "type", "label"), "first_ts", "id"))
        parts.append(joined(edges, "Edges:", F.concat_ws(" ", "from", "rel", "to"), "from", "to", "rel"))
    parts.append(joined(some, "Alerts:", line, "_n"))
    if history is not None:
        past = F.concat_ws(" ", "title", F.date_format("fp_ts", "yyyy-MM-dd"), F.concat(F.lit("("), F.coalesce("fp_title", F.lit("")), F.lit(")")))
        parts.append(joined(history, "Judged false positive before:", past, "position"))
    head = F.concat_ws(" ", F.lit("Incident"), F.col("id").cast("string"), status_name(F.col("status")), *([F.col("title")] if "title" in incidents.columns else []))
    out = incidents.select("id", head.alias("_p"))
    for k, part in enumerate(parts):
        out = out.join(part.withColumnsRenamed({"incident_id": f"_i{k}", "_text": f"_t{k}"}), F.col("id") == F.col(f"_i{k}"), "left").drop(f"_i{k}")
    return out.select("id", F.concat_ws("\n", "_p", *[f"_t{k}" for k in range(len(parts))]).alias("context"))


# Lists and details

#: Columns of the lists.
ROWS = {
    "events": ("id", "ts", "class_uid", "source", "asset_id", "username", "conn_tuple", "raw"),
    "intel": ("id", "created_at", "kind", "value", "source", "severity", "note", "expires_at", "matched_count", "last_matched_at"),
    "suppressions": ("id", "created_at", "rule_id", "asset_id", "reason", "created_by", "expires_at", "matched_count", "last_matched_at"),
    "commands": ("id", "created_at", "kind", "status", "dry_run", "asset_id", "incident_id", "issued_by", "detail", "completed_at"),
    "audit": ("id", "ts", "username", "action", "target", "detail", "remote_addr"),
    "assets": ("id", "hostname", "os", "ip_addrs", "agent_id", "first_seen", "last_seen"),
}


def list_rows(df: DataFrame, kind: str, rules: DataFrame | None = None) -> DataFrame:
    """The columns that the list of a kind shows; a column that df lacks is null. Suppressions get their rule's title."""
    out = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in ROWS[kind]])
    if kind == "suppressions" and rules is not None:
        titles = rules.groupBy("rule_id").agg(F.first("title").alias("rule_title"))
        out = out.join(titles, "rule_id", "left").select(*ROWS[kind], "rule_title")
    return out


def rule_rows(rules: DataFrame) -> DataFrame:
    """Rules with whether events of their class come in, and from what source; a rule of no class sees all."""
    sources = F.create_map(*[F.lit(x) for kv in CLASS_SOURCES.items() for x in kv])
    source = F.when(F.col("class_uid").isNull(), "all classes").otherwise(F.try_element_at(sources, F.col("class_uid")))
    return rules.withColumns({"source": source, "ingested": source.isNotNull()})


def incident_summary(incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """(id, created_at, status, title, ai_verdict, alerts, severity); incidents without alerts have 0 of both."""
    counts = incident_severity_count(alerts).withColumnsRenamed({"severity": "_severity", "alerts": "_alerts"})
    both = incidents.join(counts, F.col("id") == F.col("incident_id"), "left")
    return both.select("id", "created_at", "status", "title", "ai_verdict", F.coalesce("_alerts", F.lit(0)).alias("alerts"), F.coalesce("_severity", F.lit(0)).alias("severity"))


def assets_by_hostname(assets: DataFrame) -> DataFrame:
    return list_rows(assets, "assets").orderBy("hostname", "id")


def alerts_with_event_asset(alerts: DataFrame, events: DataFrame, assets: DataFrame) -> DataFrame:
    """Alerts with what the correlation needs of their event and asset; those without either have nulls."""
    e = events.select(F.col("id").alias("event_id"), F.col("class_uid"), "process_guid", "parent_process_guid", "conn_tuple", "raw")
    return alerts.join(e, "event_id", "left").join(assets.select(F.col("id").alias("asset_id"), "hostname"), "asset_id", "left")


def incident_alerts(alerts: DataFrame, events: DataFrame, rules: DataFrame, limit: int = 500) -> DataFrame:
    """(incident_id, position, ts, last_ts, count, severity, title, evidence): the first `limit` alerts of each incident with their event's body."""
    order = Window.partitionBy("incident_id").orderBy("ts", "id")
    first = alerts.where(F.col("incident_id").isNotNull()).withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    evidence = events.select(F.col("id").alias("event_id"), F.col("raw").alias("evidence"))
    return with_rule_title(first.join(evidence, "event_id", "left"), rules).select("incident_id", "position", "ts", "last_ts", "count", "severity", "title", F.coalesce("evidence", F.lit("")).alias("evidence"))


def incident_commands(commands: DataFrame, newest_first: bool = False) -> DataFrame:
    """(incident_id, position, created_at, kind, status, dry_run, issued_by, detail): the commands of each incident in order of time."""
    at = [F.desc(c) if newest_first else F.asc(c) for c in ("created_at", "id")]
    own = commands.where(F.col("incident_id").isNotNull()).withColumn("position", F.row_number().over(Window.partitionBy("incident_id").orderBy(*at)))
    return own.select("incident_id", "position", "created_at", "kind", "status", "dry_run", "issued_by", F.coalesce("detail", F.lit("")).alias("detail"))


#: What an analyst may set.
ANALYST_STATUSES = ("open", "closed", "false_positive")


def apply_status_changes(incidents: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: id, status, ts. (incidents with the status of their last allowed change, rejected changes with a reason): only an analyst's statuses may be set, and only on known incidents."""
    known = incidents.select("id").distinct().withColumn("_known", F.lit(True))
    reason = F.when(~F.coalesce(F.col("status").isin(*ANALYST_STATUSES), F.lit(False)), "status").when(F.col("_known").isNull(), "id")
    judged = changes.join(known, "id", "left").withColumn("reason", reason).drop("_known")
    last = judged.where(F.col("reason").isNull()).groupBy("id").agg(F.max_by("status", F.struct("ts", "status")).alias("_new"))
    return incidents.join(last, "id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new"), judged.where(F.col("reason").isNotNull())


def event_brief(events: DataFrame, n: int = 300) -> DataFrame:
    return events.select(*[c for c in ("id", "ts", "class_uid", "source") if c in events.columns], cut("raw", n).alias("raw"))


def verdict_of(c: Column | str) -> Column:
    """struct<verdict, confidence> of a verdict text; nulls if it can't be read."""
    v = F.try_parse_json(parse_verdict(c))
    return F.struct(F.try_variant_get(v, "$.verdict", "string").alias("verdict"), F.try_variant_get(v, "$.confidence", "int").alias("confidence"))


def notification_decisions(incidents: DataFrame, start: Column, wait_triage: bool = True, min_severity: int = 3) -> DataFrame:
    """incidents (id, created_at, status, severity, ai_verdict) with decision `send`, `wait` or `skip` and its reason."""
    v = verdict_of("ai_verdict")["verdict"]
    reason = (
        F.when(F.col("created_at") < start, "older than the service")
        .when(F.col("status").isin("closed", "false_positive"), "closed")
        .when(F.lit(wait_triage) & F.col("ai_verdict").isNull(), "verdict pending")
        .when(v == "benign", "benign")
        .when(F.col("severity") < min_severity, "low severity")
        .otherwise("due")
    )
    out = incidents.withColumn("reason", reason)
    return out.withColumn("decision", F.when(F.col("reason") == "due", "send").when(F.col("reason") == "verdict pending", "wait").otherwise("skip"))


def notification_payloads(decisions: DataFrame, fmt: str, link_base: str = "") -> DataFrame:
    """(id, payload) of what is due, in a generic form or that of a chat service."""
    due = decisions.where(F.col("decision") == "send")
    link = F.concat(F.lit(link_base.rstrip("/") + "/incidents/"), F.col("id").cast("string"))
    title = F.concat(F.lit("["), severity_name(F.col("severity")), F.lit("] "), F.coalesce("title", F.col("id").cast("string")))
    text = F.concat_ws("\n", title, F.concat(F.lit("Verdict: "), F.coalesce(verdict_name(verdict_of("ai_verdict")["verdict"]), F.lit("-"))), link)
    content = lambda key: F.struct(text.alias(key))
    forms = {
        "generic": F.struct(F.col("id").cast("string").alias("incident_id"), title.alias("title"), "severity", "status", link.alias("link")),
        "dingtalk": F.struct(F.lit("markdown").alias("msgtype"), F.struct(title.alias("title"), text.alias("text")).alias("markdown")),
        "feishu": F.struct(F.lit("text").alias("msg_type"), content("text").alias("content")),
        "wecom": F.struct(F.lit("markdown").alias("msgtype"), content("content").alias("markdown")),
    }
    if fmt not in forms:
        raise ValueError(f"format is one of {', '.join(forms)}")
    return due.select("id", F.to_json(forms[fmt]).alias("payload"))


def isolation_candidates(incidents: DataFrame, alerts: DataFrame, commands: DataFrame, min_confidence: int = 90, exempt: tuple = ()) -> DataFrame:
    """(incident_id, asset_id) of assets in incidents judged malicious with enough confidence, without those exempt or already asked for. Nothing is carried out."""
    v = verdict_of("ai_verdict")
    sure = incidents.where((v["verdict"] == "malicious") & (v["confidence"] >= min_confidence)).select(F.col("id").alias("incident_id"))
    assets = alerts.where(F.col("asset_id").isNotNull()).join(sure, "incident_id", "left_semi").select("incident_id", "asset_id").distinct()
    if exempt:
        assets = assets.where(~F.col("asset_id").isin(*exempt))
    asked = commands.where((F.col("kind") == "isolate") & (F.col("issued_by") == "auto")).select("incident_id", "asset_id")
    return assets.join(asked, ["incident_id", "asset_id"], "left_anti")


def pending_commands(commands: DataFrame, assets: DataFrame) -> DataFrame:
    """Commands that were sent and not answered, by agent, oldest first."""
    agents = assets.select(F.col("id").alias("asset_id"), "agent_id")
    return commands.where(F.col("status") == "sent").join(agents, "asset_id").orderBy("agent_id", "created_at", "id")


def apply_command_results(commands: DataFrame, results: DataFrame) -> DataFrame:
    """results: id, status, detail, ts. Known ids are updated by their last result; a status other than done or failed counts as failed."""
    last = results.groupBy("id").agg(F.max_by(F.struct("status", "detail", "ts"), "ts").alias("_r"))
    status = F.when(F.col("_r.status").isin("done", "failed"), F.col("_r.status")).otherwise("failed")
    known = F.col("_r").isNotNull()
    out = commands.join(last, "id", "left")
    return out.withColumns({"status": F.when(known, status).otherwise(F.col("status")), "detail": F.when(known, F.col("_r.detail")).otherwise(F.col("detail")), "completed_at": F.when(known, F.col("_r.ts")).otherwise(F.col("completed_at"))}).drop("_r")


def incident_entities(nodes: DataFrame) -> DataFrame:
    """(incident_id, hosts, processes): sorted distinct labels."""
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("type") == kind, F.col("label"))))
    return nodes.groupBy("incident_id").agg(of("asset").alias("hosts"), of("process").alias("processes"))


def incident_reports(incidents: DataFrame, alerts: DataFrame, nodes: DataFrame, commands: DataFrame, rules: DataFrame, now: Column, limit: int = 500) -> DataFrame:
    """(id, report): one Markdown document an incident, with its first `limit` alerts; the counts in its head are of all."""
    order = Window.partitionBy("incident_id").orderBy("ts", "id")
    every = alerts.where(F.col("incident_id").isNotNull())
    step = with_rule_title(every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit), rules)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("_n").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), severity_name(F.col("severity")), md_cell("title"), F.col("count").cast("string")), F.lit(" |"))
    chain = step.groupBy("incident_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", row.alias("r")))), lambda x: x["r"]), "\n").alias("_chain"))
    chain = chain.join(every.groupBy("incident_id").agg(F.max("severity").alias("_severity"), F.count("*").alias("_alerts")), "incident_id")
    asked = commands.where(F.col("incident_id").isNotNull()).groupBy("incident_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "kind", "status"))), lambda x: F.concat(F.lit("- "), F.concat_ws(" ", x["kind"], x["status"]))), "\n").alias("_commands"))
    both = incidents.join(chain, F.col("id") == chain["incident_id"], "left").drop("incident_id").join(asked.withColumnRenamed("incident_id", "_ci"), F.col("id") == F.col("_ci"), "left").join(incident_entities(nodes).withColumnRenamed("incident_id", "_ei"), F.col("id") == F.col("_ei"), "left")
    v = verdict_of("ai_verdict")
    names = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(c, lambda x: md_cell(x)), ", "), F.lit("")), F.lit("-"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.coalesce("title", F.concat(F.lit("Incident "), F.col("id").cast("string")))),
        F.lit(""),
        F.concat(F.lit("Status: "), status_name(F.col("status")), F.lit("; severity: "), F.coalesce(severity_name(F.col("_severity")), F.lit("-")), F.lit("; alerts: "), F.coalesce("_alerts", F.lit(0)).cast("string")),
        F.concat(F.lit("Verdict: "), F.coalesce(verdict_name(v["verdict"]), F.lit("-"))),
        F.concat(F.lit("Written: "), F.date_format(now, "yyyy-MM-dd HH:mm:ss")),
        F.lit("\n## Entities"),
        F.concat(F.lit("Hosts: "), names("hosts")),
        F.concat(F.lit("Processes: "), names("processes")),
        F.lit("\n## Steps\n| # | time | severity | rule | hits |\n|-|-|-|-|-|"),
        F.coalesce("_chain", F.lit("| - | - | - | - | - |")),
        F.lit("\n## Response"),
        F.coalesce("_commands", F.lit("-")),
    )
    return both.select("id", text.alias("report"))


def retention(events: DataFrame, alerts: DataFrame, now: Column, keep: timedelta | None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): events younger than `keep`, and older ones that an alert refers to, stay. No keep, or zero: nothing goes."""
    if not keep:
        return events, events.limit(0)
    old = F.col("ts") < now - F.make_dt_interval(secs=F.lit(keep.total_seconds()))
    evidence = alerts.where(F.col("event_id").isNotNull()).select(F.col("event_id").alias("id")).distinct()
    removed = events.where(old).join(evidence, "id", "left_anti")
    kept = events.where(~old).unionByName(events.where(old).join(evidence, "id", "left_semi"))
    return kept, removed


def expired_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") < now)


def pilot_metrics(events: DataFrame, alerts: DataFrame, incidents: DataFrame, assets: DataFrame, now: Column) -> DataFrame:
    """One row of gauges: totals, the last hour, alert hits, assets active within five minutes."""
    hour = now - F.expr("interval 1 hour")
    e = events.agg(F.count("*").alias("events"), F.count_if(F.col("ts") >= hour).alias("events_1h"))
    a = alerts.agg(F.count("*").alias("alerts"), F.coalesce(F.sum("count"), F.lit(0)).alias("alert_hits"))
    i = incidents.agg(F.count("*").alias("incidents"), F.count_if(F.col("status").isin("open", "triaged")).alias("open_incidents"))
    s = assets.agg(F.count("*").alias("assets"), F.count_if(F.col("last_seen") >= now - F.expr("interval 5 minutes")).alias("assets_active"))
    return e.join(a).join(i).join(s)
