"""Correlation: alerts to incidents as a set computation, and the incidents' graphs.

Each alert picks at most one earlier alert as its parent: by process ancestry, else the one before it on its asset, else an
alert of an asset that connected to it. The incident is the root of that forest, found by pointer jumping over tables.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_conn_tuple
from .sinks import stored


def process_parents(events: DataFrame) -> DataFrame:
    """(guid, parent): the earliest launch of each process guid."""
    launches = events.where(F.col("process_guid").isNotNull() & F.col("parent_process_guid").isNotNull())
    return launches.groupBy("process_guid").agg(F.min(F.struct("ts", "parent_process_guid"))["parent_process_guid"].alias("parent")).select(F.col("process_guid").alias("guid"), "parent")


def ancestors(guids: DataFrame, parents: DataFrame, depth: int, step: int = 4) -> DataFrame:
    """(guid, ancestor, level), each ancestor once, up to `depth` levels above.

    One row a guid climbs with the path behind it, so nothing is computed twice; after every `step` equi-joins the
    rows are written, and climbing ends when none has a parent left. A guid that comes again on its path ends it.
    """
    up = parents.select(F.col("guid").alias("_at"), F.col("parent").alias("_to"))
    paths = guids.select("guid").distinct().withColumns({"_top": F.col("guid"), "path": F.array().cast("array<string>")})
    for level in range(depth):
        met = F.array_contains("path", F.col("_to")) | (F.col("_to") == F.col("guid"))
        top = F.when(~met, F.col("_to"))
        paths = paths.join(up, F.col("_top") == F.col("_at"), "left").select("guid", top.alias("_top"), F.when(top.isNotNull(), F.array_append("path", F.col("_to").cast("string"))).otherwise(F.col("path")).alias("path"))
        if level % step == step - 1 or level == depth - 1:
            paths = stored(paths, "ancestors")
            if level < depth - 1 and not paths.where(F.col("_top").isNotNull()).limit(1).count():
                break
    return paths.select("guid", F.posexplode("path").alias("_k", "ancestor")).select("guid", "ancestor", (F.col("_k") + 1).alias("level"))


def _bin(ts: str, width: timedelta) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(max(round(width.total_seconds() * 1e6), 1))).alias("_bin")


def _last_before(asks: DataFrame, gives: DataFrame, key: str, out: str, within: timedelta | None = None, slice_of: timedelta = timedelta(days=1)) -> DataFrame:
    """asks (key, ts, id, ...) with `out`: struct<ts, id> of the last of gives (key, ts, id) with a smaller (ts, id). An as-of join: the two are united and sorted, and no pair is made.

    A key's rows are dealt by time, so that a key with most of the rows is many tasks. Where only gives at most `within`
    before are asked for (others may be given), a slice is that wide, and a give lies in its own and the next one. Else slices are `slice_of` wide, and each takes
    the last give of the slices before it, found among one row a key and slice. A null key is a key only with `within`.
    """
    cols = [c for c in asks.columns if c not in (key, "ts", "id")]
    width = within if within is not None else slice_of
    left = asks.select(key, "ts", "id", *cols, _bin("ts", width), F.lit(0).alias("_give"))
    right = gives.select(key, "ts", "id", _bin("ts", width), F.lit(1).alias("_give"))
    if within is not None:
        right = right.withColumn("_bin", F.explode(F.array("_bin", F.col("_bin") + 1)))
    order = Window.partitionBy(key, "_bin").orderBy("ts", "id", "_give").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_give") == 1, F.struct("ts", "id")), ignorenulls=True).over(order)
    found = left.unionByName(right, allowMissingColumns=True).withColumn(out, last).where("_give = 0").drop("_give")
    if within is not None:
        return found.drop("_bin")
    slices = right.select(key, "_bin", F.struct("ts", "id").alias("_top")).unionByName(left.select(key, "_bin"), allowMissingColumns=True).groupBy(key, "_bin").agg(F.max("_top").alias("_top"))
    before = F.last("_top", ignorenulls=True).over(Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    carried = slices.select(key, "_bin", before.alias("_before")).where(F.col("_before").isNotNull())
    return found.join(carried, [key, "_bin"], "left").withColumn(out, F.coalesce(out, "_before")).drop("_bin", "_before")


def lineage_parent(alerts: DataFrame, process_events: DataFrame, max_depth: int = 16, asks: DataFrame | None = None) -> DataFrame:
    """(id, lineage_parent): for each alert of a process the newest earlier alert of its nearest ancestor process that has one.

    alerts: id, ts, process_guid. Earlier means a smaller (ts, id). asks: the alerts that parents are looked for, if not all.
    """
    of_process = lambda df: df.where(F.col("process_guid").isNotNull()).select("id", "ts", F.col("process_guid").alias("guid"))
    own = of_process(alerts)
    asking = own if asks is None else of_process(asks)
    climbed = ancestors(asking.select("guid"), process_parents(process_events), max_depth)
    above = asking.join(climbed, "guid").select("ancestor", "ts", "id", "level")
    found = _last_before(above, own.select(F.col("guid").alias("ancestor"), "ts", "id"), "ancestor", "_p").where(F.col("_p").isNotNull())
    return found.groupBy("id").agg(F.min_by("_p", "level")["id"].alias("lineage_parent"))


def gap_parent(alerts: DataFrame, window: timedelta, asks: DataFrame | None = None) -> DataFrame:
    """(id, gap_parent): the alert before it on the same asset, if not more than `window` earlier; alerts without asset form one bucket, dealt by time like any other."""
    rows = alerts.select("asset_id", "ts", "id")
    near = F.unix_micros("ts") - F.unix_micros("_p.ts") <= round(window.total_seconds() * 1e6)
    asking = rows if asks is None else asks.select("asset_id", "ts", "id")
    return _last_before(asking, rows, "asset_id", "_p", window).where(near).select("id", F.col("_p.id").alias("gap_parent"))


def lateral_parent(alerts: DataFrame, assets: DataFrame, connections: DataFrame, window: timedelta, per_ip: int = 5, asks: DataFrame | None = None) -> DataFrame:
    """(id, lateral_parent): of the newest `per_ip` connections of other assets to each of my addresses within the window before me, the newest whose asset had an alert in that window gives its latest alert.

    connections: event_id, ts, asset_id, conn_tuple. Two as-of joins: each connection carries the last `per_ip` ones to
    its address, each alert takes those of the last connection before it, and then each of those assets' last alert. Nothing older than the
    window is asked for, so an address's rows are dealt by time: slices as wide as the window, a connection in its own and the next one.
    """
    width = round(window.total_seconds() * 1e6)
    near = lambda t: F.unix_micros("ts") - F.unix_micros(t) <= width
    addresses = assets.select("asset_id", F.explode("ip_addrs").alias("ip"))
    conns = connections.select(F.col("event_id").alias("conn_id"), F.col("ts").alias("conn_ts"), F.col("asset_id").alias("other"), parse_conn_tuple("conn_tuple")["dst_ip"].alias("ip"))
    conns = conns.join(addresses, "ip").where(F.col("other") != F.col("asset_id")).withColumn("_bin", _bin("conn_ts", window))
    conns = conns.withColumn("_bin", F.explode(F.array("_bin", F.col("_bin") + 1)))
    slices = ["asset_id", "ip", "_bin"]
    recent = Window.partitionBy(*slices).orderBy("conn_ts", "conn_id").rowsBetween(1 - per_ip, Window.currentRow)
    conns = conns.select(*slices, F.col("conn_ts").alias("ts"), F.col("conn_id").alias("_order"), F.collect_list(F.struct("conn_ts", "conn_id", "other")).over(recent).alias("_conns"))
    mine = (alerts if asks is None else asks).where(F.col("asset_id").isNotNull()).join(addresses, "asset_id").select("asset_id", "ip", "ts", "id", _bin("ts", window))
    both = mine.withColumn("_ask", F.lit(1)).unionByName(conns.withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*slices).orderBy("ts", "_ask", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_last", F.last("_conns", ignorenulls=True).over(order)).where("_ask = 1").select("id", "ts", F.explode("_last").alias("c")).where(near("c.conn_ts"))
    asked = met.select(F.col("c.other").alias("asset_id"), "ts", "id", F.col("c.conn_ts").alias("conn_ts"), F.col("c.conn_id").alias("conn_id"))
    found = _last_before(asked, alerts.where(F.col("asset_id").isNotNull()).select("asset_id", "ts", "id"), "asset_id", "_p", window).where(F.col("_p").isNotNull() & near("_p.ts"))
    return found.groupBy("id").agg(F.max(F.struct("conn_ts", "conn_id", F.col("_p.ts").alias("_pts"), F.col("_p.id").alias("_pid")))["_pid"].alias("lateral_parent"))


def roots(parents: DataFrame) -> DataFrame:
    """parents: (id, parent), parent null for roots; one that is no id is a root, too. (id, root) by pointer jumping: each round doubles the distance; each is written to the shared folder."""
    state = stored(parents.select("id", F.coalesce("parent", "id").alias("root")), "roots")
    while True:
        up = state.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        moved = stored(state.join(up, "root", "left").select("id", "root", F.coalesce("_next", "root").alias("_next")), "roots")
        state = moved.select("id", F.col("_next").alias("root"))
        if not moved.where("root <> _next").limit(1).count():
            return state


def assign_incidents(alerts: DataFrame, events: DataFrame, assets: DataFrame, window: timedelta, max_depth: int = 16, existing: DataFrame | None = None) -> DataFrame:
    """alerts with parent_alert_id, reason (`lineage`, `asset`, `lateral` or `new`) and incident_id, the id of the root alert.

    alerts: id, ts, asset_id, process_guid. existing: incidents (id, status); alerts already in a closed or
    false-positive one can't become parents, and alerts already in an incident keep it: no parent is looked for, and they have no reason.
    The work is then that of the new alerts: theirs are the ancestors that are climbed to and the connections that are read, from `window` before the first of them.
    """
    eligible, asks = alerts, None
    if existing is not None:
        asks = alerts.where(F.col("incident_id").isNull())
        shut = existing.where(F.col("status").isin("closed", "false_positive")).select(F.col("id").alias("incident_id"))
        eligible = alerts.join(shut, "incident_id", "left_anti")
    connections = events.where(F.col("conn_tuple").isNotNull())
    if asks is not None:
        span = asks.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).head()
        since = F.unix_micros(F.lit(span["lo"]).cast("timestamp")) - round(window.total_seconds() * 1e6)
        connections = connections.where((F.unix_micros("ts") >= since) & (F.col("ts") <= F.lit(span["hi"]).cast("timestamp")))
    picked = (
        (alerts if asks is None else asks)
        .join(lineage_parent(eligible, events, max_depth, asks), "id", "left")
        .join(gap_parent(eligible, window, asks), "id", "left")
        .join(lateral_parent(eligible, assets, connections, window, asks=asks), "id", "left")
    )
    reason = F.when(F.col("lineage_parent").isNotNull(), "lineage").when(F.col("gap_parent").isNotNull(), "asset").when(F.col("lateral_parent").isNotNull(), "lateral").otherwise("new")
    chosen = picked.withColumns({"parent_alert_id": F.coalesce("lineage_parent", "gap_parent", "lateral_parent"), "reason": reason}).drop("lineage_parent", "gap_parent", "lateral_parent")
    if existing is None:
        chosen = stored(chosen, "incident-parents")
        return chosen.join(roots(chosen.select("id", F.col("parent_alert_id").alias("parent"))).withColumnRenamed("root", "incident_id"), "id")
    chosen = stored(chosen.drop("incident_id"), "incident-parents")
    top = roots(chosen.select("id", F.col("parent_alert_id").alias("parent")))
    of_root = alerts.select(F.col("id").alias("root"), F.col("incident_id").alias("_known"))
    placed = chosen.join(top, "id").join(of_root, "root", "left").withColumn("incident_id", F.coalesce("_known", "root")).drop("_known", "root")
    return alerts.where(F.col("incident_id").isNotNull()).unionByName(placed, allowMissingColumns=True)


def reopened(incidents: DataFrame, assigned: DataFrame) -> DataFrame:
    """Incidents with their status: a triaged one that gained an alert is open again."""
    gained = assigned.where(F.col("parent_alert_id").isNotNull()).select(F.col("incident_id").alias("id")).distinct().withColumn("_gained", F.lit(True))
    return incidents.join(gained, "id", "left").withColumn("status", F.when((F.col("status") == "triaged") & F.col("_gained"), "open").otherwise(F.col("status"))).drop("_gained")


def graph_label(class_uid: Column, raw: Column) -> Column:
    """What an event's node is called: DNS name, else server name, else address and port, else `connection` for network events; `name (pid)` or `process` for others."""
    v = F.try_parse_json(raw)
    at = lambda path, kind="string": F.try_variant_get(v, path, kind)
    text = lambda path: F.nullif(at(path), F.lit(""))
    conn = F.coalesce(F.concat(F.lit("DNS "), text("$.query.hostname")), text("$.tls.sni"), F.concat(text("$.dst_endpoint.ip"), F.lit(":"), F.coalesce(at("$.dst_endpoint.port", "int"), F.lit(0)).cast("string")), F.lit("connection"))
    name, pid = text("$.process.name"), at("$.process.pid", "bigint").cast("string")
    process = F.coalesce(F.concat(name, F.lit(" ("), pid, F.lit(")")), name, F.lit("process"))
    return F.when(class_uid.isin(4001, 4003), conn).otherwise(process)


def incident_graph(assigned: DataFrame, titles: DataFrame | None = None, max_nodes: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, overflow) of incidents. assigned: id, ts, incident_id, asset_id, rule_id, process_guid, conn_tuple, parent_alert_id, reason, and, if the nodes are to have names, hostname and label (see `graph_label`).

    An alert is attached if its incident had fewer than `max_nodes` different nodes before it, else it counts as overflow.
    """
    node = lambda kind, key, label: F.struct(F.concat_ws(":", F.lit(kind), key).alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"))
    col = F.col
    named = assigned if titles is None else assigned.join(titles, "rule_id", "left")
    label = F.coalesce("title", "rule_id") if titles is not None else col("rule_id")
    name = lambda own, key: F.coalesce(col(own), col(key).cast("string")) if own in assigned.columns else col(key)
    asset = F.when(col("asset_id").isNotNull(), node("asset", col("asset_id").cast("string"), name("hostname", "asset_id")))
    process = F.when(col("process_guid").isNotNull(), node("process", col("process_guid").cast("string"), name("label", "process_guid")))
    conn = F.when(col("conn_tuple").isNotNull(), node("connection", col("conn_tuple"), name("label", "conn_tuple")))
    alert = node("alert", col("id").cast("string"), label)
    own = named.withColumn("_nodes", F.filter(F.array(asset, alert, process, conn), lambda x: x.isNotNull()))
    order = Window.partitionBy("incident_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    long = own.select("incident_id", "id", "ts", F.explode("_nodes").alias("n")).withColumn("n", F.col("n.id"))
    first = long.groupBy("incident_id", "n").agg(F.min(F.struct("ts", "id")).alias("f"))
    fresh = first.groupBy("incident_id", col("f.id").alias("id")).agg(F.count("*").alias("_fresh"))
    counted = own.join(fresh, ["incident_id", "id"], "left").withColumn("_before", F.coalesce(F.sum(F.coalesce("_fresh", F.lit(0))).over(order), F.lit(0)))
    attached = counted.where(col("_before") < max_nodes)
    overflow = counted.where(col("_before") >= max_nodes).groupBy("incident_id").agg(F.count("*").alias("overflow"))
    nodes = attached.select("incident_id", "ts", F.explode("_nodes").alias("n")).groupBy("incident_id", "n.id", "n.type").agg(F.min_by("n.label", F.struct("ts", "n.label")).alias("label"), F.min("ts").alias("first_ts"))
    edge = lambda a, b, rel: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("from"), b.alias("to"), F.lit(rel).alias("rel")))
    actor = F.coalesce(process["id"], conn["id"])
    parent = F.concat_ws(":", F.lit("alert"), col("parent_alert_id").cast("string"))
    edges = F.array(
        edge(asset["id"], actor, "hosts"),
        edge(F.coalesce(actor, asset["id"]), alert["id"], "triggered"),
        F.when(col("parent_alert_id").isNotNull() & (col("reason") == "lineage"), edge(parent, alert["id"], "spawned")),
        F.when(col("parent_alert_id").isNotNull() & (col("reason") == "lateral"), edge(parent, alert["id"], "lateral")),
    )
    links = attached.select("incident_id", F.explode(F.filter(edges, lambda x: x.isNotNull())).alias("e")).select("incident_id", "e.from", "e.to", "e.rel").distinct()
    return nodes, links, overflow
