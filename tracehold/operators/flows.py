"""Flow assembly from packet rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import client_is_a, flow_key

FIN, RST = 1, 4


def assemble_flows(packets: DataFrame, idle: timedelta = timedelta(seconds=30), lifetime: timedelta = timedelta(seconds=300), grace: timedelta = timedelta(seconds=5), meta: tuple[str, ...] = ()) -> DataFrame:
    """packets: ts, src_ip, sport, dst_ip, dport, proto, tcp_flags, frame_len. One row a flow, both directions of a pair of ends together.

    meta: columns that decoders add to packets (names, hashes); of each the flow has the first that is not null.

    A flow ends when no packet came for `idle`, at `lifetime` after its first packet, and `grace` after its first FIN or RST.
    Idle gaps are window functions; lifetime is the anchored fold of the run between gaps.
    """
    k = flow_key(F.col("src_ip"), F.col("sport"), F.col("dst_ip"), F.col("dport"))
    rows = packets.select("*", F.inline(F.array(k))).withColumn("_t", F.unix_micros("ts"))
    ends = ["proto", "a", "a_port", "b", "b_port"]
    order = Window.partitionBy(*ends).orderBy("_t")
    gap = round(idle.total_seconds() * 1e6)
    times = rows.groupBy(*ends, "_t").agg(F.bool_or(F.col("tcp_flags").bitwiseAND(F.lit(FIN | RST)) != 0).alias("_fin"))
    runs = times.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(order) >= gap).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    life, soon = round(lifetime.total_seconds() * 1e6), round(grace.total_seconds() * 1e6)
    start = F.struct(F.lit(None).cast("bigint").alias("open"), F.lit(None).cast("bigint").alias("fin"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        opens = acc["open"].isNull() | (p["_t"] - acc["open"] >= life) | F.coalesce(p["_t"] - acc["fin"] > soon, F.lit(False))
        fin = F.when(p["_fin"], p["_t"])
        fresh = F.struct(p["_t"].alias("open"), fin.alias("fin"), F.concat(acc["out"], F.array(p["_t"])).alias("out"))
        return F.when(opens, fresh).otherwise(F.struct(acc["open"].alias("open"), F.coalesce(acc["fin"], fin).alias("fin"), acc["out"].alias("out")))

    fold = F.aggregate(F.sort_array(F.collect_list(F.struct("_t", "_fin"))), start, step, lambda acc: acc["out"])
    openers = runs.groupBy(*ends, "_run").agg(fold.alias("_o")).select(*ends, F.explode("_o").alias("_t"), F.lit(True).alias("_opens"))
    marked = times.select(*ends, "_t", F.lit(False).alias("_opens")).unionByName(openers).groupBy(*ends, "_t").agg(F.max("_opens").alias("_opens"))
    placed = marked.withColumn("flow_start", F.last(F.when(F.col("_opens"), F.col("_t")), ignorenulls=True).over(order)).drop("_opens")
    flows = rows.join(placed, [*ends, "_t"])
    first = F.min(F.struct("_t", F.col("forward"), F.col("tcp_flags")))
    count = lambda forward: F.count_if(F.col("forward") == forward)
    size = lambda forward: F.coalesce(F.sum(F.when(F.col("forward") == forward, F.col("frame_len"))), F.lit(0))
    flags = F.bit_or("tcp_flags")
    out = flows.groupBy(*ends, "flow_start").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), count(True).alias("a_packets"), size(True).alias("a_bytes"), count(False).alias("b_packets"), size(False).alias("b_bytes"), flags.alias("tcp_flags"), first.alias("_first"), F.min(F.when(F.col("tcp_flags").bitwiseAND(F.lit(FIN | RST)) != 0, F.col("ts"))).alias("fin_ts"), *[F.min(F.when(F.col(c).isNotNull(), F.struct("_t", c)))[c].alias(c) for c in meta])
    return out.withColumn("client_is_a", client_is_a(F.col("_first.tcp_flags"), F.col("_first.forward"))).drop("_first", "flow_start")


def orient_flow(flows: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """Source is the client; counters follow."""
    client = F.col("client_is_a")
    pick = lambda x, y: F.when(client, F.col(x)).otherwise(F.col(y))
    return flows.select("proto", pick("a", "b").alias("src_ip"), pick("a_port", "b_port").alias("src_port"), pick("b", "a").alias("dst_ip"), pick("b_port", "a_port").alias("dst_port"), pick("a_packets", "b_packets").alias("src_packets"), pick("a_bytes", "b_bytes").alias("src_bytes"), pick("b_packets", "a_packets").alias("dst_packets"), pick("b_bytes", "a_bytes").alias("dst_bytes"), "tcp_flags", "first_ts", "last_ts", *meta)


