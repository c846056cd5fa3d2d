"""Operator 13: the trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first turns (role and text); its members are the conversations that begin with it.

1.  Turns are numbered by one sort that is dealt by ranges, so that a long conversation lies in many tasks. From there on
    a turn is a digest of 128 bits with its number of bytes; no text moves.
2.  The digest of a prefix is the XOR of its turns' hashes, each taken with the turn's place (two hashes of 64 bits).
    Running values are taken in slices of SLICE turns, and slices are carried on by their last values. A parent's digest is the node's without its last turn.
3.  A count-min sketch of all prefixes (two rows of counters that stop at two, four counters a prefix and at most MOST_CELLS a row)
    is made by aggregates and sent to the tasks. It never counts too little: an estimate of one proves that a
    conversation alone has the prefix. Such tails are emitted where they lie, and only prefixes that may be shared are shuffled and
    grouped exactly. Where the sketch is too full it proves less, and more is grouped; results are the same.
4.  The smallest member of a node is also that of its nodes further down on its own path, so each conversation owns the last
    part of its path, from depth s on, and each node has one owner. So sums over a subtree are sums over members:
    leaves are those that its members own, and the bytes saved are those of each member between the node and its own part. No tree is climbed.
5.  Ids of those who end at a node are hashed in order: sorted by ranges, joined to pieces in the tasks, and the pieces of a node streamed through SHA-256.

Defined results: null role or text is empty; equal turns numbers stand by role, then by digest; rows with a null conversation id belong to no conversation
and are left out; repeated rows are turns of their own; conversations without turns belong to the root alone; an empty table gives no
node; other columns are ignored. Ids are whole numbers. Two prefixes are one if their 128-bit digests are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, tidily

SLICE = 256
MOST_CELLS = 1 << 27  # counters a row, two bits each: both rows are 64 MB
CHUNK = 16  # counters travel in pieces of 2^CHUNK
NOBODY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, len, key, n_bytes): each turn with its place from 0, its conversation's number of turns, its digest and its text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(order_col).alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "key", "n_bytes", F.monotonically_increasing_id().alias("row"))
    # A row's number holds its task and its place there.
    ranged = stored(ranged.select("conv", F.shiftright("row", 33).alias("part"), "row", "key", "n_bytes"), "trie-ranged")
    parts = ranged.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count("*").alias("size"))
    whole = Window.partitionBy("conv")
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv", "part", (F.col("first") - before).alias("first"), F.sum("size").over(whole).alias("len"))
    return ranged.join(parts, ["conv", "part"]).select("conv", (F.col("row") - F.col("first")).alias("at"), "len", "key", "n_bytes")


def rebuilt(turns: DataFrame, share: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, (conv, len) of all conversations), rebuilt: the first h turns of conversation c - c % share, then c's own after its first h; h = crc32(decimal c) % (most + 1)."""
    sizes = turns.where("at = 0").select("conv", F.col("len").alias("own"))
    c = F.col("conv")
    given = sizes.select("conv", "own", (c - c % share).alias("base"), (F.crc32(c.cast("string").cast("binary")) % (most + 1)).alias("h"))
    donors = sizes.select(F.col("conv").alias("base"), F.col("own").alias("theirs"))
    taken = F.least("h", F.coalesce("theirs", F.lit(0)))
    given = stored(given.join(donors, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "trie-rebuilt")
    own = turns.drop("len").join(given, "conv").where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "len", "key", "n_bytes")
    heads = turns.where(F.col("at") < most).select(F.col("conv").alias("base"), "at", "key", "n_bytes")
    theirs = heads.join(given, "base").where("at < taken").select("conv", "at", "len", "key", "n_bytes")
    return own.union(theirs), given.select("conv", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, len, k1, k2, p1, p2, n_bytes, before): the digest of each prefix and of its parent, and the bytes before its last turn."""
    h1, h2 = F.xxhash64("key", "at"), F.xxhash64("at", "key")
    rows = turns.select("conv", "at", "len", "n_bytes", h1.alias("h1"), h2.alias("h2"), F.expr(f"at div {SLICE}").alias("slice"))
    upto = Window.partitionBy("conv", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = stored(rows.select("conv", "at", "len", "n_bytes", "h1", "h2", "slice", *[F.bit_xor(h).over(upto).alias(k) for h, k in (("h1", "k1"), ("h2", "k2"))], F.sum("n_bytes").over(upto).alias("upto")), "trie-slices")
    ends = rows.where(F.col("at") % SLICE == SLICE - 1)
    done = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.select("conv", (F.col("slice") + 1).alias("slice"), *[F.bit_xor(k).over(done).alias(c) for k, c in (("k1", "c1"), ("k2", "c2"))], F.sum("upto").over(done).alias("carried"))
    rows = rows.join(carried, ["conv", "slice"], "left")
    k1, k2 = (F.col(k).bitwiseXOR(F.coalesce(F.col(c), F.lit(0))) for k, c in (("k1", "c1"), ("k2", "c2")))
    before = F.col("upto") + F.coalesce(F.col("carried"), F.lit(0)) - F.col("n_bytes")
    return rows.select("conv", (F.col("at") + 1).alias("depth"), "len", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("h1")).alias("p1"), k2.bitwiseXOR(F.col("h2")).alias("p2"), "n_bytes", before.alias("before"))


# The sketch


def _places(k1: np.ndarray, k2: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of each prefix: one in each row, the second after the first."""
    return k1 & (cells - 1), (k2 & (cells - 1)) + cells


def _counts(cells: int, bits: int):
    """(k1, k2) to (chunk, the counters that are met once, those met more often), some batches together."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        places, counts = np.unique(np.concatenate(held), return_counts=True)
        chunk = places >> bits
        cuts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        columns: list[list] = [[], [], []]
        for a, b in zip(cuts, np.append(cuts[1:], len(places)), strict=True):
            offsets, often = (places[a:b] & ((1 << bits) - 1)).astype(np.uint16), counts[a:b] > 1
            for column, value in zip(columns, (int(chunk[a]), offsets[~often].tobytes(), offsets[often].tobytes()), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(x, pa.binary()) for x in columns[1:]]], ["chunk", "once", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.extend(_places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells))
            size += len(batch)
            if size > 500_000:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    return run


def _joined(bits: int):
    """Rows sorted by chunk to (chunk, its counters), four counters a byte."""

    def packed(key: int, counters: np.ndarray) -> pa.RecordBatch:
        four = counters.reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([(four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()], pa.binary())], ["chunk", "counters"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counters = None, np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for chunk, once, often in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != key:
                    if key is not None:
                        yield packed(key, counters)
                    key, counters = chunk, np.zeros(1 << bits, np.uint8)
                at = np.frombuffer(once, np.uint16)
                counters[at] = np.minimum(counters[at] + 1, 2)
                counters[np.frombuffer(often, np.uint16)] = 2
        if key is not None:
            yield packed(key, counters)

    return run


def screen(rows: DataFrame, cells: int | None = None):
    """A column function (k1, k2) -> whether the count-min estimate of that prefix is one. rows is stored."""
    if cells is None:
        cells = 1 << min(max((4 * rows.count()).bit_length(), CHUNK), MOST_CELLS.bit_length() - 1)
    bits = min(CHUNK, (2 * cells).bit_length() - 1)
    chunks = rows.select("k1", "k2").mapInArrow(_counts(cells, bits), "chunk long, once binary, often binary")
    chunks = chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_joined(bits), "chunk long, counters binary")
    packed = np.zeros(2 * cells // 4, np.uint8)
    width = (1 << bits) // 4
    for row in chunks.toLocalIterator():  # of a bounded size: both rows of counters
        packed[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["counters"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def alone(k1: pd.Series, k2: pd.Series) -> pd.Series:
        one = np.ones(len(k1), bool)
        for at in _places(k1.to_numpy(), k2.to_numpy(), cells):
            one &= (sent.value[at >> 2] >> ((at & 3) << 1).astype(np.uint8)) & 3 == 1
        return pd.Series(one)

    return alone


# Those who end at a node


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation to one row for each node of a batch: its ids, joined."""
    for batch in batches:
        k1, k2, conv = (c.to_numpy() for c in batch.columns)
        if not len(conv):
            continue
        cuts = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(conv)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(conv[cuts]), pa.array(texts)], ["k1", "k2", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id to the SHA-256 of each node's."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        out = []
        for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2) == node:
                digest.update(b",")
            else:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (k1, k2), hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["k1", "k2", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([digest.hexdigest()])], ["k1", "k2", "ends"])


def ends_of(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends) of (k1, k2, conv)."""
    order = ["k1", "k2", "conv"]
    pieces = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "k1 long, k2 long, first long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, ends string")


# The trie


def prefix_trie(turns: DataFrame, conversations: DataFrame, cells: int | None = None) -> DataFrame:
    """turns as of numbered, conversations: (conv, len) of all, also those without turns. One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes), ends_sha256."""
    return tidily("trie", lambda: _prefix_trie(turns, conversations, cells))


def _prefix_trie(turns: DataFrame, conversations: DataFrame, cells: int | None) -> DataFrame:
    rows = stored(prefixes(turns), "trie-prefixes")
    alone = screen(rows, cells)
    parent_alone = (F.col("depth") > 1) & alone("p1", "p2")
    rows = stored(rows.select("*", alone("k1", "k2").alias("alone"), parent_alone.alias("parent_alone")), "trie-screened")
    tails = rows.where("alone")
    tops = tails.where("not parent_alone")
    zero = F.lit(0).cast("long")
    # A prefix below one that is proven to be alone may lack a proof of its own; it is grouped, and its parent is its conversation's.
    root = conversations.select("conv", zero.alias("depth"), F.col("len").cast("long").alias("len"), *[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "n_bytes", "before")], F.lit(False).alias("parent_alone"))
    shared = rows.where("not alone").select(*root.columns).union(root)
    node = ["k1", "k2"]

    nodes = stored(shared.groupBy(*node).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("depth", "p1", "p2", "before", "parent_alone")]), "trie-nodes")
    below = nodes.where("depth > 0").select("p1", "p2").union(tops.select("p1", "p2"))
    children = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-children")

    # The part of its path that each conversation owns: from its least depth on, with the bytes before; none: past its end.
    last = shared.where("depth = len").select("conv", (F.col("depth") + 1).alias("depth"), (F.col("before") + F.col("n_bytes")).alias("before"), zero.alias("leaf"))
    parts = nodes.select(F.col("conv_id").alias("conv"), "depth", "before", (F.col("n_children") == 0).cast("long").alias("leaf")).union(tops.select("conv", "depth", "before", F.lit(1).cast("long").alias("leaf"))).union(last)
    owned = parts.groupBy("conv").agg(F.min(F.struct("depth", "before")).alias("own"), F.max("leaf").alias("leaf"))
    saved = F.when(F.col("depth") < F.col("own.depth"), F.col("own.before") - F.col("before")).otherwise(0)
    sums = shared.join(owned, "conv").groupBy(*node).agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))

    # Parents: the owners of the nodes above; of tails, above their tops.
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    own = nodes.join(sums, node).join(ends_of(shared.where("depth = len")), node, "left").select("p1", "p2", "parent_alone", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))
    ends = F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(NOBODY)
    tail = tails.select("p1", "p2", "parent_alone", F.col("conv").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), ends.alias("ends_sha256"))
    names = ["conv_id", "depth", "parent_conv_id", *own.columns[5:]]
    both = own.where("depth > 0").union(tail)
    hanging = both.where("not parent_alone").join(above, ["p1", "p2"])
    inner = both.where("parent_alone").withColumn("parent_conv_id", F.col("conv_id"))
    top = own.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return hanging.select(*names).union(inner.select(*names)).union(top.select(*names))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are."""

    def make() -> DataFrame:
        turns = stored(numbered(conversations, conv_col, order_col, role_col, text_col), "trie-turns")
        return prefix_trie(turns, turns.where("at = 0").select("conv", "len"))

    return tidily("trie-whole", make)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt by the rule of rebuilt()."""

    def make() -> DataFrame:
        turns = stored(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
        return prefix_trie(*rebuilt(turns))

    return tidily("trie-op13", make)


def oracle() -> str:
    """The same from paths of whole turn digests, with all pairs of a conversation's prefixes."""
    crc = "list_reduce(range(8), lambda a, _: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, xor(c, b))"
    h = f"xor(list_reduce(list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::int, 1))::bigint), lambda c, b: {crc}, 4294967295::bigint), 4294967295) % 9"
    return f"""
    with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    k as (select *, md5(strlen(role) || ':' || role || text) as key from t),
    o as (select conv_id, key, strlen(text) as b, row_number() over (partition by conv_id order by turn nulls first, role, key) as pos from k),
    c as (select conv_id, {h} as h from (select distinct conv_id from t)),
    donor as (select c.conv_id, o.key, o.b, o.pos from c join o on o.conv_id = c.conv_id - c.conv_id % 5 where o.pos <= c.h),
    own as (select c.conv_id, o.key, o.b, o.pos + 100000 as pos from c join o using (conv_id) where o.pos > c.h),
    r as (select conv_id, key, b, row_number() over (partition by conv_id order by pos) as d from (select * from donor union all select * from own)),
    p as (select conv_id, d, b, string_agg(key, '' order by d) over (partition by conv_id order by d) as path from r union all select conv_id, 0, 0, '' from c),
    e as (select conv_id, max(d) as len from p group by conv_id),
    n as (select path, any_value(d) as d, min(conv_id) as conv_id, count(*) as n_convs, any_value(b) as b from p group by path),
    kids as (select left(path, 32 * (d - 1)) as path, count(*) as n_children from n where d > 0 group by all),
    f as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (path)),
    under as (select distinct v.path, u.path as low from p v join p u on v.conv_id = u.conv_id and u.d >= v.d),
    s as (select under.path, count(*) filter (f.n_children = 0) as n_leaves, sum((f.n_convs - 1) * f.b)::bigint as saved_tokens from under join f on f.path = under.low group by under.path),
    x as (select p.path, string_agg(p.conv_id::varchar, ',' order by p.conv_id) as ids from p join e on e.conv_id = p.conv_id and e.len = p.d group by p.path)
    select f.conv_id, f.d::bigint as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children::bigint as n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
    from f join s using (path) left join x using (path) left join n up on f.d > 0 and up.path = left(f.path, 32 * (f.d - 1))"""
