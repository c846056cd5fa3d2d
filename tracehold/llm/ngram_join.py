"""Operator 9: n-gram Jaccard self-join by token-combination prefixes.

A document is the set of its distinct n-word shingles, each a 64-bit hash (sets and bounds are exact up to hash collisions). Two documents link if
100 * intersection >= percent * union. Links are found without comparing all pairs:

1.  Equal sets collapse to one representative, the smallest id.
2.  All sets share one order of tokens: rare class first, then frequent class. Words are counted over all documents in
    2^16 hashed buckets and shingles in 2^20. A token is frequent if its bucket holds HOT_TIMES the mean or more, so a rare one
    is in few documents, whatever passages they share; rare tokens come in 63 classes by the product of their words'
    shares, rarest first. A set of n tokens may miss t = n - ceil(n * percent / 100) of them in
    a partner. Its prefix is extended until it covers t + 1 misses: a rare token covers one and is indexed alone; the
    frequent class is cut into subclasses, c prefix tokens of a subclass cover c - 1, and their pairs are indexed. Of two
    linked sets the one whose prefix ends first keeps a token, or two of one subclass, that its partner's prefix has too.
    So every link shares an index entry. Sizes fall into bands, each with its own number of subclasses; a set that may
    have a partner in the next band counts there as well.
3.  Entries that one set alone has are left behind in the one shuffle of the entries. First the sets of an entry meet one of
    them, the smallest id and then, while that finds links, others in turn, so that groups of copies grow together by
    stars and not by all pairs. Then, within entries whose sets are still in several components, the pairs
    across components are compared, in blocks of bounded size. A parity bitmap of each set bounds the size of the symmetric
    difference from below and drops nearly all pairs that don't link; it never drops one that does. What is left is verified
    on the full sets, a few pairs of each two components at a time, as one link joins them.
4.  Components of the verified links, by label propagation over tables.

An entry of any size is dealt out in blocks and nothing is capped. Tables that must outlive a stage are written to the
shared folder.

Defined results: null or blank text has an empty set, which links with nothing; fewer words than n make one shingle of
the whole sequence; an empty table gives an empty result; repeated rows of one id and text are returned as often
as they come; an id with several texts is one document to what links with any of them: the rows of an id are in one component; a null id links with nothing and has a null
component; percent 100 links equal sets only; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, ordered_keys, several_texts, small_batches, small_join, stored, tidily, words

WORD_BUCKETS, SHINGLE_BUCKETS, CHUNK, HOT_TIMES = 1 << 16, 1 << 20, 1 << 14, 4
RARITY_BITS = 20  # a word's rarity, as bits: what is rarer than a share of 2^-20 counts as that
BAND_RATIO, BLOCK = 1.5, 1000
FEW_PAIRS = 2  # pairs of two components that are verified first; eight times as many in each turn that follows
STARS = 3  # most turns in which the sets of an entry meet one of them; the pass over all pairs makes the result whole
CANDIDATE_IDS = 2_000_000  # so many ids are broadcast to pick texts out of the scan, else they are joined by shuffle


# Sets of shingles


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a public 64-bit hash: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class TokenOrder:
    """What the counts say, by bucket: bits of rarity for words; whether it is frequent, eight buckets a byte, for shingles."""

    rarity: np.ndarray
    frequent: np.ndarray


def word_hashes(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all lists, where each list begins and the last ends)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_hashes(w: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(len(w) - n + 1, 0), np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(31) + w[k : k + len(h)])
    return h


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x % np.uint64(buckets)).astype(np.int64)


def shingle_sets(lists: pa.ListArray, n: int, order: TokenOrder) -> Iterator[np.ndarray]:
    """For each list of word hashes its sorted distinct tokens: six bits of class, rarest first, then hash; the lowest bit is set if the token is frequent."""
    w, offsets = word_hashes(lists)
    h = shingle_hashes(w, n)
    rare = order.rarity[bucket_of(w, WORD_BUCKETS)]
    rarity = np.zeros(len(h), np.float32)
    for k in range(n):
        rarity += rare[k : k + len(h)]
    bucket = bucket_of(h, SHINGLE_BUCKETS)
    often = (order.frequent[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1
    kind = 62 - np.minimum(rarity * np.float32(62 / (n * RARITY_BITS)), 62).astype(np.uint64)
    kind = np.where(often, np.uint64(63), kind)
    h = (kind << np.uint64(58)) | ((h >> np.uint64(6)) & ~np.uint64(1)) | often.astype(np.uint64)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            yield np.unique(h[a : b - n + 1])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = mix(x * np.uint64(31) + w[k : k + 1])
            yield x & ~np.uint64(1)
        else:
            yield np.zeros(0, np.uint64)


def least_partner(n: int, percent: int) -> int:
    """Smallest overlap that a set of n tokens has with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def band_edges(percent: int, top: int = 1 << 40) -> list[int]:
    """Smaller sets than the first edge link with equal ones only."""
    if percent >= 100:
        return [top]
    edges = [max(1, -(-percent // (100 - percent)))]
    while edges[-1] < top:
        edges.append(int(edges[-1] * BAND_RATIO) + 1)
    return edges


def entries_of(u: np.ndarray, percent: int, edges: list[int]) -> np.ndarray:
    """Index entries of the set u: even ones of rare tokens; odd ones of pairs of frequent tokens, for its band and, where a partner may be there, the next one."""
    n = len(u)
    if n < edges[0]:
        return np.zeros(0, np.uint64)
    one = np.uint64(1)
    need = n - least_partner(n, percent) + 1
    rare, frequent = u[(u & one) == 0], u[(u & one) == 1]
    out = [mix(rare[:need]) & ~one]
    band = int(np.searchsorted(edges, n, "right")) - 1
    for b in (band, band + 1) if len(rare) < need else ():
        if b > band and least_partner(edges[b], percent) > n:
            break
        salt = np.uint64(2 * b + 1)
        # With so many subclasses at most, even one token each of them leaves cover enough.
        classes = max(1, least_partner(least_partner(edges[b], percent), percent) - 1)
        group = ((frequent >> one) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        often, group = frequent[order], group[order]
        sizes = np.bincount(group, minlength=classes)
        cover = np.cumsum(np.maximum(sizes - 1, 0))
        last = int(np.searchsorted(cover, need - len(rare)))
        if last == classes:
            raise AssertionError("prefix doesn't cover the misses")
        stop = int(sizes[: last + 1].sum())
        often, group = often[:stop], group[:stop]
        for d in range(1, int(sizes[: last + 1].max())):
            pair = group[d:] == group[:-d]
            out.append(mix(mix(often[:-d][pair] + salt) * np.uint64(31) + often[d:][pair]) | one)
    return np.unique(np.concatenate(out))


def parity_bitmap(u: np.ndarray, percent: int) -> bytes:
    """A power of two of bits, eight times the tokens by which a partner may differ or more; each token flips one. Where two bitmaps differ in d bits, the sets differ in d tokens at least."""
    width = 64
    while width * (100 + percent) < 16 * len(u) * (100 - percent):
        width *= 2
    flips = np.bincount(((u >> np.uint64(1)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to `width` words."""
    while bitmap.shape[-1] > width:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


# Stages


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    hashes = F.transform(words(ascii_lower(F.col(text_col))), lambda w: F.xxhash64(w))
    return docs.select(F.col(id_col).alias("id"), hashes.alias("w"))


def token_order(docs: DataFrame, n: int, text_col: str = "text") -> TokenOrder:
    """Counts of words and of n-word shingles by bucket, over all documents. A task sends its counts in chunks of four bytes a bucket; so many sums, whatever the input, reach the driver."""
    size = WORD_BUCKETS + SHINGLE_BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            w, offsets = word_hashes(batch.column(0))
            total[:WORD_BUCKETS] += np.bincount(bucket_of(w, WORD_BUCKETS), minlength=WORD_BUCKETS).astype(np.uint32)
            h = shingle_hashes(w, n)
            inside = np.ones(len(h), bool)  # not those that reach into the next document
            for k in range(1, n):
                at = offsets[1:-1] - k
                inside[at[(at >= 0) & (at < len(h))]] = False
            total[WORD_BUCKETS:] += np.bincount(bucket_of(h[inside], SHINGLE_BUCKETS), minlength=SHINGLE_BUCKETS).astype(np.uint32)
        for k in range(0, size, CHUNK):
            if total[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([total[k : k + CHUNK].tobytes()], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(k, np.zeros(CHUNK, np.uint64))
                sums[k] += np.frombuffer(counts.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    hashed = docs.select(F.transform(words(ascii_lower(F.col(text_col))), lambda w: F.xxhash64(w)).alias("w"))
    counts = np.zeros(size, np.uint64)
    for r in hashed.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint64)
    word, shingle = counts[:WORD_BUCKETS], counts[WORD_BUCKETS:]
    share = word / max(int(word.sum()), 1)
    rarity = np.minimum(-np.log2(np.maximum(share, 2.0**-RARITY_BITS)), RARITY_BITS).astype(np.float32)
    return TokenOrder(rarity, np.packbits(shingle >= max(HOT_TIMES * int(shingle.sum()) / SHINGLE_BUCKETS, 8 * HOT_TIMES), bitorder="little"))


def index_sets(docs: DataFrame, order: TokenOrder, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, entries, bitmap), one row a document; key is a 128-bit digest of the set."""
    edges = band_edges(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, entries, bitmaps = [], [], [], []
            for u in shingle_sets(batch.column(1), n, order):
                sizes.append(len(u))
                keys.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                entries.append(entries_of(u, percent, edges).view(np.int64))
                bitmaps.append(parity_bitmap(u, percent) if len(u) >= edges[0] else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(entries, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary())], ["id", "n", "key", "entries", "bitmap"])

    hashed = _hashed(docs, id_col, text_col)
    return hashed.mapInArrow(run, f"id {dict(hashed.dtypes)['id']}, n long, key binary, entries array<long>, bitmap binary")


def token_sets(docs: DataFrame, order: TokenOrder, n: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [u.view(np.int64) for u in shingle_sets(batch.column(1), n, order)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "tokens"])

    hashed = _hashed(docs, id_col, text_col)
    return hashed.mapInArrow(run, f"id {dict(hashed.dtypes)['id']}, tokens array<long>")


def _may_link(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs with a_n, a_bits, b_n, b_bits: those that the bitmaps don't rule out, as (a, b)."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                width = min(len(x), len(y))
                d = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                keep.append(d * (100 + percent) <= (100 - percent) * n.as_py())
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "a_bits", "b_bits", (F.col("a_n") + F.col("b_n")).alias("n")).mapInArrow(run, f"a {kind}, b {kind}")


def _with_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) with the size and bitmap of both."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("bitmap").alias(f"{side}_bits")), side)
    return pairs.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)


def verify(pairs: DataFrame, docs: DataFrame, order: TokenOrder, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """pairs (stored): the links among them, by their full sets. Only the texts of these pairs are read into sets."""
    ids = stored(pairs.select(F.col("a").alias(id_col)).union(pairs.select("b")).distinct(), "ngram-ids")
    texts = small_join(docs.select(id_col, text_col), ids, [id_col], "left_semi", CANDIDATE_IDS)
    tokens = stored(token_sets(texts, order, n, id_col, text_col), "ngram-tokens")
    left = pairs.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in edges (a, b; stored): label is the smallest id it is connected with.

    In each turn an id takes the smallest label of its neighbours, then that label's own label, until nothing moves.
    """
    both = edges.union(edges.select("b", "a")).toDF("id", "other")
    labels = stored(both.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        jumped = moved.join(labels.select(F.col("id").alias("step"), F.col("label").alias("far")), "step", "left")
        new = stored(jumped.select("id", "old", F.least("step", F.coalesce("far", "step")).alias("label")), "labels")
        labels = new.select("id", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def _across(members: DataFrame, percent: int) -> DataFrame:
    """members: entry, band, part_a, part_b, id, label, n, bitmap, side. Pairs (a, b) of different labels that the bitmaps don't rule out, within each block."""
    kind = dict(members.dtypes)["id"]
    keys = ("entry", "band", "part_a", "part_b")
    cols = (*keys, "id", "label", "n", "side", "bitmap")

    def compare(rows: dict[str, list]) -> Iterator[tuple]:
        width = min(len(x) for x in rows["bitmap"]) // 8
        bits = np.stack([folded(np.frombuffer(x, np.uint64), width) for x in rows["bitmap"]])
        n, side = np.array(rows["n"]), np.array(rows["side"])
        label = np.unique(np.array(rows["label"]), return_inverse=True)[1]
        same_block = rows["part_a"][0] == rows["part_b"][0]
        for k in range(len(n)):
            if not same_block and side[k]:
                continue
            other = np.arange(k + 1, len(n)) if same_block else np.flatnonzero(side == 1)
            other = other[label[other] != label[k]]
            if len(other):
                d = np.bitwise_count(bits[other] ^ bits[k]).sum(axis=1, dtype=np.int64)
                near = (d * (100 + percent) <= (100 - percent) * (n[other] + n[k])) & (np.minimum(n[other], n[k]) * 100 >= np.maximum(n[other], n[k]) * percent)
                for j in other[near]:
                    yield tuple(sorted((rows["id"][k], rows["id"][j])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[str, list] = {c: [] for c in cols}
        last: tuple | None = None
        found: set[tuple] = set()

        def flush() -> None:
            if len(set(group["label"])) > 1:
                found.update(compare(group))

        for batch in batches:
            data = batch.to_pydict()
            own = list(zip(*[data[c] for c in keys], strict=True))
            start = 0
            for end in range(1, len(own) + 1):
                if end < len(own) and own[end] == own[start]:
                    continue
                if last is not None and last != own[start]:
                    flush()
                    group = {c: [] for c in cols}
                last = own[start]
                for c in cols:
                    group[c] += data[c][start:end]
                start = end
            if len(found) > 100_000:
                yield out(found)
                found.clear()
        flush()
        yield out(found)

    def out(found: set[tuple]) -> pa.RecordBatch:
        pairs = sorted(found)
        kind_pa = pa.int64() if kind in ("bigint", "int", "smallint") else pa.string()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind_pa) for k in (0, 1)], ["a", "b"])

    dealt = members.select(*cols).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _shared(entries: DataFrame) -> DataFrame:
    """entries: entry, id, n. Those that several sets have.

    Rare tokens are in few documents, so their entries are sorted after one shuffle and told by their neighbours. Pairs
    of frequent tokens may be in any number of them and are counted by an aggregate, which combines before it moves.
    """
    order = Window.partitionBy("entry").orderBy("id")
    odd = F.col("entry").bitwiseAND(F.lit(1)) == 1
    rare = entries.where(~odd).withColumns({"_before": F.lag("n").over(order), "_after": F.lead("n").over(order)})
    rare = rare.where(F.col("_before").isNotNull() | F.col("_after").isNotNull()).select("entry", "id", "n")
    pairs = entries.where(odd)
    several = pairs.groupBy("entry").agg(F.count("*").alias("_members")).where("_members > 1").select("entry")
    return rare.unionByName(pairs.join(several, "entry"))


def _in_bands(met: DataFrame, percent: int) -> DataFrame:
    """met (entry, id, n), once for the set's band and, where a partner may be there, once for the next."""
    edges = band_edges(percent)
    table = F.array(*[F.lit(e) for e in edges])
    reach = F.array(*[F.lit(least_partner(e, percent)) for e in edges])
    band = F.size(F.filter(table, lambda e: e <= F.col("n"))) - 1
    bands = F.when(F.coalesce(F.get(reach, F.col("_b") + 1) <= F.col("n"), F.lit(False)), F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array("_b"))
    return met.withColumn("_b", band).withColumn("band", F.explode(bands)).drop("_b")


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _star(met: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the sets of each entry (met: entry, band, id, n) with one of them, where they aren't in its component yet."""
    labelled = _labelled(met, labels)
    rank = F.lit(0).cast("long") if turn == 0 else F.xxhash64("id", F.lit(turn))
    center = F.min(F.struct(rank.alias("rank"), "id", "n", "label")).alias("center")
    several = labelled.groupBy("entry", "band").agg(center, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    close = F.least("n", "center.n") * 100 >= F.greatest("n", "center.n") * percent
    pairs = labelled.join(several, ["entry", "band"]).where((F.col("label") != F.col("center.label")) & close)
    return pairs.select(F.least("id", "center.id").alias("a"), F.greatest("id", "center.id").alias("b")).distinct()


class Found:
    """Verified links (a, b) and the components (id, label) that they make."""

    def __init__(self, links: DataFrame, labels: DataFrame):
        self.links, self.labels = links, labels

    def add(self, pairs: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> bool:
        """Adds the links among pairs (a, b; stored) that join components; whether there were any.

        Each turn verifies a few pairs of each two components that are still apart, and more in the next.
        """
        many, any_new = FEW_PAIRS, False
        while True:
            for side in ("a", "b"):
                pairs = pairs.join(self.labels.select(F.col("id").alias(side), F.col("label").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
            pairs = pairs.where("_a <> _b")
            order = Window.partitionBy(F.least("_a", "_b"), F.greatest("_a", "_b")).orderBy("a", "b")
            apart = stored(pairs.withColumn("_n", F.row_number().over(order)).select("a", "b", "_n"), "ngram-apart")
            if not apart.limit(1).count():
                return any_new
            new = stored(verified(apart.where(F.col("_n") <= many).select("a", "b")), "ngram-links")
            pairs, many = apart.where(F.col("_n") > many).select("a", "b"), many * 8
            if new.limit(1).count():
                any_new = True
                self.links = stored(self.links.union(new), "ngram-links")
                self.labels = components(self.links)


def ngram_links(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id), one row for each row of docs. id_col is a whole number or a string."""
    with small_batches(docs.sparkSession):
        return tidily("ngram-result", lambda: _id_links(docs, n, percent, id_col, text_col))


def _id_links(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """_links; where an id has several texts, each text is a document there, and the components that an id's texts are in become one."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    digest = F.sha2(F.coalesce("_text", F.lit("")), 256)
    if not several_texts(docs.where("_id is not null"), "_id", digest):
        return _links(docs.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col)), n, percent, id_col, text_col)
    rows = docs.withColumn("_sha", digest)
    keys = ordered_keys(rows.where("_id is not null").select("_id", "_sha").distinct(), "_id", "_sha")
    keyed = rows.join(keys, ["_id", "_sha"], "left").select("key", "_text")
    found = stored(_links(keyed, n, percent, "key", "_text"), "ngram-texts")
    of_id = stored(keys.select("key", "_id").join(found.where("key is not null").select("key", "component_id").distinct(), "key"), "ngram-text-ids")
    first = of_id.groupBy("_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("z")).where("a <> z").select("_id", "a")
    edges = stored(of_id.join(first, "_id").where("a <> component_id").select("a", F.col("component_id").alias("b")).distinct(), "ngram-id-edges")
    merged = components(edges).select(F.col("id").alias("component_id"), "label")
    names = keys.select(F.col("key").alias("label"), F.col("_id").alias("component"))
    of_key = of_id.join(merged, "component_id", "left").withColumn("label", F.coalesce("label", "component_id")).join(names, "label").select("key", "_id", "component")
    done = found.select("key", "n_shingles").join(of_key, "key", "left")
    return done.select(F.col("_id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))


def _links(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col), F.col(text_col))
    order = token_order(docs, n, text_col)
    base = stored(index_sets(docs, order, n, percent, id_col, text_col), "ngram-sets")
    groups = base.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"))
    chosen = groups.groupBy("rep").agg(F.min("key").alias("key")).where(F.col("rep").isNotNull())
    # What isn't chosen is told by short rows; while it was counted to be little, the sets themselves don't move.
    named = base.where("n > 0").select("id", "key").join(chosen.withColumnRenamed("key", "own"), F.col("id") == F.col("rep"), "left")
    others = stored(named.where(F.col("own").isNull() | (F.col("own") != F.col("key"))).select("id", "key").distinct(), "ngram-others")
    sets = small_join(base.where("n > 0 and id is not null"), others, ["id", "key"], "left_anti", CANDIDATE_IDS)

    met = stored(_in_bands(_shared(sets.select(F.explode("entries").alias("entry"), "id", "n")), percent), "ngram-met")
    slim = stored(sets.where(F.length("bitmap") > 0).select("id", "n", "bitmap"), "ngram-bitmaps")
    found = Found(stored(met.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), "ngram-links"), stored(met.select("id", F.col("id").alias("label")).limit(0), "labels"))
    settle = lambda pairs: found.add(pairs, lambda some: verify(some, docs, order, n, percent, id_col, text_col))
    for turn in range(STARS):
        pairs = _star(met, found.labels, turn, percent)
        if not settle(stored(_may_link(_with_sets(pairs, slim, percent), percent), "ngram-pairs")):
            break

    # Entries of three sets or more that are still in several components.
    labelled = _labelled(met.select("entry", "band", "id"), found.labels)
    open_entries = labelled.groupBy("entry", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).where("lo <> hi and members > 2").select("entry", "band", "members")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("id"), blocks).cast("int")
    members = labelled.join(open_entries, ["entry", "band"]).withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.withColumns({"part_a": F.least("p", "q"), "part_b": F.greatest("p", "q"), "side": (F.col("p") > F.col("q")).cast("int")})
    members = members.join(slim, "id").select("entry", "band", "part_a", "part_b", "id", "label", "n", "side", "bitmap")
    settle(stored(_across(members, percent), "ngram-pairs"))
    labels = found.labels

    named = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("label", "rep").alias("component_id"))
    out = base.select("id", "n", "key").join(named, "key", "left")
    own = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(documents(spark, sf_dir))
