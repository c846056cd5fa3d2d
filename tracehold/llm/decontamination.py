"""Operator 8: benchmark decontamination by SimHash of item-sized windows and multi-index Hamming blocks.

1.  Every five-word shingle of every whole text is looked up among the items' shingles. A window as long as the item is
    cut wherever a hit would place the item, and up to SLACK words beside it, as a word may be lost or added; a window without a common shingle has similarity 0 and need not be cut.
2.  Equal windows are taken once, however many documents hold them. Each gets a 64-bit SimHash, its shingles weighted
    by their length in characters.
3.  Fingerprints are cut in four 16-bit blocks. If two differ in at most 19 bits, some block differs in at most 4;
    items are entered under all values within 3 bits of each block and windows look up all values within 1 bit, so
    every pair within the radius meets, and pairs beyond it are dropped by their bit count.
4.  Pairs are verified by exact weighted Jaccard similarity of their shingle multisets, at least 0.8 by default.

All of it is DataFrame expressions. The items' shingles are broadcast while they were counted to be few, and joined
by shuffle otherwise.

Words are runs of letters and digits, lower-cased. An item of fewer than five words has one shingle, the whole sequence;
a text holds it where one of its lines, or the text itself, has just these words. Items without words match nothing.

Defined results: null and empty texts match nothing; a null id is not matched; empty tables give empty results; repeated documents
are reported once for each id and item, and kept or dropped alike; repeated items are reported as items of their own;
other columns are carried through by `decontaminate`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, documents, small_join, stored

SLACK = 2  # words that a window may begin before or after the place that a hit names
BLOCKS, BLOCK_BITS, ITEM_RADIUS, WINDOW_RADIUS = 4, 16, 3, 1
RADIUS = BLOCKS * (ITEM_RADIUS + WINDOW_RADIUS) + BLOCKS - 1


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _run(w: Column, i: Column, n: int) -> list[Column]:
    return [F.get(w, i + k) for k in range(n)]


def shingle_hashes(w: Column, n: int) -> Column:
    some = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*_run(w, i, n)))
    return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<bigint>"))


def with_shingles(df: DataFrame, w: str, n: int, out: str) -> DataFrame:
    """Adds the shingles of the words in column w as text; a repeated one is followed by its number, which makes a set of the multiset."""
    plain = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *_run(F.col(w), i, n)))
    df = bound(df, "_plain", F.when(F.size(w) >= n, plain).otherwise(F.array().cast("array<string>")))
    number = lambda x, i: F.size(F.filter(F.slice("_plain", F.lit(1), i), lambda y: y == x))
    numbered = F.transform("_plain", lambda x, i: F.concat_ws("\n", x, F.nullif(number(x, i), F.lit(0)).cast("string")))
    return bound(df, out, F.when(F.size(F.array_distinct("_plain")) == F.size("_plain"), F.col("_plain")).otherwise(numbered)).drop("_plain")


def _weight(shingle: Column) -> Column:
    return F.length(F.substring_index(shingle, "\n", 1)).cast("long")


def with_simhash(df: DataFrame, shingle_set: str, out: str) -> DataFrame:
    """Adds the fingerprint: bit b is set if the shingles whose hash has it outweigh those whose hash lacks it."""
    df = bound(df, "_parts", F.transform(shingle_set, lambda s: F.struct(F.xxhash64(s).alias("h"), _weight(s).alias("w"))))
    power = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)

    def heavier(b: Column) -> Column:
        return F.aggregate("_parts", F.lit(0).cast("long"), lambda acc, p: acc + F.when(p["h"].bitwiseAND(power(b)) != 0, p["w"]).otherwise(-p["w"])) > 0

    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: F.when(heavier(b), acc.bitwiseOR(power(b))).otherwise(acc))
    return bound(df, out, bits).drop("_parts")


def near_masks(radius: int, bits: int = BLOCK_BITS) -> list[int]:
    """All patterns of at most `radius` set bits."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def _blocks(df: DataFrame, fingerprint: str, radius: int) -> DataFrame:
    """df once for each block and each value within `radius` bits of it: columns block, value."""
    masks = F.array(*[F.lit(m) for m in near_masks(radius)])  # 17 or 697 of them
    blocks = df.withColumn("block", F.explode(F.array(*[F.lit(b) for b in range(BLOCKS)])))
    value = F.call_function("shiftrightunsigned", F.col(fingerprint), F.col("block") * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return blocks.withColumn("own", value).withColumn("mask", F.explode(masks)).withColumn("value", F.col("own").bitwiseXOR(F.col("mask"))).drop("own", "mask")


def similarity(a: Column, b: Column) -> Column:
    total = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda acc, x: acc + _weight(x))
    shared = total(F.array_intersect(a, b))
    return shared / (total(a) + total(b) - shared)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item, similarity, at_word, n_windows): one row for each document and item of which it holds a near copy; at_word is null for items of fewer than n words."""
    every = bound(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), "w", tokens(F.col("text")))
    short = stored(every.where((F.size("w") > 0) & (F.size("w") < n)).select("item", F.concat_ws(" ", "w").alias("content")), "leak-short")
    items = every.where(F.size("w") >= n)
    items = with_simhash(with_shingles(items, "w", n, "set"), "set", "item_print")
    items = stored(items.select("item", F.size("w").alias("len"), shingle_hashes(F.col("w"), n).alias("hashes"), "set", "item_print"), "leak-items")
    spots = stored(items.select("len", F.posexplode("hashes").alias("item_at", "h")).distinct(), "leak-shingles")

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = bound(docs, "w", tokens(F.col("text"))).select("id", F.posexplode(shingle_hashes(F.col("w"), n)).alias("at", "h"))
    hits = small_join(hashed, spots, ["h"], max_rows=1_000_000).select("id", (F.col("at") - F.col("item_at")).alias("start"), "len")
    near = F.explode(F.array(*[F.lit(x) for x in range(-SLACK, SLACK + 1)]))
    places = hits.distinct().select("id", "start", "len", near.alias("shift")).select("id", F.greatest(F.col("start") + F.col("shift"), F.lit(0)).alias("start"), "len")
    places = stored(places.distinct(), "leak-places")

    # Only the texts with hits are read again and cut.
    ids = stored(places.select("id").distinct(), "leak-ids")
    texts = small_join(docs, ids, ["id"], "left_semi", 1_000_000)
    texts = bound(texts, "w", tokens(F.col("text"))).select("id", "w")
    cut = F.concat_ws(" ", F.slice("w", F.col("start") + 1, F.col("len")))
    windows = stored(texts.join(places, "id").select("id", "start", cut.alias("content")).distinct(), "leak-windows")
    prints = with_shingles(bound(windows.select("content").distinct(), "w", F.split("content", " ")), "w", n, "set").where(F.size("set") > 0)
    prints = stored(with_simhash(prints, "set", "print").select("content", "set", "print"), "leak-prints")

    met = _blocks(prints.select("content", "print"), "print", WINDOW_RADIUS).join(_blocks(items.select("item", "item_print"), "item_print", ITEM_RADIUS), ["block", "value"])
    pairs = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("content", "item").distinct()
    both = pairs.join(prints.select("content", "set"), "content").join(items.select("item", F.col("set").alias("item_set")), "item")
    close = stored(both.select("content", "item", similarity(F.col("set"), F.col("item_set")).alias("similarity")).where(F.col("similarity") >= threshold), "leak-pairs")
    found = windows.join(close, "content").groupBy("id", "item").agg(F.max("similarity").alias("similarity"), F.min(F.struct(-F.col("similarity"), "start")).alias("best"), F.countDistinct("start").alias("n_windows"))
    found = found.select("id", "item", "similarity", F.col("best.start").cast("long").alias("at_word"), F.col("n_windows").cast("long").alias("n_windows"))
    if short.limit(1).count():
        found = found.unionByName(_short_items(docs, short, n))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.round("similarity", 6).alias("similarity"), "at_word", "n_windows")


def _short_items(docs: DataFrame, short: DataFrame, n: int) -> DataFrame:
    """Items of fewer than n words (item, content) that are a whole line, or the whole text, of a document (id, text)."""
    lines = docs.where(F.col("id").isNotNull()).select("id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    lines = bound(lines, "w", tokens(F.col("line"))).where(F.size("w") > 0)
    whole = bound(docs.where(F.col("id").isNotNull() & F.col("text").contains("\n")), "w", tokens(F.col("text"))).where(F.size("w").between(1, n - 1))
    some = lines.where(F.size("w") < n).select("id", F.concat_ws(" ", "w").alias("content")).unionByName(whole.select("id", F.concat_ws(" ", "w").alias("content")))
    met = small_join(some, short, ["content"]).groupBy("id", "item").agg(F.count("*").cast("long").alias("n_windows"))
    return met.select("id", "item", F.lit(1.0).alias("similarity"), F.lit(None).cast("long").alias("at_word"), "n_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold a near copy of an item; rows with a null id stay."""
    leaks = stored(contaminated(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), "leak-documents")
    return small_join(docs, leaks, [id_col], "left_anti", 1_000_000)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
