"""Operator 2: removal of repeated 100-byte strings by suffix arrays from two-stage sorting.

A byte goes if it lies in a string of `width` bytes that also starts earlier (smaller id, or the same document further
left). The suffix array of the whole corpus is never built; it is only needed where strings can repeat:

1.  Whole texts that are equal collapse first; of such a group all but the smallest id go entirely.
2.  Each window of `width` bytes is assigned an anchor, the least hash among its 32-byte strings, so equal windows have
    equal anchors at equal offsets. The windows of one anchor place form a context of at most 2 * width - 32 bytes.
    Anchors only deal out the work: those that come once have no repeats, and of the others all contexts travel.
3.  Contexts are dealt by anchor and get suffix arrays in blocks, equal ones as one string: suffixes smaller than their
    successor are sorted directly, the rest is induced by scanning the buckets of first bytes, and adjacent common
    prefixes of `width` bytes or more mark windows that repeat. The first place of each keeps its bytes. All of it
    compares bytes.
4.  An anchor with more than HOT places would make a task too large. Its contexts are told apart by 128 bits of hash and
    reduced to the first of each before they move, and so are the windows of what remains; no group is held as a list.
5.  The windows that go are united for each document.

Texts are written once to a table bucketed by id, so that the joins move short rows to the texts and not texts. The table
lies in the shared folder like all else that is kept, and goes when the result is written.

Defined results: null text is empty; texts shorter than `width` lose nothing; rows of one id and equal text count as
one document; an id's different texts are documents of their own, in the order of their SHA-256 (where there are such ids,
documents are numbered by one sort first); a null id counts as one id before all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, ordered_keys, scratch_path, several_texts, small_batches, small_join, stored, tidily

GRAM = 32
HOT, BLOCK_BYTES, SOME_CONTEXTS, MOST_FILES = 20_000, 2_000_000, 8_000, 50_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: A 64-bit value for each byte.
_VALUES = _mix(np.arange(1, 257, dtype=np.uint64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of base, kept for the next text."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.ones(max(n, 1 << 16), np.uint64)
        known[1:] = base
        _POWERS[int(base)] = np.multiply.accumulate(known, out=known)
    return known[:n]


def _sliding(x: np.ndarray, width: int, join) -> np.ndarray:
    """join over each `width` neighbours, by doubling; join must not mind overlaps."""
    span = 1
    while 2 * span <= width:
        x = join(x[:-span], x[span:])
        span *= 2
    return x if span == width else join(x[: len(x) - (width - span)], x[width - span :])


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, place, first window, last window) for each anchor place of a text of at least `width` bytes."""
    n = len(data)
    x = _VALUES[data]
    # Hash of data[l:r]: sum of x[j] * base^(l-j), from running sums.
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * _powers(_BASE_INVERSE, n), out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _powers(_BASE, n - GRAM + 1)
    low = _U((1 << 32) - 1)
    ranked = ((grams * _U(0xFF51AFD7ED558CCD)) & ~low) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding(ranked, width - GRAM + 1, np.minimum) & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    last = np.append(first[1:], len(chosen)) - 1
    place = chosen[first]
    return _mix(grams[place]), place, first, last


def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (place << 16) | ((place - first) << 8) | (place - last)


def _anchor_rows(width: int):
    """One row for each anchor place: h, doc, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for doc, text in zip(docs, batch.column(1), strict=True):
                h, place, first, last = anchors(np.frombuffer(text.as_buffer(), np.uint8), width)
                parts.append((h.view(np.int64), np.full(len(h), doc, np.int64), _pack(place, first, last)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["h", "doc", "at"])

    return run


def _several(hot: int):
    """Rows sorted by h: those of anchors that come twice or more, and one row without doc for each anchor that comes more than `hot` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h, count = None, 0  # the anchor of the row before, and how many rows it had
        held: list[np.ndarray] = []  # that row, while it is the only one of its anchor
        for batch in batches:
            h, doc, at = (c.to_numpy() for c in batch.columns)
            if not len(h):
                continue
            new = np.append(last_h is None or h[0] != last_h, h[1:] != h[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            number = np.arange(len(h)) - start + np.where(np.cumsum(new) == 0, count, 0)
            out = number > 0
            out[:-1] |= ~new[1:]
            parts = [(h[out], doc[out], at[out])]
            if held and not new[0]:
                parts.append(tuple(held))
            last_h, count = h[-1], int(number[-1]) + 1
            held = [x[-1:] for x in (h, doc, at)] if count == 1 else []
            h, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            crowded = batch.column(0).to_numpy()[number == hot]
            none = pa.array([None] * len(crowded), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(at)], ["h", "doc", "at"])
            if len(crowded):
                yield pa.RecordBatch.from_arrays([pa.array(crowded), none, none], ["h", "doc", "at"])

    return run


# Suffix arrays


def two_stage_suffix_array(text: np.ndarray, depth: int = 1 << 30) -> np.ndarray:
    """text: symbols, 0 ends each string and stands last. Order of all suffixes, each compared up to its 0, or by `depth` symbols at least; equal ones by place, or in any order where depth ended the comparison.

    Suffixes smaller than their successor are sorted directly, seven symbols a word, ties only; the others are
    induced: buckets of first symbols are scanned in order, and each suffix met puts its larger predecessor at the
    end of the predecessor's bucket.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    turns = np.append(np.flatnonzero(step), n - 1)
    following = turns[np.searchsorted(turns, np.arange(n))]
    smaller = np.append(step, 1)[following] > 0
    smaller |= text == 0
    direct = _sorted_directly(text, np.flatnonzero(smaller), depth)
    order = direct[np.argsort(text[direct], kind="stable")]  # already by first symbol; this only fixes the bounds
    bounds = np.searchsorted(text[order], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for symbol in range(257):
        bucket = []
        fresh = np.concatenate(waiting[symbol]) if waiting[symbol] else np.zeros(0, np.int64)
        while len(fresh):  # runs of one symbol: each turn induces the suffix one place further left
            bucket.append(fresh)
            left = fresh[fresh > 0] - 1
            fresh = left[(text[left] == symbol) & ~smaller[left]]
        bucket.append(order[bounds[symbol] : bounds[symbol + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        left = whole[whole > 0] - 1
        left = left[text[left] > symbol]
        if len(left):
            firsts = text[left]
            by = np.argsort(firsts, kind="stable")
            left, firsts = left[by], firsts[by]
            cuts = np.flatnonzero(np.append(True, firsts[1:] != firsts[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(left)), strict=True):
                waiting[int(firsts[a])].append(left[a:b])
    return np.concatenate(out)


def _words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seven symbols from each place on, 0 from the string's end; place of the string's end)."""
    n = len(text)
    stops = np.flatnonzero(text == 0)
    end = stops[np.searchsorted(stops, np.arange(n))]
    padded = np.append(text, np.zeros(7, text.dtype)).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    at = np.arange(n)
    for k in range(7):
        word = (word << _U(9)) | np.where(at + k < end, padded[k : k + n], _U(0))
    return word, end


def _sorted_directly(text: np.ndarray, places: np.ndarray, enough: int) -> np.ndarray:
    word, end = _words(text)
    order = places[np.argsort(word[places], kind="stable")]
    key = word[order]
    tied = np.append(False, key[1:] == key[:-1])
    rank = np.cumsum(~tied)
    depth = 7
    while depth < enough:
        inside = tied | np.append(tied[1:], False)
        # A group whose strings have ended is in the order of places already.
        at = np.flatnonzero(inside & _group_goes_on(rank, inside, order + depth < end[order]))
        if not len(at):
            return order
        sub = order[at]
        next_word = np.where(sub + depth < end[sub], word[np.minimum(sub + depth, len(text) - 1)], _U(0))
        by = np.lexsort((next_word, rank[at]))
        order[at] = sub[by]
        next_word = next_word[by]
        same = np.append(False, (rank[at][1:] == rank[at][:-1]) & (next_word[1:] == next_word[:-1]))
        tied = np.zeros(len(order), bool)
        tied[at] = same
        new_rank = np.arange(len(order))
        head = np.maximum.accumulate(np.where(tied, 0, new_rank))
        rank = head
        depth += 7
    return order


def _group_goes_on(rank: np.ndarray, inside: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Members of groups of which some string is longer than the depth."""
    if not len(rank):
        return inside
    size = int(rank.max()) + 1
    alive = np.zeros(size, bool)
    alive[rank[inside & longer]] = True
    return alive[rank]


def repeated_windows(data: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data: the bytes of contexts of so many bytes each, one after the other in the order of their places. (context, first, last) of the runs of windows that equal a window of an earlier context, or an earlier one of their own."""
    starts = np.append(0, np.cumsum(lengths + 1))
    text = np.zeros(starts[-1], np.uint16)
    inside = np.ones(len(text), bool)
    inside[starts[1:] - 1] = False
    text[inside] = data.astype(np.uint16) + 1
    edges = np.zeros(len(text) + 1, np.int64)  # windows begin where `width` bytes or more are left
    long = lengths >= width
    np.add.at(edges, starts[:-1][long], 1)
    np.add.at(edges, (starts[:-1] + lengths - width + 1)[long], -1)
    begins = np.cumsum(edges[:-1]) > 0
    order = two_stage_suffix_array(text, width)
    order = order[begins[order]]
    # Adjacent common prefixes, up to width: neighbours that agree in every word.
    word, _ = _words(text)
    equal = np.ones(max(len(order) - 1, 0), bool)
    for d in [*range(0, width - 7, 7), width - 7]:
        at = np.flatnonzero(equal)
        equal[at] = word[order[at] + d] == word[order[at + 1] + d]
    gone = np.zeros(len(text), bool)
    if len(order):
        run = np.flatnonzero(np.append(True, ~equal))
        gone[order] = True
        gone[np.minimum.reduceat(order, run)] = False
    at = np.flatnonzero(gone)
    cuts = np.flatnonzero(np.append(True, np.diff(at) > 1)) if len(at) else np.zeros(0, np.int64)
    first, last = at[cuts], at[np.append(cuts[1:], len(at)) - 1] if len(at) else at
    context = np.searchsorted(starts, first, "right") - 1
    return context, first - starts[context], last - starts[context]


def _span(at: int) -> tuple[int, int]:
    """(first window, last window) of a packed place."""
    return (at >> 16) - ((at >> 8) & 255), (at >> 16) - (at & 255)


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes data[start : start + length] of each, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _bytes_of(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a column, offsets of its values and the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _cut(width: int):
    """(doc, data, marks) to one row for each marked context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, texts = _bytes_of(batch.column(1))
            marks = batch.column(2)
            ends = marks.offsets.to_numpy().astype(np.int64)
            at, h = (marks.values.field(k).to_numpy()[ends[0] : ends[-1]] for k in ("at", "h"))
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            first, last = (at >> 16) - ((at >> 8) & 255), (at >> 16) - (at & 255)
            doc = batch.column(0).to_numpy()[row]
            lengths = last - first + width
            begin = texts[row] + first
            fits = begin + lengths <= texts[row + 1]  # else the mark is of another text with this id
            h, doc, first, last, lengths, begin = (x[fits] for x in (h, doc, first, last, lengths, begin))
            for k in range(0, len(h), SOME_CONTEXTS):
                part = slice(k, k + SOME_CONTEXTS)
                piece = _gathered(data, begin[part], lengths[part])
                offsets = np.append(0, np.cumsum(lengths[part])).astype(np.int32)
                pieces = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(piece)])
                yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array(doc[part]), pa.array(first[part]), pa.array((last - first + 1)[part]), pieces], ["h", "doc", "start", "count", "piece"])

    return run


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _hot_contexts(width: int):
    """(doc, data, marks) to the digest and the windows of each marked context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, marks in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                spans = sorted({_span(mark["at"]) for mark in marks.as_py()})
                spans = [(a, b) for a, b in spans if b + width <= len(data)]
                columns = [[_digest(data[a : b + width]) for a, b in spans], [doc.as_py()] * len(spans), [a for a, _ in spans], [b for _, b in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *[pa.array(x, pa.int64()) for x in columns[1:]]], ["digest", "doc", "low", "high"])

    return run


def _hot_windows(width: int):
    """(doc, data, spans) to the digest and place of each window of the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                places = sorted({p for x in spans.as_py() for p in range(x["low"], min(x["high"], len(data) - width) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([_digest(data[p : p + width]) for p in places], pa.binary()), pa.array([doc.as_py()] * len(places), pa.int64()), *[pa.array(places, pa.int64())] * 2], ["digest", "doc", "low", "high"])

    return run


def all_but_first(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spans (stored): digest, doc, low, high. (first place of each digest, (doc, low, high) of all others); aggregates combine before they move, and no group is held as a list."""
    firsts = stored(spans.groupBy("digest").agg(F.min(F.struct("doc", "low", "high")).alias("first"), F.max(F.struct("doc", "low")).alias("last")), "suffix-firsts")
    repeated = firsts.where((F.col("first.doc") != F.col("last.doc")) | (F.col("first.low") != F.col("last.low"))).select("digest", "first")
    others = small_join(spans, repeated, ["digest"]).where((F.col("doc") != F.col("first.doc")) | (F.col("low") != F.col("first.low")))
    return firsts.select("first.*"), others.select("doc", "low", "high")


def _repeats(width: int):
    """Rows sorted by h, doc, start; whole groups of one h go into blocks of about BLOCK_BYTES. Gives (doc, low, high): windows that go."""

    def solve(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        h, doc, start, count = (table.column(k).to_numpy() for k in range(4))
        pieces = table.column(4).chunk(0)
        same = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]))
        keep = np.flatnonzero(~same)
        h, doc, start, count = (x[keep] for x in (h, doc, start, count))
        # Equal contexts, byte by byte, have one code; codes count up as they appear, so the first of each is the first place.
        coded = pieces.take(pa.array(keep)).dictionary_encode()
        code = coded.indices.to_numpy()
        top = np.maximum.accumulate(code)
        is_first = np.append(True, top[1:] > top[:-1])
        copies = np.flatnonzero(~is_first)
        out = [(doc[copies], start[copies], start[copies] + count[copies] - 1)]
        firsts = np.flatnonzero(is_first)
        _, back, size = np.unique(h[firsts], return_inverse=True, return_counts=True)
        firsts = firsts[size[back] > 1]
        if len(firsts):
            firsts = firsts[np.lexsort((start[firsts], doc[firsts]))]
            data, offsets = _bytes_of(coded.dictionary)
            lengths = np.diff(offsets)[code[firsts]]
            context, low, high = repeated_windows(_gathered(data, offsets[code[firsts]], lengths), lengths, width)
            out.append((doc[firsts][context], start[firsts][context] + low, start[firsts][context] + high))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.column(4).nbytes
            h = batch.column(0).to_numpy()
            if size > BLOCK_BYTES and (len(held) > 1 or h[0] != h[-1]):
                # Up to the last anchor that is whole for sure.
                cut = len(h) - int((h[::-1] != h[-1]).argmax()) if h[0] != h[-1] else 0
                if cut == 0 and held[-2].column(0)[-1].as_py() == h[0]:
                    continue
                done = [*held[:-1], batch.slice(0, cut)] if cut else held[:-1]
                yield solve(done)
                held = [batch.slice(cut)]
                size = held[0].column(4).nbytes
        if held:
            yield solve(held)

    return run


def _finish(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                edges = np.zeros(len(data) + 1, np.int64)
                pairs = np.array([(r["low"], r["high"]) for r in ranges.as_py()], np.int64)
                np.add.at(edges, np.minimum(pairs[:, 0], len(data)), 1)
                np.add.at(edges, np.minimum(pairs[:, 1] + width, len(data)), -1)
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                digests.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], ["doc", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256). width is 40 to 250."""
    spark = docs.sparkSession
    table, path = f"suffix_texts_{uuid.uuid4().hex}", scratch_path(spark, "suffix-texts")
    try:
        with small_batches(spark, 4000):
            return tidily("suffix-result", lambda: _remove_repeats(docs, table, path, width, id_col, text_col, hot))
    finally:
        spark.sql(f"drop table if exists {table}")
        discard(spark, path)


def _remove_repeats(docs: DataFrame, table: str, path: str, width: int, id_col: str, text_col: str, hot: int) -> DataFrame:
    spark = docs.sparkSession
    null_id = -(1 << 63)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null_id)).alias("doc"), data.alias("data"), F.sha2(data, 256).alias("sha"))
    keys = None
    if several_texts(rows, "doc", F.col("sha")):
        # Each text of an id has a number of its own, in their order.
        keys = ordered_keys(rows.select("doc", "sha").distinct(), "doc", "sha").withColumnRenamed("doc", "_doc")
        rows = rows.withColumnRenamed("doc", "_doc").join(keys, ["_doc", "sha"]).select(F.col("key").alias("doc"), "data", "sha")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows.rdd.getNumPartitions() * buckets > MOST_FILES:  # each task writes a file a bucket
        rows = rows.repartition(buckets, "doc")
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "doc").saveAsTable(table)
    texts = spark.table(table)
    owners = stored(texts.groupBy("sha").agg(F.min("doc").alias("doc")), "suffix-owners")
    # Joins with the texts are by id alone, which is their bucketing; what else decides is looked at afterwards.
    owned = stored(owners.groupBy("doc").agg(F.collect_set("sha").alias("shas")), "suffix-owned")
    held = texts.join(owned.hint("shuffle_hash"), "doc").where(F.array_contains("shas", F.col("sha"))).select("doc", "data")

    def with_texts(short: DataFrame, gathered: Column, name: str) -> DataFrame:
        """(doc, data, name) of the documents in short (doc, ...), with what it gathers for each."""
        return held.join(short.groupBy("doc").agg(F.collect_list(gathered).alias(name)).hint("shuffle_hash"), "doc").select("doc", "data", name)

    places = held.where(F.length("data") >= width).mapInArrow(_anchor_rows(width), "h long, doc long, at long")
    marks = stored(places.repartition("h").sortWithinPartitions("h").mapInArrow(_several(hot), "h long, doc long, at long"), "suffix-marks")
    crowded = stored(marks.where("doc is null").select("h"), "suffix-crowded")
    is_crowded = crowded.limit(1).count() > 0
    usual = marks.where("doc is not null")
    if is_crowded:
        usual = small_join(usual, crowded, ["h"], "left_anti")
    pieces = with_texts(usual, F.struct("at", "h"), "marks").mapInArrow(_cut(width), "h long, doc long, start long, count long, piece binary")
    found = pieces.repartition("h").sortWithinPartitions("h", "doc", "start").mapInArrow(_repeats(width), "doc long, low long, high long")
    if is_crowded:
        spans = "digest binary, doc long, low long, high long"
        contexts = with_texts(small_join(marks.where("doc is not null"), crowded, ["h"], "left_semi"), F.struct("at", "h"), "marks").mapInArrow(_hot_contexts(width), spans)
        firsts, seen = all_but_first(stored(contexts, "suffix-contexts"))
        windows = with_texts(firsts, F.struct("low", "high"), "spans").mapInArrow(_hot_windows(width), spans)
        found = found.union(seen).union(all_but_first(stored(windows, "suffix-windows"))[1])

    cut = with_texts(stored(found, "suffix-ranges"), F.struct("low", "high"), "ranges")
    done = stored(cut.mapInArrow(_finish(width), "doc long, n_removed long, n_spans long, kept_sha256 string"), "suffix-done").dropDuplicates(["doc"])
    base = texts.select("doc", "sha", F.length("data").cast("long").alias("n_bytes")).join(owners.withColumnRenamed("doc", "owner"), "sha").join(done, "doc", "left")
    whole = (F.col("doc") != F.col("owner")) & (F.col("n_bytes") >= width)
    own = F.col("doc") == F.col("owner")
    done = base.select(
        "doc",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).when(own, F.coalesce("n_spans", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    if keys is not None:
        done = done.join(keys.select(F.col("key").alias("doc"), "_doc"), "doc").withColumn("doc", F.col("_doc")).drop("_doc")
    return done.select(F.when(F.col("doc") != null_id, F.col("doc")).alias(id_col), *done.columns[1:])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
