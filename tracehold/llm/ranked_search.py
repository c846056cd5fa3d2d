"""Operator 11: ranked lexical search by the Best Position Algorithm.

The rows of one table (items) are queries against all rows of another (documents). A score is the sum, over an item's
terms with repeats, of w * ((1000000000 * tf) div (1000 * tf + 12 * m)): w = floor(1000 * ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L,
N documents with a term, L terms of all documents, n those of one, df documents with the term, tf its occurrences in the document.

1.  One pass over the texts counts each document's terms and keeps those that items ask for: (id, n, terms, times).
    N, L and df are aggregates over all of that.
2.  Documents are searched in shards as they lie in the partitions, SHARD kept terms at a time; nothing is shuffled. A shard has an
    impact list for each term, by falling impact, and a direct access from (term, document) to impact and position.
3.  An item's lists are read from the top, STEP positions of each list at a time (more after each turn). Every document that comes
    up is looked up in all lists of the item, which gives its score and marks its positions there as seen. The best position of a list is the last one up to
    which all are seen; the sum of the impacts at the best positions bounds what is unseen. Reading ends when that is
    strictly below the k-th score, as an unseen document of equal score may have the smaller id. The best of the
    shards before stay, so later shards end sooner.
4.  Each task gives k rows an item at most, and the best k of those are taken in two turns.

Items travel to the tasks in blocks of BLOCK_TERMS terms (one item at least), and each block is a search of its own over the
counted documents; so what is sent to a task has a bound, whatever the number of items.

Defined results: null text has no terms; documents and items without a term appear nowhere; every row is a document (or an item) of its own, also if its id
is null or repeated, and a null id stands before all others among equal scores; rows of one id and equal score are interchangeable; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored, tidily

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD, STEP, BLOCK_TERMS = 1_000_000, 32, 500_000
NULL_ID = -(1 << 63)
_terms = re.compile(TERM).findall
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str) -> list[str]:
    """Maximal runs of letters, digits and all that is not ASCII; only A-Z are lower-cased."""
    return _terms(text.translate(_LOWER) if not text.isascii() else text.lower())


class Shard(NamedTuple):
    """Documents with their impact lists; list t lies at starts[t] : starts[t + 1]."""

    ids: np.ndarray
    starts: np.ndarray
    doc: np.ndarray  # by falling impact, then document
    impact: np.ndarray
    keys: np.ndarray  # term * documents + document, sorted: the direct access
    position: np.ndarray  # of each key: place in doc and impact


def make_shard(ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, per_doc: np.ndarray, weights: np.ndarray, total: int, length: int) -> Shard:
    """ids, sizes: of each document, with the number of its terms; per_doc: how many entries of terms and times are its own."""
    m = 75 + (25 * sizes * total) // max(length, 1)
    doc = np.repeat(np.arange(len(ids)), per_doc)
    impact = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m[doc]))
    order = np.lexsort((ids[doc], -impact, terms))
    starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
    keys = terms * len(ids) + doc
    by_key = np.argsort(keys[order], kind="stable")
    return Shard(ids, starts, doc[order], impact[order], keys[order][by_key], by_key)


class Best:
    """An item's best documents so far, k at most; equal scores by id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores > 0
        if len(self.scores) == self.k:
            some &= scores >= self.scores[-1]
        if some.any():
            scores, ids = np.concatenate((self.scores, scores[some])), np.concatenate((self.ids, ids[some]))
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]

    def kth(self) -> int:
        """The k-th score; below it nothing enters. Scores of 0 never do."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1


def best_positions(shard: Shard, terms: np.ndarray, times: np.ndarray, best: Best, step: int = STEP) -> int:
    """Adds an item's documents to best; terms are distinct, times their repeats in the item. Gives the number of documents that were looked up."""
    low, high = shard.starts[terms], shard.starts[terms + 1]
    some = high > low
    terms, times, low, high = terms[some], times[some], low[some], high[some]
    if not len(terms):
        return 0
    seen = [np.zeros(h - b + 1, bool) for b, h in zip(low, high, strict=True)]  # the last stays False
    known = np.zeros(len(shard.ids), bool)
    reached, read = np.zeros(len(terms), np.int64), 0
    looked = 0
    while True:
        # Sorted access: the next positions of each list.
        upto = np.minimum(low + read + step, high)
        fresh = np.concatenate([shard.doc[a:b] for a, b in zip(np.minimum(low + read, high), upto, strict=True)])
        read += step
        step *= 2
        marks = np.zeros(len(shard.ids), bool)
        marks[fresh] = True
        fresh = np.flatnonzero(marks & ~known)
        known[fresh] = True
        looked += len(fresh)
        # Direct access: each new document in all lists of the item.
        score = np.zeros(len(fresh), np.int64)
        for j, term in enumerate(terms):
            a = np.searchsorted(shard.keys, term * len(shard.ids))  # as many keys as positions: the same bounds as the list
            b = a + high[j] - low[j]
            wanted = term * len(shard.ids) + fresh
            at = a + np.searchsorted(shard.keys[a:b], wanted)
            hit = at < b
            hit[hit] = shard.keys[at[hit]] == wanted[hit]
            places = shard.position[at[hit]]
            score[hit] += times[j] * shard.impact[places]
            seen[j][places - low[j]] = True
        best.add(score, shard.ids[fresh])
        bound = 0
        for j in range(len(terms)):
            reached[j] += int(np.argmin(seen[j][reached[j] :]))
            if reached[j] < high[j] - low[j]:  # positions up to here are seen; an unseen document stands behind them
                bound += int(times[j]) * int(shard.impact[low[j] + max(reached[j] - 1, 0)])
        if bound < best.kth() or read >= int((high - low).max()):
            return looked


def _counted(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, times): the number of all terms, and those of the vocabulary with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            sizes, terms, times, ends = [], [], [], [0]
            for data in batch.column(1):
                found = terms_of((data.as_py() or b"").decode("utf-8", "replace"))
                counts = Counter(found)
                own = sorted((number[t], c) for t, c in counts.items() if t in number)
                sizes.append(len(found))
                terms.extend(t for t, _ in own)
                times.extend(c for _, c in own)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))], ["id", "n", "terms", "times"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, times array<int>").where("n > 0")


def _search(counted: DataFrame, items, weights, total: int, length: int, k: int) -> DataFrame:
    """(item, doc, score): the k best of each task. items: (number, terms, times) of each."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            # A batch may hold more than a shard: some rows at a time.
            rows = max(1, len(batch) * SHARD // max(len(batch.column(2).values), 1))
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                ends = part.column(2).offsets.to_numpy()
                terms, times = (part.column(c).values.to_numpy()[ends[0] : ends[-1]] for c in (2, 3))
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), terms.astype(np.int64), times.astype(np.int64), np.diff(ends)))
                size += len(terms)
                if size >= SHARD:
                    yield make_shard(*(np.concatenate(x) for x in zip(*held, strict=True)), weights.value, total, length)
                    held, size = [], 0
        if held:
            yield make_shard(*(np.concatenate(x) for x in zip(*held, strict=True)), weights.value, total, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items.value]
        for shard in shards(batches):
            for (_, terms, times), found in zip(items.value, best, strict=True):
                best_positions(shard, terms, times, found)
        for (number, _, _), found in zip(items.value, best, strict=True):
            if len(found.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.ids), number)), pa.array(found.ids), pa.array(found.scores)], ["item", "doc", "score"])

    return counted.mapInArrow(run, "item long, doc long, score long")


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items with their numbers and term counts, in blocks of BLOCK_TERMS; the driver holds one block and one partition of items."""
    held: list[tuple] = []
    size = 0
    rows = items.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for row in rows.toLocalIterator():
        counts = Counter(terms_of(row["text"] or ""))
        if not counts:
            continue
        if held and size + len(counts) > BLOCK_TERMS:
            yield held
            held, size = [], 0
        held.append((row["number"], row["id"], counts))
        size += len(counts)
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): each item's k best documents with a score above 0. id_col holds whole numbers."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    parts = []
    for block in _blocks(items, item_col, item_text_col):
        parts.append(tidily("search-block", lambda block=block: _ranked(docs, block, k, id_col, text_col, item_kind)))
    if not parts:
        return spark.createDataFrame([], f"{item_col} {item_kind}, rank int, {id_col} {kind}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(F.col("id").alias(item_col), "rank", F.when(F.col("doc") != NULL_ID, F.col("doc")).cast(kind).alias(id_col), "score")


def _ranked(docs: DataFrame, block: list[tuple], k: int, id_col: str, text_col: str, item_kind: str) -> DataFrame:
    spark = docs.sparkSession
    number: dict[str, int] = {}
    for _, _, counts in block:
        for term in counts:
            number.setdefault(term, len(number))
    vocabulary = spark.sparkContext.broadcast(number)
    counted = stored(_counted(docs, vocabulary, id_col, text_col), "search-counted")
    total, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = np.zeros(len(number), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # one row for each term of the block
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    asked = [(n, np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for n, _, c in block]
    found = _search(counted, spark.sparkContext.broadcast(asked), spark.sparkContext.broadcast(weights), total, length, k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    first = F.row_number().over(Window.partitionBy("item", "_some").orderBy(F.desc("score"), "doc"))
    found = found.withColumn("_some", F.spark_partition_id() % 64).withColumn("_first", first).where(F.col("_first") <= k)
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, i, _ in block], f"item long, id {item_kind}")
    return top.join(F.broadcast(names), "item").select("id", "rank", "doc", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle() -> str:
    """Scores of all documents that share a term with an item."""
    parts = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = lambda c: f"list_filter(string_split_regex({lower.format(c)}, '{parts}'), lambda x: x <> '')"
    return f"""
    with d as (select row_number() over () as r, doc_id, {split("coalesce(text, '')")} as t from documents),
    i as (select row_number() over () as q, item_id, {split("coalesce(text, '')")} as t from benchmark),
    total as (select count(*) as n, sum(len(t)) as l from d where len(t) > 0),
    tf as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) group by all),
    w as (select term, floor(1000 * ln((2 * any_value(n) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term),
    m as (select r, doc_id, 75 + (25 * len(t) * n) // l as m from d, total where len(t) > 0),
    impact as (select r, term, (w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as impact from tf join w using (term) join m using (r)),
    scored as (select q, item_id, r, sum(impact)::bigint as score from (select q, item_id, unnest(t) as term from i) join impact using (term) group by all having sum(impact) > 0)
    select item_id, rank::int as rank, doc_id, score
    from (select *, row_number() over (partition by q order by score desc, doc_id nulls first, r) as rank from scored join m using (r))
    where rank <= 20"""
