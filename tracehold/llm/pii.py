"""Operator 5: personal data by bootstrapped contextual extraction.

Seeds are what fixed forms find in each whole text: e-mail and IP addresses, card and phone numbers. The words
around an entity (two before, one after) are lexical patterns. Spark scores the graph of patterns and instances in
turns: a pattern is as good as the share of its instances that are known or believed, an instance as good as its
best pattern. Patterns that end above `min_pattern` and were seen with enough different seeds then mark
identifier-like tokens (four digits or more) that no form found: spans of kind ``id``.

Only rows that hold an @ or a digit reach Python, in Arrow batches; what is shuffled is one short row for each
pattern and instance, aggregated before it moves.

Defined results: null and empty texts have no spans; an empty table gives an empty result; repeated rows are
scanned and returned as often as they come; other columns are carried through, but for those named spans, _row, _text,
_found, _base or _added, which the operator's own replace.
Spans count code points, end exclusive. Base spans always stay; an added one never overlaps a base one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_join, stored

BASE = ("email", "ip", "card", "phone")
FOUND = "array<struct<rank:int,start:int,end:int,left:string,right:string,value:string>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails from its first digit fails from each later one, so searches begin at first digits only.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![^ \t-\r])[^ \t-\r0-9]*[0-9][^ \t-\r]*")
_WORD = re.compile(r"[^ \t-\r]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: the part before each @ reaches back as far as its letters go, but not into the match before."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """For each span the two words before and the word after, of any length, lower-cased and without their punctuation; digits become 0. What touches a span counts as a word."""
    clean = lambda x: re.sub("[0-9]+", "0", x.lower()).strip(".,;:!?()[]\"'")
    words = [m.span() for m in _WORD.finditer(text)] if spans else []
    starts, ends = [a for a, _ in words], [b for _, b in words]
    out = []
    for start, end in spans:
        k = bisect_left(starts, start)
        before = [text[a : min(b, start)] for a, b in words[max(0, k - 2) : k]]
        j = bisect_right(ends, end)
        after = text[max(starts[j], end) : ends[j]] if j < len(words) else ""
        out.append((" ".join(clean(x) for x in before) if len(before) == 2 else "", clean(after)))
    return out


def entities(text: str) -> list[tuple[int, int, int, str, str, str]]:
    """Base entities (rank 0 to 3) and identifier-like tokens apart from them (rank 4), each with its context."""
    found = [(k, *span) for k, finder in enumerate((emails, ips, cards, phones)) for span in finder(text)]
    taken = sorted((a, b) for _, a, b in found)
    at = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        token = m[0].strip(".,;:!?()[]\"'")
        if sum(c in "0123456789" for c in token) < 4:
            continue
        a += m[0].index(token)
        b = a + len(token)
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            found.append((4, a, b))
    found.sort()
    return [(k, a, b, *around, text[a:b]) for (k, a, b), around in zip(found, contexts(text, [(a, b) for _, a, b in found]), strict=True)]


def extract(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, _found) of the rows that hold an @ or a digit."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "_found": [entities(t) for t in b["_text"]]})

    some = docs.where(F.col(text_col).rlike("[@0-9]")).select(id_col, F.col(text_col).alias("_text"))
    return some.mapInPandas(run, f"{id_col} {kind}, _found {FOUND}")


def score_patterns(instances: DataFrame, rounds: int = 3, min_seeds: int = 5) -> DataFrame:
    """instances (stored): pattern, value, seed (0 or 1). Returns (pattern, score), patterns with min_seeds different seeds only.

    Belief starts at 1 for seeds and 0 for the rest and spreads: pattern = mean belief of its instances, instance =
    best pattern. Each half-turn is one aggregation.
    """
    edges = stored(instances.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    beliefs = edges.select("pattern", "value", "seed", F.col("seed").cast("double").alias("belief"))
    scores = None
    for turn in range(rounds):
        scores = beliefs.groupBy("pattern").agg(F.avg("belief").alias("score"), F.sum("seed").alias("seeds")).where(F.col("seeds") >= min_seeds)
        scores = stored(scores.select("pattern", "score"), "pii-patterns")
        if turn + 1 < rounds:
            reached = small_join(edges.where("seed = 0"), scores, ["pattern"]).groupBy("value").agg(F.max("score").alias("best"))
            reached = stored(reached, "pii-beliefs")
            beliefs = edges.join(reached, "value", "left").withColumn("belief", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("best", F.lit(0.0))))
    return scores


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_pattern: float = 0.8, min_seeds: int = 5, rounds: int = 3) -> DataFrame:
    """docs without their text, with `spans` (rank, start, end; rank 0 to 3 as in BASE, 4 for identifiers that a pattern found). id_col must tell the documents apart; rows that repeat it get the spans of each."""
    docs = docs.drop(*[c for c in ("spans", "_row", "_text", "_found", "_base", "_added") if c not in (id_col, text_col)])
    rows = docs.withColumn("_row", F.concat_ws(":", F.to_json(F.struct(F.col(id_col))), F.xxhash64(F.coalesce(text_col, F.lit(""))).cast("string")))
    found = stored(extract(rows, text_col, "_row"), "pii-found")
    one = found.select(F.explode("_found").alias("e"))
    both = F.array(F.concat(F.lit("<"), F.col("e.left")), F.concat(F.lit(">"), F.col("e.right")))
    instances = one.select(F.explode(both).alias("pattern"), F.xxhash64("e.value").alias("value"), (F.col("e.rank") < 4).cast("int").alias("seed")).where(F.length("pattern") > 1)
    good = score_patterns(stored(instances, "pii-instances"), rounds, min_seeds).where(F.col("score") >= min_pattern).select("pattern")
    # Unseen identifiers beside a good pattern; then one row a document again.
    fresh = found.select("_row", F.explode(F.filter("_found", lambda e: e["rank"] == 4)).alias("e")).select("_row", "e.start", "e.end", F.explode(F.array(F.concat(F.lit("<"), F.col("e.left")), F.concat(F.lit(">"), F.col("e.right")))).alias("pattern"))
    added = small_join(fresh, stored(good, "pii-good"), ["pattern"], "left_semi").groupBy("_row").agg(F.array_sort(F.collect_set(F.struct(F.lit(4).alias("rank"), "start", "end"))).alias("_added"))
    slim = found.select("_row", F.transform(F.filter("_found", lambda e: e["rank"] < 4), lambda e: F.struct(e["rank"].alias("rank"), e["start"].alias("start"), e["end"].alias("end"))).alias("_base"))
    none = F.array().cast("array<struct<rank:int,start:int,end:int>>")
    spans = slim.dropDuplicates(["_row"]).join(added, "_row", "left").select("_row", F.concat("_base", F.coalesce("_added", none)).alias("spans"))
    return rows.drop(text_col).join(spans, "_row", "left").withColumn("spans", F.coalesce("spans", none)).drop("_row")


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*BASE, "id")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k, name: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{name}")
    base = F.filter("spans", lambda s: s["rank"] < 4)
    return found.select("doc_id", *[count(k, name) for k, name in enumerate(BASE)], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
