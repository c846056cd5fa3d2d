"""Operator 6: token counts of sections, by offset-mapped attribution.

Each whole document is encoded once; the byte lengths of its tokens give their spans, which are mapped to
characters and joined as intervals to the sections (by default lines, each with its line end; or any spans given in
a column). A token that crosses a boundary is allocated by an explicit rule:

``start``     to the section that holds its first character;
``end``       to the section that holds its last character;
``majority``  to the section that holds most of its characters, of equals the one that begins (then ends) first.

The vocabulary is a byte-level one in rank format and its path a parameter; nothing is trained. Encoding and the
interval join run inside Arrow batches, as a document's tokens are only ever needed together; no row is shuffled.

Defined results: null text gives no rows, empty text one empty section without tokens; an empty table gives an
empty result; repeated rows give repeated results; other columns are ignored. A character whose bytes are split among
tokens belongs to each of their spans. Sections that are given may stand in any order, leave gaps or overlap: by the first two rules a token is counted in each
one that holds the character that the rule asks about, and nowhere if none does.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("start", "end", "majority")
#: Split pattern of the vocabulary (a fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first character, last character + 1) of each token."""
    encoder, lengths = _encoder(path)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ids = np.asarray(encoder.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    char_at = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return ids, char_at[ends - lengths[ids]], char_at[ends - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """Rows (start, end): lines with their line ends; together they hold every character once."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    if not len(ends) or ends[-1] < len(codes):
        ends = np.append(ends, len(codes))
    return np.column_stack((np.append(0, ends[:-1]), ends))


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, in any order. Sections that don't overlap are joined by binary search, others one by one."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    order = np.lexsort((sections[:, 1], sections[:, 0]))
    a, b = sections[order, 0], sections[order, 1]
    counts, crossed = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    if not len(starts):
        return counts, crossed
    if np.all(a[1:] >= b[:-1]):
        at = {"start": starts, "end": ends - 1}.get(rule)
        if at is None:
            at = _majority(starts, ends, a, b)
        first = np.searchsorted(b, at, "right")
        inside = (first < len(a)) & (a[np.minimum(first, len(a) - 1)] <= at)
        where, crossing = first[inside], (ends > b[np.minimum(first, len(a) - 1)])[inside] | (starts < a[np.minimum(first, len(a) - 1)])[inside]
        counts[order], crossed[order] = np.bincount(where, minlength=len(a)), np.bincount(where[crossing], minlength=len(a))
        return counts, crossed
    best, chosen = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if rule == "majority":
            share = np.minimum(ends, y) - np.maximum(starts, x)
            more = share > best
            best[more], chosen[more] = share[more], k
        else:
            at = starts if rule == "start" else ends - 1
            held = (at >= x) & (at < y)
            counts[order[k]], crossed[order[k]] = held.sum(), (held & ((starts < x) | (ends > y))).sum()
    if rule == "majority":
        for k in np.unique(chosen[chosen >= 0]):
            held = chosen == k
            counts[order[k]], crossed[order[k]] = held.sum(), (held & ((starts < a[k]) | (ends > b[k]))).sum()
    return counts, crossed


def _majority(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A character of the section that holds most of each token; tokens of one section keep their first character."""
    at = starts.copy()
    k, last = np.searchsorted(b, starts, "right"), np.searchsorted(b, ends - 1, "right")
    for t in np.flatnonzero((k != last) | (starts < a[np.minimum(k, len(a) - 1)])):
        shares = np.minimum(ends[t], b[k[t] : last[t] + 1]) - np.maximum(starts[t], a[k[t] : last[t] + 1])
        if len(shares) and shares.max() > 0:
            at[t] = max(starts[t], a[k[t] + int(np.argmax(shares))])
    return at


def count_tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sections_col: str | None = None, rule: str = "start", path: str = VOCABULARY) -> DataFrame:
    """(id_col, section, start, end, n_tokens, n_crossing), one row a section; sections_col holds array<struct<start,end>>."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, parts = [], []
            for k, text in enumerate(batch["_text"]):
                _, starts, ends = token_spans(text, path)
                if sections_col is None:
                    sections = line_sections(text)
                else:
                    given = batch["_sections"].iloc[k]
                    sections = np.array([(int(s["start"]), int(s["end"])) for s in given] if given is not None else [], np.int64).reshape(-1, 2)
                counts, crossing = attribute(starts, ends, sections, rule)
                ids.append(np.full(len(sections), k))
                parts.append(np.column_stack((np.arange(len(sections)), sections, counts, crossing)))
            if parts:
                table = np.concatenate(parts)
                out = pd.DataFrame(table, columns=["section", "start", "end", "n_tokens", "n_crossing"])
                out.insert(0, "_id", batch["_id"].to_numpy()[np.concatenate(ids)])
                yield out

    cols = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([F.col(sections_col).alias("_sections")] if sections_col else [])]
    rows = docs.where(F.col(text_col).isNotNull()).select(*cols)
    counted = rows.mapInPandas(run, f"_id {kind}, section long, start long, end long, n_tokens long, n_crossing long")
    return counted.toDF(id_col, *counted.columns[1:])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
