"""Ranked search, piece encoding and the prefix trie against plain Python; ids with several texts in operators 2 and 9."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehold.llm import ngram_join, piece_tokens, prefix_trie, ranked_search, suffix_dedup, token_counts

from test_brute_force import brute_repeats, docs_df, text

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# Ranked search


def brute_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, words in items:
        scored = []
        for i, b, n in bags:
            m = 75 + 25 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in split(words) if t in b)
            if score:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "shard", "step"), [(1, 1_000_000, 32), (2, 300, 2), (3, 50, 1)])
def test_ranked_search(spark, monkeypatch, seed, shard, step):
    rng = random.Random(seed)
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    monkeypatch.setattr(ranked_search, "best_positions", lambda *a, f=ranked_search.best_positions: f(*a, step))
    vocab = [f"Wörd{k}" for k in range(60)] + ["the", "The", "of", "A1"] * 20
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 5, 40))))) for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(200, 240)] + [(None, docs[3][1]), (7, "the of"), (300, None), (301, ""), (302, "-- !"), (303, "the " * 5000)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12)))) for k in range(12)] + [(50, docs[3][1]), (51, "none-such"), (52, None), (53, ""), (None, "the A1 a1")]
    got = ranked_search.ranked_search(docs_df(spark, docs).withColumn("score", F.lit(1)).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, 5)


def test_ranked_search_in_blocks_of_items(spark, monkeypatch):
    docs = [(i, f"alpha {'beta ' * (i % 3)} gamma{i % 7}") for i in range(40)]
    items = [(k, f"alpha gamma{k} beta") for k in range(7)]
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 5)
    got = ranked_search.ranked_search(docs_df(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, 20)


def test_best_positions_stop_early():
    """A document that leads all lists ends the reading; an equal score with a smaller id further down does not get lost."""
    n = 4000
    ids = np.arange(n, dtype=np.int64)
    times = np.where(ids == 7, 50, 1)
    shard = ranked_search.make_shard(ids, np.full(n, 100, np.int64), np.tile([0, 1], n), np.repeat(times, 2), np.full(n, 2), np.array([900, 800]), n, 100 * n)
    best = ranked_search.Best(1)
    assert ranked_search.best_positions(shard, np.array([0, 1]), np.array([1, 1]), best) < n / 10
    assert best.ids.tolist() == [7]
    ties = ranked_search.Best(3)
    ranked_search.best_positions(shard, np.array([0, 1]), np.array([1, 1]), ties, 1)
    assert ties.ids.tolist() == [7, 0, 1]


def test_ranked_search_empty(spark):
    docs, items = docs_df(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        got = ranked_search.ranked_search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


# Pieces


def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)


def same_as_library(texts):
    lib = library()
    ids, offsets = piece_tokens.encode_texts(texts, PIECES)
    for t, a, b, want in zip(texts, offsets[:-1], offsets[1:], lib.encode(texts), strict=True):
        assert ids[a:b].tolist() == want, t[:80]
        assert piece_tokens.decode_ids(np.array(want, np.int32), PIECES) == lib.decode(want), t[:80]


@pytest.mark.parametrize("letters", ["ab ", "the inga▁ ", "0123 ,.", "abcdefghijklmnopqrstuvwxyz ", "éèà çaeiou\n\t", "中文的是了我 ☃字a", "==--  __//", "ABab \x00\x7f�​"])
def test_pieces_as_the_library(letters):
    rng = random.Random(letters)
    same_as_library(["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)])


def test_pieces_of_long_words_and_runs(monkeypatch):
    monkeypatch.setattr(piece_tokens, "SLICE", 1000)
    rng = random.Random(1)
    same_as_library(["", " ", "a" * 9000, " " * 9001, "x" + " " * 9001 + "the", "ab" * 5000, "".join(rng.choice("abcdefghij0123+/") for _ in range(9000)), "the and " * 3000])
    same_as_library([" " * n + tail for n in range(1, 50) for tail in ("", "x", "the", " ☃", "\n")])


def test_pieces_decode_any_ids():
    rng, lib = random.Random(1), library()
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(262) for _ in range(rng.randrange(8))]
        assert piece_tokens.decode_ids(np.array(ids, np.int64), PIECES) == lib.decode(ids), ids
    with pytest.raises(ValueError):
        piece_tokens.decode_ids(np.array([32000]), PIECES)


def test_pieces_in_spark(spark):
    rows = [(1, "hello wörld"), (2, None), (3, ""), (3, ""), (None, "x  y"), (5, "the " * 40_000), (6, "\n☃")]
    docs = docs_df(spark, rows).withColumns({"ids": F.lit(1), "_text": F.lit("mine")})
    got = piece_tokens.decode(piece_tokens.encode(docs, PIECES), PIECES).collect()
    lib = library()
    assert sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in got), key=str) == sorted(((i, lib.encode(t or ""), t or "") for i, t in rows), key=str)
    assert piece_tokens.decode(piece_tokens.encode(docs.limit(0), PIECES), PIECES).count() == 0


# Prefix trie


def brute_trie(conversations, rebuild):
    convs = defaultdict(list)
    for c, turn, role, said in conversations:
        if c is not None:
            role, said = role or "", said or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{said}".encode()).hexdigest(), said))
    convs = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
        convs = {c: convs.get(c - int(math.fmod(c, 5)), [])[: h[c]] + x[h[c] :] for c, x in convs.items()}
    members = defaultdict(list)
    for c, x in convs.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations_of(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 10**12]:
        if rng.random() < 0.1:
            continue
        for k in range(rng.choice((1, 2, 5, 9, 12))):
            rows.append((c, k, rng.choice(("user", "assistant")), rng.choice(("a", "bé", "", None, f"own {c} {k}")) if rng.random() < 0.5 else "hello"))
    base = [(k, "user", f"turn {k}") for k in range(700)]  # longer than a slice
    for c in (100, 101, 102, 103):
        rows += [(c, k, r, t) for k, r, t in base[: 700 - 100 * (c % 3)]] + [(c, 900, "user", f"end {c % 2}")]
    rows += [(200 + c, k, None, "copy") for c in range(40) for k in range(3)]
    rows += [(300, None, None, "x"), (300, None, None, "x"), (300, 1, "b", "y"), (300, 1, "a", "z"), (None, 1, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("rebuild", "cells"), [(False, None), (True, None), (True, 4)])
def test_prefix_trie(spark, rebuild, cells):
    """Also with a sketch that is too small to prove anything."""
    rows = conversations_of(1 + bool(cells))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"k1": F.lit("mine"), "depth": F.lit(1)})
    turns = prefix_trie.stored(prefix_trie.numbered(table.repartition(5)), "turns")
    pair = prefix_trie.rebuilt(turns) if rebuild else (turns, turns.where("at = 0").select("conv", "len"))
    got = prefix_trie.prefix_trie(*pair, cells=cells)
    assert sorted((tuple(r) for r in got.select(*COLS).collect()), key=str) == brute_trie(rows, rebuild)


def test_prefix_trie_of_turnless_and_empty(spark):
    rows = [(6, 0, "user", "a"), (11, 0, "user", "b")]  # without their donors, and h above 1 for both: turnless when rebuilt
    assert all(zlib.crc32(str(c).encode()) % 9 > 1 for c in (6, 11))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.stored(prefix_trie.numbered(table), "turns")))
    assert [tuple(r) for r in got.select(*COLS).collect()] == brute_trie(rows, True)
    assert prefix_trie.conversation_trie(table.limit(0)).count() == 0
    assert prefix_trie.conversation_trie(table).count() == 3


def test_estimates_of_one_are_singletons(spark):
    keys = spark.range(5000).select((F.xxhash64(F.col("id") % 3000)).alias("k1"), F.xxhash64(F.lit(1), F.col("id") % 3000).alias("k2"))
    keys = prefix_trie.stored(keys, "keys")
    for cells in (1 << 16, 1 << 18):
        alone = prefix_trie.screen(keys, cells)
        flagged = keys.select("k1", alone("k1", "k2").alias("alone")).groupBy("k1", "alone").count()
        assert flagged.where("alone and count > 1").count() == 0
        assert flagged.where("alone").count() > 900  # of 1,000 singletons


# Ids with several texts


def test_suffix_dedup_of_ids_with_several_texts(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    shared = text(rng, 60, vocab)
    rows = [(1, shared + text(rng, 20, vocab)), (2, text(rng, 60, vocab)), (2, text(rng, 10, vocab) + shared), (2, None), (None, shared), (None, text(rng, 40, vocab)), (9, shared), (9, shared)]
    got = suffix_dedup.remove_repeats(docs_df(spark, rows))
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.where("doc_id is not null").collect())
    # The brute force with a key for each text, in the order of id and SHA-256; equal rows are one document.
    order = sorted({((-1 if i is None else i), hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    want = brute_repeats([(k, t) for k, (_, _, t) in enumerate(order)], 100)
    expected = {(i, t): want[k] for k, (i, _, t) in enumerate(order)}
    assert found == sorted((i, *expected[(i, t or "")]) for i, t in rows if i is not None)
    assert not spark.catalog.listTables()


def test_ngram_links_of_ids_with_several_texts(spark):
    rng = random.Random(6)
    a, b, c = (text(rng, 80) for _ in range(3))
    rows = [(1, a), (2, b), (5, a + " x"), (5, b + " y"), (7, c), (8, c), (8, None), (9, ""), (None, a), (None, b)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_links(docs_df(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (5, 1), (5, 1), (7, 7), (8, 7), (8, 7), (9, 9), (None, None), (None, None)], key=str)


def test_ngram_links_of_equal_sets_only(spark):
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_links(docs_df(spark, [(1, "a b c d"), (2, "a b c d"), (3, "a b c e")]), percent=100).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


# Sections of operator 6


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_sections_in_any_order(rule):
    """Each section's counts are the same wherever it stands in the list; a token split evenly goes to the section that begins first."""
    rng = np.random.default_rng(3)
    for case in range(60):
        cuts = np.sort(rng.choice(40, 6, replace=False))
        spans = np.column_stack((cuts[:-1], cuts[1:])) if case % 2 else np.sort(rng.integers(0, 40, (5, 2)), axis=1)
        bounds = np.append(0, np.cumsum(rng.integers(1, 6, 9)))
        want = token_counts.attribute(bounds[:-1], bounds[1:], spans[np.lexsort((spans[:, 1], spans[:, 0]))], rule)
        order = rng.permutation(len(spans))
        got = token_counts.attribute(bounds[:-1], bounds[1:], spans[order], rule)
        back = np.lexsort((spans[order][:, 1], spans[order][:, 0]))
        assert [x[back].tolist() for x in got] == [x.tolist() for x in want]
    for spans in ([(0, 3), (3, 6)], [(3, 6), (0, 3)]):
        counts, _ = token_counts.attribute(np.array([2]), np.array([4]), np.array(spans), "majority")
        assert counts[spans.index((0, 3))] == 1 and counts.sum() == 1
