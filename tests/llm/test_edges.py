"""Defined cases of the operators: clashing columns, very long texts, rows without an id, hot groups, small groups."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehold.llm import chat_format, decontamination, license_scan, ngram_join, pii, quality_rules, secret_scan, source_mix, suffix_dedup, token_counts

from test_brute_force import brute_components, brute_pii, brute_repeats, brute_stats, docs_df, text

SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ("blob", "spans", "_path", "_text", "_want", "_row", "_found", "_p", "_kept", "_weight", "_w", "_x", "_z", "_d2", "_l", "kept", "base_failed", "distance2", "start", "end", "entry", "id", "n", "h", "doc", "sha", "data", "unit", "similarity", "label")


def wide(docs):
    """docs with further columns named as what the operators make."""
    return docs.select("*", *[F.lit("mine").alias(c) for c in CLASHES if c not in docs.columns])


def rows_of(df, *cols):
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


def small_table(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, 60 + k), "en", "s") for k in range(12)] + [(20, None, None, None), (21, "", "en", "s"), (22, "mail a@b.cd token=abcdefghijklmn", "en", "s"), (22, "mail a@b.cd token=abcdefghijklmn", "en", "s")]
    return spark.createDataFrame(rows, SCHEMA)


def operators(spark, tmp_path, name):
    items = spark.createDataFrame([(1, "the of and river stone under seven maps wind ledger copper field")], "item_id long, text string")
    ledger = lambda: secret_scan.Ledger(spark, f"file://{tmp_path}/{name}-{random.random()}")
    return {
        "op1": (lambda d: secret_scan.scan_versions(d, ledger(), "doc_id"), ("doc_id", "spans")),
        "op2": (suffix_dedup.remove_repeats, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
        "op3": (license_scan.scan_licenses, ("doc_id", "license", "dice", "unit", "n_units")),
        "op5": (pii.find_pii, ("doc_id", "spans")),
        "op6": (token_counts.count_tokens, ("doc_id", "section", "start", "end", "n_tokens", "n_crossing")),
        "op7": (source_mix.mix, ("doc_id", "_weight", "_p", "_kept")),
        "op8": (lambda d: decontamination.contaminated(d, items), ("doc_id", "item_id", "similarity")),
        "op9": (ngram_join.ngram_links, ("doc_id", "n_shingles", "component_id")),
        "op10": (quality_rules.judge, ("doc_id", *quality_rules.STATS, "base_failed", "kept")),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_clashing_columns_change_nothing(spark, tmp_path, name):
    docs = small_table(spark)
    run, cols = operators(spark, tmp_path, name)[name]
    plain, more = run(docs), run(wide(docs))
    assert rows_of(plain, *cols) == rows_of(more, *cols)
    more.write.parquet(f"{tmp_path}/{name}-out")  # each name once


def test_ids_named_as_result_columns(spark):
    docs = spark.createDataFrame([(1, "one two three")], "start long, text string")
    got = token_counts.count_tokens(docs, id_col="start")
    assert len(got.columns) == 6 and got.collect()[0][0] == 1


# Very long texts


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    body = text(rng, 200_000, vocab)
    secrets = " ".join(f"token=abcdefgh{k:08d}" for k in range(20_000))
    rows = [(1, body), (2, body[:600_000] + " changed " + body[600_000:]), (3, secrets), (4, "9" * 300_000), (5, "a" * 300_000 + "@b.cd")]
    docs = docs_df(spark, rows)
    ledger = secret_scan.Ledger(spark, f"file://{tmp_path}/ledger")
    found = {r.doc_id: len(r.spans) for r in secret_scan.scan_versions(docs, ledger, "doc_id").collect()}
    assert found[3] == 20_000 and found[1] == 0
    redacted = docs.where("doc_id = 3").join(secret_scan.scan_versions(docs, ledger, "doc_id").select("doc_id", "spans"), "doc_id").select(secret_scan.redact(F.col("text"), F.col("spans"))).head()[0]
    assert redacted == " ".join(["[secret]"] * 20_000)
    removed = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed[1] == (len(body), 0, 0) and removed[2][1] == len(body) and removed[2][2] == 2 and removed[4] == (300_000, 299_999, 1)
    links = {r.doc_id: r.component_id for r in ngram_join.ngram_links(docs).collect()}
    assert links[2] == 1 and links[3] == 3
    pieces = token_counts.count_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(pieces) == 5 and all(r.n > 0 for r in pieces)
    assert {r.doc_id: len(r.spans) for r in pii.find_pii(docs).collect()}[5] == 1
    stats = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules.with_statistics(docs).collect()}
    assert stats[3] == (20_000, 0) and stats[4] == (1, 0) and stats[1][0] == 200_000
    item = " ".join(body.split()[1000:1030])
    leaks = decontamination.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == {(1, 7), (2, 7)}
    notice = license_scan.TEMPLATES["zlib"]
    long_file = spark.createDataFrame([(1, body + "\n\n" + notice + "\n\n" + body)], "doc_id long, text string")
    assert {r.license for r in license_scan.scan_licenses(long_file).collect()} == {"zlib"}


# Suffix arrays


def test_one_passage_in_very_many_documents(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(300)
    rows = [(k, noise(rng.randint(40, 160)) + passage + noise(rng.randint(40, 160))) for k in range(1500)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs_df(spark, rows), hot=100).collect()}
    assert got == brute_repeats(rows, 100)


def test_anchors_come_twice_or_more():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 60, 400))
    doc, at = np.arange(400), np.arange(400) * 2
    for size in (1, 3, 7, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + size]) for x in (h, doc, at)], ["h", "doc", "at"]) for k in range(0, 400, size)]
        got = [r for b in suffix_dedup._several(5)(iter(batches)) for r in zip(*b.to_pydict().values(), strict=True)]
        counts = {x: int((h == x).sum()) for x in set(h.tolist())}
        assert sorted(r for r in got if r[1] is not None) == [(int(a), int(b), int(c)) for a, b, c in zip(h, doc, at, strict=True) if counts[int(a)] > 1]
        assert sorted(r[0] for r in got if r[1] is None) == sorted(x for x, n in counts.items() if n > 5)


# N-gram join


def test_frequent_tokens_and_many_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(900)]
    passage = text(rng, 70, vocab).split()
    rows = []
    for k in range(120):  # one passage in all, so its tokens are frequent, and near copies of near copies
        w = passage + text(rng, 12, vocab).split() if k % 3 else list(passage)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_links(docs_df(spark, rows)).collect()}
    assert got == brute_components(rows, 3, 90)


# Chat


def test_turns_without_a_conversation_and_all_marks(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (5, 0, "assistant", "c")]
    got = sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in chat_format.digests(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (5, 1, 1)]
    every = "".join(map(chr, range(0xE000, 0xF900)))
    out, _, mask, rewritten = chat_format.locate([("user", every), ("assistant", "x")], chat_format.marked_turns)
    assert [out[a:b] for a, b in mask] == ["x"] and not rewritten

    def drops(turns):
        return "".join(f"<{r}>{t}" for r, t in turns[-1:])

    table = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r"), (2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.rewritten for r in chat_format.format_conversations(table, drops).collect()} == {1: True, 2: False}


# Personal data


def test_contexts_of_long_words_and_long_identifiers(spark):
    word = "z" * 200
    rows = [(k, f"{word} reference a{k}@b.cd {word}") for k in range(8)] + [(50, f"{word} reference {'x' * 80}1234 {word}"), (51, "other 12345 words")]
    got = {r.doc_id: [(s.rank, s.start, s.end) for s in r.spans] for r in pii.find_pii(docs_df(spark, rows)).collect()}
    assert got[50] == [(4, 211, 295)] and got[51] == []
    assert pii.contexts("one two (a@b.c), end", [(9, 14)]) == [("two ", "")]
    assert pii.contexts("a@b.c", [(0, 5)]) == [("", "")] and pii.contexts("x y a@b.c z", [(4, 9)]) == [("x y", "z")]


def brute_patterns(instances, rounds, least):
    """instances: {(pattern, value): seed}."""
    belief = {v: 1.0 for (_, v), s in instances.items() if s}
    score = {}
    for _ in range(rounds):
        score = {}
        for p in {p for p, _ in instances}:
            own = [(v, s) for (q, v), s in instances.items() if q == p]
            if sum(s for _, s in own) >= least:
                score[p] = sum(1.0 if s else belief.get(v, 0.0) for v, s in own) / len(own)
        belief = {v: max([score[q] for (q, u), s in instances.items() if u == v and q in score], default=0.0) for (_, v) in instances}
    return score


def test_pattern_scores(spark):
    rng = random.Random(4)
    seeds = {v: int(rng.random() < 0.6) for v in range(40)}
    instances = {(f"p{rng.randrange(8)}", v): seeds[v] for v in range(40) for _ in range(3)}
    rows = [(p, v, s) for (p, v), s in instances.items()] * 2
    got = {r.pattern: r.score for r in pii.score_patterns(spark.createDataFrame(rows, "pattern string, value long, seed int"), 3, 5).collect()}
    assert got == pytest.approx(brute_patterns(instances, 3, 5))


def test_base_spans_of_repeated_rows(spark):
    rows = [(1, "a@b.cd 1.2.3.4"), (1, "a@b.cd 1.2.3.4"), (1, "other x@y.zz"), (None, "p@q.rs")]
    got = sorted((r.doc_id or 0, len(r.spans)) for r in pii.find_pii(docs_df(spark, rows)).collect())
    assert got == [(0, 1), (1, 1), (1, 2), (1, 2)] and len(brute_pii(rows[0][1])) == 2


# Token counts


def test_rules_for_crossing_tokens_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        ends = sorted(rng.sample(range(1, 60), rng.randint(1, 20)))
        starts = [0, *ends[:-1]]
        cuts = sorted(rng.sample(range(1, 60), rng.randint(1, 6)))
        sections = [(a, b) for a, b in zip([0, *cuts], [*cuts, 60], strict=True) if rng.random() < 0.8 or a == 0]
        for rule in token_counts.RULES:
            want = [0] * len(sections)
            for s, e in zip(starts, ends, strict=True):
                shares = [min(e, b) - max(s, a) for a, b in sections]
                if rule == "majority":
                    k = int(np.argmax(shares)) if max(shares) > 0 else None
                else:
                    at = s if rule == "start" else e - 1
                    k = next((i for i, (a, b) in enumerate(sections) if a <= at < b), None)
                if k is not None:
                    want[k] += 1
            got = token_counts.attribute(np.array(starts), np.array(ends), np.array(sections), rule)[0].tolist()
            assert got == want, (rule, starts, ends, sections)


# Decontamination


def test_short_items_are_whole_lines(spark):
    items = spark.createDataFrame([(1, "Forty two"), (2, "yes"), (3, ""), (4, None), (5, "the cat sat on the mat today")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Question?\n  forty-TWO.\nend"), (2, "forty two sheep"), (3, "Yes!"), (3, "Yes!"), (4, "forty\ntwo"), (5, None), (None, "yes"), (6, "so the cat sat on the mat today")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()) == [(1, 1), (3, 2), (4, 1), (6, 5)]
    assert sorted(r.doc_id or 0 for r in decontamination.decontaminate(docs, items).collect()) == [0, 2, 5]


# Quality rules


def brute_least_determinant(z, parent_mu, parent_c, weight, starts=60):
    """The least log-determinant over concentration steps from many random starts."""
    rng = np.random.default_rng(1)
    h, p, best = math.ceil(len(z) * quality_rules.KEEP_SHARE), z.shape[1], np.inf

    def estimate(part):
        w = len(part) / (len(part) + weight)
        c = w * quality_rules.CONSISTENT * np.cov(part.T, bias=True).reshape(p, p) + (1 - w) * parent_c
        mu = w * part.mean(axis=0) + (1 - w) * parent_mu
        ridged = (1 - quality_rules.RIDGE) * c + quality_rules.RIDGE * np.eye(p)
        return mu, np.linalg.inv(ridged), np.linalg.slogdet(ridged)[1]

    for _ in range(starts):
        mu, inv, _ = estimate(z[rng.choice(len(z), p + 1, replace=False)])
        last = np.inf
        for _ in range(50):
            d = np.einsum("ij,jk,ik->i", z - mu, inv, z - mu)
            mu, inv, det = estimate(z[np.argsort(d, kind="stable")[:h]])
            if det >= last - 1e-9:
                break
            last = det
        best = min(best, last)
    return best


def test_least_determinants_by_brute_force(spark):
    rng = np.random.default_rng(7)
    groups = {}
    for k, n in enumerate((400, 120, 30)):
        mix = rng.normal(size=(5, 5)) * 0.6 + np.eye(5)
        z = rng.normal(size=(n, 5)) @ mix
        z[: n // 6] += rng.normal(size=5) * 6  # a cluster apart
        groups[f"g{k}"] = z
    rows = [(g, [float(v) for v in x]) for g, z in groups.items() for x in z]
    table = spark.createDataFrame(rows, "_lang string, _z array<double>")
    got = {r["_lang"]: r["_det"] for r in quality_rules.least_determinants(table, ["_lang"]).collect()}
    for g, z in groups.items():
        want = brute_least_determinant(z, np.zeros(5), np.eye(5), quality_rules.PRIOR)
        assert got[g] <= want + 0.15, (g, got[g], want)


def test_groups_of_any_size_are_judged(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = [(k, text(rng, rng.randint(60, 400), vocab), "en", "s") for k in range(150)]
    rows += [(500, text(rng, 100, vocab), "xx", "one"), (501, " ".join(w + "$$$%%%" for w in text(rng, 100, vocab).split()), "yy", "two"), (502, None, None, None), (500, text(rng, 90, vocab), "xx", "one")]
    got = [(r.doc_id, r.kept) for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert all(kept for k, kept in got if k < 501) and (501, False) in got and (502, False) in got and len(got) == len(rows)
    stats = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.with_statistics(spark.createDataFrame(rows[:5], SCHEMA)).collect()}
    assert stats == {k: brute_stats(t) for k, t, *_ in rows[:5]}


# Source mix


def brute_fit(cells, targets, turns):
    w = {k: v for k, v in cells.items()}
    for _ in range(turns):
        for axis, want in enumerate(targets):
            sums = {}
            for k, v in w.items():
                sums[k[axis]] = sums.get(k[axis], 0.0) + v
            w = {k: v * want[k[axis]] / sums[k[axis]] for k, v in w.items()}
    return w


def test_probabilities_by_brute_force(spark):
    rng = random.Random(12)
    rows = [(k, "word " * rng.randint(1, 400), rng.choice(["en", "de", None]), rng.choice("abc")) for k in range(400)]
    got = {r.doc_id: r["_p"] for r in source_mix.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    topic = lambda t: "short" if len(t) < 1000 else "middle" if len(t) < 4000 else "long"
    cells = {}
    for _, t, lang, source in rows:
        key = (source, lang, topic(t))
        cells[key] = cells.get(key, 0) + len(t.split())
    total = sum(cells.values())
    targets = []
    for axis in range(3):
        sums = {}
        for k, v in cells.items():
            sums[k[axis]] = sums.get(k[axis], 0) + v
        tempered = {v: s**0.8 for v, s in sums.items()}
        targets.append({v: s / sum(tempered.values()) for v, s in tempered.items()})
    fitted = brute_fit(cells, targets, 200)
    ratio = {k: fitted[k] / (cells[k] / total) for k in cells}
    for k, t, lang, source in rows:
        assert got[k] == pytest.approx(ratio[source, lang, topic(t)] / max(ratio.values()), abs=2e-3)


def test_targets_that_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "en", "x", 10.0), ("b", "de", "x", 10.0)], "_source string, _lang string, _topic string, _w double")
    target = lambda key, **t: spark.createDataFrame(list(t.items()), f"{key} string, target double")
    clash = {"_source": target("_source", a=0.9, b=0.1), "_lang": target("_lang", en=0.2, de=0.8)}
    with pytest.raises(ValueError, match="can't be met"):
        source_mix.fit(cells, clash, strict=True)
    loose = {r["_source"]: r["_fit"] for r in source_mix.fit(cells, clash).collect()}
    assert loose == pytest.approx({"a": 0.2, "b": 0.8}, abs=1e-6)
    twice = {"_source": spark.createDataFrame([("a", 0.3), ("a", 0.3), ("b", 0.4), ("zz", 5.0)], "_source string, target double")}
    assert {r["_source"]: r["_fit"] for r in source_mix.fit(cells, twice).collect()} == pytest.approx({"a": 0.6, "b": 0.4}, abs=1e-6)
    assert [r["_source"] for r in source_mix.absent_targets(cells, "_source", twice["_source"]).collect()] == ["zz"]
