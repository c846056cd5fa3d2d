"""The pipeline's stages over a small input, each held against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(30)) for k in range(4)]
    rows = [[k, text(rng.randint(60, 200)), "en", f"s{k % 2}"] for k in range(80)]
    rows[5][1] = rows[2][1]
    rows[6][1] = rows[3][1] + " extra words here"
    rows[10][1] += " " + items[1][1] + " tail"
    rows[11][1] += " password=abcdef0123456789abcdef and more"
    rows[12][1] = "short"
    rows[13][1] = "one two three " * 60
    rows[14][1] = None
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, table = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, str(tmp_path))
        assert k == 4 or table.columns == docs.columns
        table.write.parquet(str(tmp_path / f"stage{k}"))
        table = spark.read.parquet(str(tmp_path / f"stage{k}"))
        left.append({r.doc_id for r in table.select("doc_id").collect()})
    every = set(range(80))
    assert left[0] == every - {12, 13, 14}
    assert left[1] == left[0] - {5, 6}
    assert left[2] == left[1] - {10}
    assert left[3] == left[2] and left[4] <= left[3] and left[4]
    clean = spark.read.parquet(str(tmp_path / "stage3")).where("doc_id = 11").head()
    assert "[secret]" in clean.text and not re.search("[0-9a-f]{16}", clean.text) and clean.n_chars == len(clean.text)
    same = spark.read.parquet(str(tmp_path / "stage3")).where("doc_id <> 11").join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t")
    assert same.count() == 0


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, clean, copied, shared = text(30), text(120), text(120), text(120)
    leaked = text(100) + " " + item
    rows = [(None, "short"), (None, clean), (None, copied), (None, copied), (7, "tiny"), (7, shared), (None, leaked), (3, clean + " tail"), *((100 + k, text(120)) for k in range(20))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table, left = docs, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        table = stage(spark, table, str(tmp_path))
        left.append(sorted((r.doc_id or -1, r.text) for r in table.where("doc_id is null or doc_id < 100").collect()))
    assert left[0] == sorted([(-1, clean), (-1, copied), (-1, copied), (7, shared), (-1, leaked), (3, clean + " tail")])
    assert left[1] == sorted([(-1, copied), (7, shared), (-1, leaked), (3, clean + " tail")])
    assert left[2] == sorted([(-1, copied), (7, shared), (3, clean + " tail")])
