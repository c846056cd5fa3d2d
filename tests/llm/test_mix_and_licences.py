from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracehold.llm import license_scan, source_mix


def test_marginals_are_met(spark):
    rows = [(s, la, t, w) for s, la, t, w in (("a", "en", "x", 50.0), ("a", "de", "y", 10.0), ("b", "en", "y", 20.0), ("b", "de", "x", 5.0), ("b", "de", "y", 15.0))]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, _w double")
    target = lambda key, **t: spark.createDataFrame(list(t.items()), f"{key} string, target double")
    fitted = source_mix.fit(cells, {"_source": target("_source", a=0.5, b=0.5), "_lang": target("_lang", en=0.6, de=0.4), "_topic": target("_topic", x=0.55, y=0.45)}, turns=60)
    for key, want in (("_source", {"a": 0.5, "b": 0.5}), ("_lang", {"en": 0.6, "de": 0.4}), ("_topic", {"x": 0.55, "y": 0.45})):
        got = {r[key]: r["s"] for r in fitted.groupBy(key).agg(F.sum("_fit").alias("s")).collect()}
        assert got == pytest.approx(want, abs=1e-3)


def test_mix_edge_rows(spark):
    rows = [(k, "word " * (k % 7 + 1), "en" if k % 3 else None, "s1" if k % 2 else "s2") for k in range(300)] + [(None, None, None, None), (900, "", "en", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("target", F.lit(1))
    out = source_mix.mix(docs, {"source": spark.createDataFrame([("s1", 0.9), ("s2", 0.1)], "source string, share double")})
    assert out.count() == 302 and out.where("_p <= 0 or _p > 1").count() == 0
    kept = out.where("_kept")
    share = {r.source: r.w for r in kept.groupBy("source").agg(F.sum("_weight").alias("w")).collect()}
    assert share["s1"] > 4 * share["s2"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in source_mix.mix(docs, {"source": spark.createDataFrame([("s1", 0.9), ("s2", 0.1)], "source string, share double")}).where("_kept").collect())
    assert source_mix.mix(docs.limit(0)).count() == 0


def test_licences(spark):
    mit = license_scan.TEMPLATES["mit"]
    rows = [(1, "intro\n\n" + mit.upper() + "\n\nend"), (2, mit.replace("Software", "Program", 2)), (3, "x\nReleased under the MIT License!\ny"), (4, None), (5, ""), (6, "licensed under"), (7, "word " * 50), (3, "x\nReleased under the MIT License!\ny")]
    got = {(r.doc_id, r.license): (r.dice, r.unit) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "mit"] == (1.0, "paragraph") and got[2, "mit"][0] > 0.9 and got[3, "mit-line"] == (1.0, "line")
    assert set(got) == {(1, "mit"), (2, "mit"), (3, "mit-line")}
    assert license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_one_rare_document_does_not_shrink_the_mix(spark):
    rows = [(k, "word " * 50, "en" if k % 2 else "de", "s1" if k % 3 else "s2") for k in range(600)]
    rare = [*rows, (600, "word " * 5, "xx", "s9")]
    kept = {}
    for name, table in (("plain", rows), ("rare", rare)):
        docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
        mixed = source_mix.mix(docs, share=0.5)
        words = {r.k: r.w for r in mixed.groupBy(F.col("_kept").alias("k")).agg(F.sum("_weight").alias("w")).collect()}
        kept[name] = words[True] / sum(words.values())
        expected = mixed.agg(F.sum(F.col("_weight") * F.col("_p")) / F.sum("_weight")).head()[0]
        assert expected == pytest.approx(0.5, abs=1e-6)
    assert kept["plain"] == pytest.approx(0.5, abs=0.1) and kept["rare"] == pytest.approx(0.5, abs=0.1)
    short = source_mix.shortfall(mixed).collect()
    assert [r._source for r in short] == ["s9"] and short[0].words == 5 and short[0].missing > 0
    assert mixed.where("doc_id = 600 and _kept").count() == 1
    assert source_mix.mix(docs, share=1.0).where("not _kept").count() == 0
    assert source_mix.mix(docs.limit(0), share=0.5).count() == 0


def test_licences_of_several_paragraphs_inside_longer_files(spark):
    body = " ".join(license_scan.TEMPLATES["mit"].split())
    at, end = body.index("The above"), body.index("THE SOFTWARE IS")
    blank_lines = "\n\n".join((body[:at], body[at:end], body[end:]))
    code = "\n".join(f"value{k} = call{k}(other{k}, {k})" for k in range(80))
    notice = license_scan.TEMPLATES["apache-2.0-notice"]
    touching = "import os\n# " + notice.replace("\n", "\n# ") + "\n" + code
    rows = [(1, f"Copyright 2020 Someone\n\n{blank_lines}\n\n{code}"), (2, touching), (3, code), (None, f"{code}\n\n{blank_lines}")]
    got = {(r.doc_id, r.license): (r.dice, r.unit) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "mit"] == (1.0, "window") and got[None, "mit"] == (1.0, "window") and got[2, "apache-2.0-notice"] == (1.0, "window")
    assert not any(k[0] == 3 for k in got)
