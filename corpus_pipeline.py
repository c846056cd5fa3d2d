"""The corpus pipeline: five stages, each over all that the one before it kept, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.llm import decontamination, ngram_join, quality_rules, secret_scan, source_mix
from tracehold.llm.common import documents, scratch_path, small_join, stored

IDS = 1_000_000  # so many decisions are broadcast, more are joined by shuffle
MIX_SHARE = 0.5  # the last stage's budget: this share of the words it is given


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(docs with row_key, a whole number for each row; the renumbered rows or None).

    An id that one row alone has is its key. Rows whose id is null or repeated get numbers below all ids and are
    written once, so that their numbers hold.
    """
    shared = stored(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "pipeline-shared-ids")
    if not shared.limit(1).count():
        return docs.withColumn("row_key", F.col("doc_id").cast("long")), None
    some, named = shared.where("doc_id is not null"), docs.where("doc_id is not null")
    odd = docs.where("doc_id is null").unionByName(small_join(named, some, ["doc_id"], "left_semi", IDS).select(*docs.columns))
    below = min(docs.agg(F.min("doc_id")).head()[0] or 0, 0) - 1
    odd = stored(odd.withColumn("row_key", F.lit(below).cast("long") - F.monotonically_increasing_id()), "pipeline-odd-rows")
    own = small_join(named, some, ["doc_id"], "left_anti", IDS).select(*docs.columns).withColumn("row_key", F.col("doc_id").cast("long"))
    return own.unionByName(odd), odd


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows but those whose row_key is in keys."""
    gone = stored(keys.select("row_key"), "pipeline-dropped")
    return small_join(rows, gone, ["row_key"], "left_anti", IDS).drop("row_key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rows, _ = _keyed(docs)
    return _without(rows, quality_rules.judge(rows).where("not kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles have a Jaccard similarity of 0.8, and what is linked through others, the one with the smallest id stays (null after all ids); documents without words all stay."""
    rows, odd = _keyed(docs)
    linked = ngram_join.ngram_links(rows, n=5, percent=80, id_col="row_key")
    if odd is None:
        return _without(rows, linked.where(F.col("row_key") != F.col("component_id"))).select(*docs.columns)
    # Made-up numbers don't rank rows: the first of each component is chosen by the ids themselves.
    linked = stored(linked, "pipeline-linked")
    ids = odd.select("row_key", F.col("doc_id").alias("_id"), F.lit(True).alias("_odd"))
    ranked = small_join(linked, stored(ids, "pipeline-odd-ids"), ["row_key"], "left", IDS).withColumn("_id", F.when(F.col("_odd"), F.col("_id")).otherwise(F.col("row_key")))
    ranked = ranked.select("row_key", "component_id", F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), (-F.col("row_key")).alias("at")).alias("rank"))
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("first"))
    return _without(rows, ranked.join(first, "component_id").where(F.col("rank.at") != F.col("first.at"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go."""
    rows, _ = _keyed(docs)
    return decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_key").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by [secret]; n_chars follows."""
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "secret-ledger"))
    found = secret_scan.scan_versions(docs.select("doc_id", "text"), ledger, "doc_id", "text")
    key = F.concat_ws(":", F.to_json(F.struct("doc_id")), F.hex("blob"))
    hits = stored(found.where(F.size("spans") > 0).select(key.alias("_key"), "spans").dropDuplicates(["_key"]), "pipeline-secrets")
    own = F.concat_ws(":", F.to_json(F.struct("doc_id")), F.upper(F.sha2(F.coalesce("text", F.lit("")), 256)))
    joined = small_join(docs.withColumn("_key", own), hits, ["_key"], "left", 100_000)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secret_scan.redact(F.col("text"), F.col("spans")))
    clean = joined.withColumn("text", text)
    return clean.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of MIX_SHARE of the words, by the tempered shares of sources, languages and lengths, with its words and probability; want above 1 marks cells kept whole that fall short."""
    draw = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))  # null ids draw by their text
    mixed = source_mix.mix(docs.withColumn("_draw", draw), share=MIX_SHARE, id_col="_draw")
    return mixed.where("_kept").select(*docs.columns, F.col("_weight").cast("long").alias("n_words"), F.round("_p", 6).alias("p"), F.round("_want", 6).alias("want"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("secret scans", redact_secrets), ("source mix", mix_sources)]

#: The outlier and near-duplicate stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
