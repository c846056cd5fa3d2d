"""Sources: scans, streams, rule folders, labelled corpora, inventories."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import RuleSet, rule_set
from ..schemas import ENVELOPE, EVENTS

try:
    import yaml
except ImportError:
    yaml = None


def read_events(spark: SparkSession, path: str, frm: Column | None = None, to: Column | None = None, classes: Iterable[int] | None = None) -> DataFrame:
    """Stored events; the folder's date and class_uid prune files before any row is read."""
    df = spark.read.schema(EVENTS + ", date date").parquet(path)
    if frm is not None:
        df = df.where((F.col("date") >= F.to_date(frm)) & (F.col("ts") >= frm))
    if to is not None:
        df = df.where((F.col("date") <= F.to_date(to)) & (F.col("ts") <= to))
    return df if classes is None else df.where(F.col("class_uid").isin(*classes))


def stream_records(spark: SparkSession, fmt: str, schema: str | None = None, **options: str) -> DataFrame:
    """A streaming source: files, or any format whose connector is installed. The checkpoint's offsets make it at-least-once; the sinks are idempotent."""
    reader = spark.readStream.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def stream_envelopes(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return stream_records(spark, "json", ENVELOPE, path=path, **options).withColumnRenamed("timestamp", "ts")


def stream_syslog(spark: SparkSession, path: str, **options: str) -> DataFrame:
    lines = stream_records(spark, "text", None, path=path, **options)
    return lines.select(F.col("value").alias("line"), F.lit("").alias("from_ip"), F.current_timestamp().alias("received_at"))


def _files(spark: SparkSession, path: str, globs: tuple[str, ...]) -> list[tuple[str, str]]:
    """(name, text) of small configuration files: rules and labelled cases, not data."""
    df = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "{" + ",".join(globs) + "}").option("recursiveFileLookup", True).load(path)
    return sorted((r["name"], r["value"]) for r in df.select(F.col("_metadata.file_path").alias("name"), "value").collect())


def load_rules(spark: SparkSession, path: str) -> RuleSet:
    """All *.yml and *.yaml below path; the fingerprint is that of names and contents."""
    files = _files(spark, path, ("*.yml", "*.yaml"))
    return rule_set(spark, files, _fingerprint(files))


def _fingerprint(files: list[tuple[str, str]]) -> str:
    import hashlib

    h = hashlib.sha256()
    for name, text in files:
        h.update(name.encode() + b"\0" + hashlib.sha256(text.encode()).digest())
    return h.hexdigest()


def reload_rules(spark: SparkSession, path: str, present: RuleSet) -> RuleSet:
    """The present rules if no name or content changed, else the folder's."""
    files = _files(spark, path, ("*.yml", "*.yaml"))
    return present if _fingerprint(files) == present.fingerprint else rule_set(spark, files, _fingerprint(files))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases; a case's technique overrides its file's."""
    if yaml is None:
        raise RuntimeError("no YAML reader is installed")
    import json

    rows = []
    for name, text in _files(spark, path, ("*.yml", "*.yaml")):
        doc = yaml.safe_load(text) or {}
        for case in doc.get("cases") or []:
            rows.append((case.get("technique") or doc.get("technique"), doc.get("name") or name, str(case.get("name", "")), case.get("source"), int(case.get("class_uid") or doc.get("class_uid") or 0), case.get("os") or doc.get("os"), json.dumps(case.get("event") or {}), case.get("expect") or "detected"))
    return spark.createDataFrame(rows, "technique string, name string, case_name string, source string, class_uid int, os string, event string, expect string")


def hash_inventory(spark: SparkSession, path: str, largest: int = 128 << 20) -> DataFrame:
    """(path, mtime, size, sha256) of files up to `largest` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= largest)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
