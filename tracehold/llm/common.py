"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, written out so that Java, RE2 and Python agree.
WS = r"[\x20\x09-\x0D]+"

_own_dir: str | None = None
_spaces: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session, as in tests, gets a temporary one; elsewhere executors would write where others can't read, so that is an error."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tracehold-")
    return f"file://{_own_dir}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _spaces:
        _spaces[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidily(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, stored; all that it stored on the way is removed."""
    _spaces.append([])
    try:
        df = make()
        spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
        df.write.parquet(path)
        if len(_spaces) > 1:
            _spaces[-2].append(path)
        return spark.read.schema(df.schema).parquet(path)
    finally:
        active = SparkSession.getActiveSession()
        for path in _spaces.pop():
            if active is not None:
                discard(active, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs inside: what a Python worker and the JVM hold of texts or sets at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", max_rows: int = 50_000) -> DataFrame:
    """Joins a stored right side; it is broadcast only if it was counted to be at most max_rows rows, else joined by shuffle."""
    if right.limit(max_rows + 1).count() <= max_rows:
        right = F.broadcast(right)
    return left.join(right, on, how)


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that the optimizer doesn't put in place of its name again: inside a lambda it would be computed once for each element."""
    return df.select(*[c for c in df.columns if c != name], F.inline(F.array(F.struct(value.alias(name)))))


def several_texts(rows: DataFrame, id_col: str, text_digest: Column) -> bool:
    """Whether an id comes with more than one text."""
    range_of = rows.groupBy(F.col(id_col).alias("_id")).agg(F.min(text_digest).alias("lo"), F.max(text_digest).alias("hi"))
    return range_of.where("lo <> hi").limit(1).count() > 0


def ordered_keys(rows: DataFrame, *cols: str) -> DataFrame:
    """rows (distinct by cols), stored, with key: a whole number that rises with cols. One sort by ranges."""
    return stored(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("key", F.monotonically_increasing_id()), "ordered-keys")


def words(text: Column) -> Column:
    """Words are runs of characters other than white space; null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the values: the first 13 hex digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
