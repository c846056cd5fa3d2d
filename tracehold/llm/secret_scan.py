"""Operator 1: secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. A ledger keeps, for each blob, the
rule versions that have been run on it and the spans they found; a scan runs only the pairs of blob and
rule version that the ledger lacks, and the findings are joined back to every path that holds the blob.

Defined results: null text counts as the empty text; a null path is a path of its own; an empty table gives an empty result and an empty ledger
batch; repeated rows of one path and version are repeated in the result; other columns are carried through, but for those
named blob, spans or as a working column (_path, _text, _want, _todo, _seen, _live, _spans), which the operator's own replace. Spans count code points, end exclusive, and don't overlap
within a rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch_path, stored

SPAN = "array<struct<start:int,rank:int,end:int,rule:string>>"
FEW = 64


@dataclass(frozen=True)
class Rule:
    """pattern: what is matched, leftmost and non-overlapping. If min_value is set, matches whose group `value_group` is shorter are dropped after matching."""

    name: str
    version: int
    pattern: str
    value_group: int = 0
    min_value: int = 0

    @property
    def pair(self) -> str:
        return f"{self.name}@{self.version}"


#: The first three are the base rules. `{14,}` and `{16,}` find the same matches as the open patterns followed by
#: the length test, as a run that is too short holds no longer one.
RULES = (
    Rule("assign", 1, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


def _fold(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """The array (of type `kind`) of what step gives for each item: (new place, entry, whether it is kept). Entries are gathered in short arrays of FEW, so that a text with very many matches isn't copied once for each."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("few"), F.array().cast(f"array<{kind}>").alias("out"))

    def one(acc: Column, item: Column) -> Column:
        at, entry, keep = step(acc, item)
        full = F.size(acc["few"]) >= FEW
        more = F.when(full, F.struct(at.alias("at"), F.array(entry).alias("few"), F.array_append(acc["out"], acc["few"]).alias("out")))
        more = more.otherwise(F.struct(at.alias("at"), F.array_append(acc["few"], entry).alias("few"), acc["out"].alias("out")))
        return F.when(keep, more).otherwise(F.struct(at.alias("at"), acc["few"].alias("few"), acc["out"].alias("out")))

    return F.aggregate(items, first, one, lambda acc: F.concat(F.flatten(acc["out"]), acc["few"]))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """All matches with positions: the pieces between matches (split) and the matches give running offsets."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    lens = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.value_group)), lambda m: F.length(m))
    rows = F.arrays_zip(gaps.alias("gap"), lens.alias("len"), value.alias("value"))

    def step(acc: Column, row: Column) -> tuple[Column, Column, Column]:
        start = acc["at"] + row["gap"]
        end = start + F.coalesce(row["len"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.name).alias("rule"))
        return end, span, row["len"].isNotNull() & (row["value"] >= rule.min_value)

    found = _fold(rows, SPAN, step)
    return F.when(F.regexp(text, pattern), found).otherwise(F.array().cast(SPAN))


class Ledger:
    """A folder of Parquet batches (blob, pairs, spans); each scan adds one batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = f"blob binary, pairs array<string>, spans {SPAN}"

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        if self.exists():
            return self.spark.read.schema(self.schema).parquet(self.path)
        return self.spark.createDataFrame([], self.schema)

    def add(self, batch: DataFrame) -> None:
        batch.write.mode("append").parquet(self.path)


def scan_versions(versions: DataFrame, ledger: Ledger, path_col: str = "path", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, other columns but the text, blob, spans) for every version; spans sorted by start, then rule.

    path_col must tell rows apart up to repeats of the same content: it only serves to pick, for each unseen blob,
    one row whose text is scanned.
    """
    own = ("blob", "spans", "_path", "_text", "_want", "_todo", "_seen", "_live", "_spans")
    versions = versions.drop(*[c for c in own if c not in (path_col, text_col)])
    versions = versions.withColumn("_path", F.coalesce(F.col(path_col).cast("string"), F.lit("")))
    content = F.coalesce(F.col(text_col), F.lit(""))
    blob_of = lambda c: F.unhex(F.sha2(c, 256))
    held = stored(versions.select(*[c for c in versions.columns if c != text_col], blob_of(content).alias("blob")), "blob-paths")
    pairs = F.array(*[F.lit(r.pair) for r in rules])
    holders = held.groupBy("blob").agg(F.min("_path").alias("_path"))
    if ledger.exists():
        seen = ledger.read().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("_seen"))
        holders = holders.join(seen, "blob", "left").withColumn("_todo", F.array_except(pairs, F.coalesce("_seen", F.array().cast("array<string>")))).drop("_seen")
        holders = holders.where(F.size("_todo") > 0)
    else:
        holders = holders.withColumn("_todo", pairs)
    # One row stands for each unseen blob. A path with several contents is told apart by the blob itself.
    texts, wanted = versions.select("_path", content.alias("_text")), holders.select("_path", F.col("blob").alias("_want"), "_todo").hint("shuffle_hash")
    if _repeats(held):
        unseen = texts.withColumn("_want", blob_of(F.col("_text"))).join(wanted, ["_path", "_want"]).dropDuplicates(["_path", "_want"])
    else:
        unseen = texts.join(wanted, "_path")
    found = F.array_sort(F.concat(*[F.when(F.array_contains("_todo", r.pair), _spans(F.col("_text"), r, k)).otherwise(F.array().cast(SPAN)) for k, r in enumerate(rules)]))
    ledger.add(unseen.select(F.col("_want").alias("blob"), F.col("_todo").alias("pairs"), found.alias("spans")))
    # Back to all paths; only blobs with findings take part, and spans of retired rule versions don't.
    names = F.array(*[F.lit(r.name) for r in rules])
    hits = ledger.read().where(F.size("spans") > 0).withColumn("_live", F.transform(F.filter("pairs", lambda p: F.array_contains(pairs, p)), lambda p: F.split(p, "@")[0]))
    hits = hits.select("blob", F.filter("spans", lambda s: F.array_contains(F.col("_live"), s["rule"]) & F.array_contains(names, s["rule"])).alias("_spans"))
    hits = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("_spans"))).alias("spans"))
    out = held.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    return out.drop("_path")


def _repeats(held: DataFrame) -> bool:
    """Whether some path comes more than once (several versions, or repeated rows)."""
    return held.groupBy("_path").count().where("count > 1").limit(1).count() > 0


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, joined by commas, of spans sorted by start and then kind."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["rule"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each run of overlapping spans (sorted by start) replaced by the mark."""

    def step(acc: Column, s: Column) -> tuple[Column, Column, Column]:
        before = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.greatest(acc["at"], s["end"]), before, s["start"] >= acc["at"]

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(F.array_join(_fold(spans, "array<string>", step), ""), F.substring(text, F.coalesce(end, F.lit(0)) + 1, F.length(text)))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all rules, with a ledger of its own that begins empty."""
    ledger = Ledger(spark, scratch_path(spark, "secret-ledger"))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan_versions(docs, ledger, "doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(digest(F.col("spans"), BASE), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The same spans in DuckDB: matches and the pieces between them, with running lengths."""
    parts = []
    for k, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
        select doc_id, {k} as rank, '{rule.name}' as rule, s.i as i, length(s.g) as gap, s.m as m, s.v as v
        from (select doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda x: {{'i': x, 'g': gs[x], 'm': ms[x], 'v': vs[x]}})) as s
              from (select doc_id, regexp_extract_all(t, '{pattern}', 0) as ms, regexp_extract_all(t, '{pattern}', {rule.value_group}) as vs,
                           regexp_split_to_array(t, '{pattern}') as gs from docs)) """)
    lengths = " ".join(f"when {k} then {r.min_value}" for k, r in enumerate(RULES))
    base = ", ".join(f"'{k}'" for k in BASE)
    text = "rule || ':' || s || ':' || e"
    return f"""
    with docs as (select doc_id, coalesce(text, '') as t from documents),
    found as ({" union all ".join(parts)}),
    placed as (select *, sum(gap + length(m)) over (partition by doc_id, rank order by i) as e from found),
    spans as (select doc_id, rank, rule, (e - length(m))::bigint as s, e::bigint as e from placed where length(v) >= case rank {lengths} end)
    select d.doc_id, count(*) filter (rule = 'assign') as n_assign, count(*) filter (rule = 'access') as n_access, count(*) filter (rule = 'hex') as n_hex,
           sha256(coalesce(string_agg({text}, ',' order by s, rank) filter (rule in ({base})), '')) as base_sha256,
           coalesce(string_agg({text}, ',' order by s, rank) filter (rule is not null), '') as spans
    from docs d left join spans using (doc_id) group by d.doc_id"""
