"""Detection: rules over events, indicator matches, suppressions.

Events are canonical rows (id, ts, class_uid, asset_id, raw, ...); `fields` may give typed columns for hot paths so that
no JSON is parsed for them. Every operator keeps the events' partitioning: rules are evaluated in one scan, and the dimension tables are joined without a hint, so that their size decides.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import CLASS_SOURCES, Body, Rule, RuleRejected, compile_rule, paths_of
from ..functions.rule_index import RuleIndex
from ..functions.scalars import ioc_kind, ip_text, parent_domains, technique_match

CHUNK = 100  # rules in one projection, below the size limit of generated methods
FEW_RULES = 30  # so many are tried one by one, more go through an index; the hits are the same


@dataclass(frozen=True)
class RuleSet:
    """Compiled rules, the rules table and the report of skipped ones."""

    rules: tuple[Rule, ...]
    rules_df: DataFrame
    skipped_df: DataFrame
    fingerprint: str = ""


RULES_SCHEMA = "rule_id string, title string, severity int, class_uid int, product string, tactics array<string>, techniques array<string>"


def rule_set(spark: SparkSession, sources: Iterable[tuple[str, str | dict]], fingerprint: str = "") -> RuleSet:
    """sources: (name, YAML text or dictionary). A bad rule is reported and blocks no other; of two rules with one id both are evaluated."""
    rules, skipped = [], []
    for name, source in sources:
        try:
            rules.append(compile_rule(source))
        except RuleRejected as e:
            skipped.append((name, str(e)))
    table = [(r.id, r.title, r.severity, r.class_uid, r.product, list(r.tactics), list(r.techniques)) for r in rules]
    return RuleSet(tuple(rules), spark.createDataFrame(table, RULES_SCHEMA), spark.createDataFrame(skipped, "name string, skip_reason string"), fingerprint)


def check_rules(sources: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """sources (name, rule: YAML or JSON text): (name, rule_id, title, class_uid, skip_reason), one row each, compiled where the rows lie. known: (rule_id) of stored rules, which a new one may not replace."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch["name"], batch["rule"], strict=True):
                try:
                    rule = compile_rule(json.loads(text) if text.lstrip().startswith("{") else text)
                    out.append((name, rule.id, rule.title, rule.class_uid, None))
                except (RuleRejected, ValueError) as e:
                    out.append((name, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["name", "rule_id", "title", "class_uid", "skip_reason"]).astype({"class_uid": "Int32"})

    checked = sources.select("name", F.coalesce("rule", F.lit("")).alias("rule")).mapInPandas(run, "name string, rule_id string, title string, class_uid int, skip_reason string")
    if known is None:
        return checked
    stored = known.select("rule_id").distinct().withColumn("_known", F.lit(True))
    return checked.join(stored, "rule_id", "left").select("name", "rule_id", "title", "class_uid", F.when(F.col("_known"), F.concat(F.lit("a rule has this id: "), "rule_id")).otherwise(F.col("skip_reason")).alias("skip_reason"))


def _in_scope(rule: Rule, class_uid: Column, os: Column) -> Column:
    """Class and system gates: an unknown system doesn't exclude a rule."""
    out = F.lit(True) if rule.class_uid is None else F.coalesce(class_uid == rule.class_uid, F.lit(False))
    return out if rule.product is None else out & (os.isNull() | (os == "") | (os == rule.product))


def _gate(rule_class: Column, product: Column, class_uid: Column, os: Column) -> Column:
    """_in_scope for a rule that is data."""
    return (rule_class.isNull() | F.coalesce(class_uid == rule_class, F.lit(False))) & (product.isNull() | os.isNull() | (os == "") | (os == product))


def _barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that is computed once, however often its name is used: the optimizer moves no expression across a generator."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


class _Read:
    """A body whose fields have been read: one column for each path, one for all scalars."""

    def __init__(self, paths: dict[str, int]):
        self.paths = paths

    def text(self, path: str) -> Column:
        return F.col("_fields")[f"f{self.paths[path]}"]

    def flat(self) -> Column:
        return F.col("_fields")["flat"]


def match_rules(events: DataFrame, rules: RuleSet | Iterable[Rule], fields: dict[str, Column] | None = None, keep: Iterable[str] = (), raw: str | None = "raw", os: str | None = None, few: int = FEW_RULES) -> DataFrame:
    """One row for each event and rule that hits: id, ts, class_uid, the `keep` columns, rule_id, severity.

    One scan, whatever the number of rules: a body is parsed once, each path that some rule reads is taken out of it
    once, and an event is held against the rules of its class and those of no class. More than `few` rules are data
    and not expressions: an index of their literals says which of them an event may hit, and only those are evaluated.
    """
    rules = rules.rules if isinstance(rules, RuleSet) else tuple(rules)
    cols = ["id", "ts", "class_uid", *keep]
    if not rules:
        return events.limit(0).select(*cols, F.lit("").alias("rule_id"), F.lit(0).alias("severity"))
    asked = set().union(*(paths_of(r.predicate) for r in rules))
    whole = None in asked
    numbers = {p: k for k, p in enumerate(sorted(asked - {None}))}
    classes = {r.class_uid for r in rules}
    scan = events if None in classes else events.where(F.col("class_uid").isin(*sorted(classes)))
    body = Body(F.col(raw) if raw else None, fields)
    if raw and any(p not in body.fields for p in numbers):
        scan = _barrier(scan, "_body", body.variant)
        body.variant = F.col("_body")
    read = [body.text(p).alias(f"f{k}") for p, k in numbers.items()] + ([body.flat().alias("flat")] if whole else [])
    scan = _barrier(scan.withColumn("_os", F.lower(F.col(os)) if os else F.lit(None).cast("string")), "_fields", F.struct(*read) if read else F.lit(0))
    ready = _Read(numbers)

    def hits(some: list[Rule]) -> Column:
        """Arrays of CHUNK rules, so that no generated method gets too long."""
        one = [F.when(_in_scope(r, F.col("class_uid"), F.col("_os")) & r.predicate(ready), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in some]
        parts = [F.array_compact(F.array(*one[k : k + CHUNK])) for k in range(0, len(one), CHUNK)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    none = F.array().cast("array<struct<rule_id:string,severity:int>>")
    indexed = none
    if len(rules) > few:
        index = RuleIndex(list(rules), numbers | ({None: len(numbers)} if whole else {}))
        rules = tuple(index.left)
        texts = [ready.text(p) for p in numbers] + ([ready.flat()] if whole else [])
        scan = _barrier(scan, "_texts", F.array(*texts) if texts else F.array().cast("array<string>"))
        scan = _barrier(scan, "_low", F.transform("_texts", F.lower))
        scan = _barrier(scan, "_maybe", index.candidates(F.col("_low")))
        indexed = index.hits(F.col("_maybe"), F.col("_texts"), F.col("_low"), lambda c, product: _gate(c, product, F.col("class_uid"), F.col("_os")))
    of_class = none
    for c in sorted({r.class_uid for r in rules} - {None}):
        of_class = F.when(F.col("class_uid") == c, hits([r for r in rules if r.class_uid == c])).otherwise(of_class)
    general = [r for r in rules if r.class_uid is None]
    found = F.concat(of_class, hits(general)) if general else of_class
    if indexed is not none:
        found = F.concat(indexed, found) if rules else indexed
    return _barrier(scan, "_hits", found).select(*cols, F.explode("_hits").alias("hit")).select(*cols, "hit.rule_id", "hit.severity")


# Indicators

#: Keys of a body whose strings are probed, by kind.
LEAF_KINDS = {"ip": "ip", "hostname": "domain", "sni": "domain", **{k: "hash" for k in ("sha256", "sha1", "md5", "hashes", "hash", "ja3_hash", "ja3s_hash")}}


def keyed_strings(raw: Column, keys: Iterable[str]) -> Column:
    """array<struct<key, value>> of the strings in a JSON text that stand under one of the keys, at any depth; strings in arrays, nested ones too, stand under the array's key.

    The text's brackets, keys and strings are folded in order, with the keys of the open brackets as a stack.
    """
    string = r'"(?:[^"\\]|\\.)*"'
    tokens = F.regexp_extract_all(raw, F.lit(rf"{string}\s*:|{string}|[\[\]{{}}]"), F.lit(0))
    wanted = F.array(*[F.lit(k) for k in keys])
    out = "array<struct<key:string,value:string>>"
    start = F.struct(F.lit("").alias("key"), F.array().cast("array<string>").alias("stack"), F.array().cast(out).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        first, key, stack, found = F.substring(t, 1, 1), acc["key"], acc["stack"], acc["out"]
        state = lambda k, s, o: F.struct(k.alias("key"), s.alias("stack"), o.alias("out"))
        value = F.try_variant_get(F.try_parse_json(t), "$", "string")
        return (
            F.when(first.isin("{", "["), state(key, F.array_append(stack, key), found))
            .when(first.isin("}", "]"), state(F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("")), F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))), found))
            .when(t.endswith(":"), state(F.regexp_extract(t, '^"(.*)"', 1), stack, found))
            .when(F.array_contains(wanted, key) & (value != ""), state(key, stack, F.array_append(found, F.struct(key.alias("key"), value.alias("value")))))
            .otherwise(acc)
        )

    any_key = F.concat(F.lit('"('), F.lit("|".join(keys)), F.lit(')"'))
    return F.when(F.try_parse_json(raw).isNotNull() & F.regexp(raw, any_key), F.aggregate(tokens, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(out))


def intel_candidates(raw: Column) -> Column:
    """array<struct<kind, value>> of a body, by the name of the key a string stands under. Names are given with all their parents."""
    kinds = F.create_map(*[F.lit(x) for kv in LEAF_KINDS.items() for x in kv])

    def values(entry: Column) -> Column:
        kind = F.element_at(kinds, entry["key"])
        low = F.lower(entry["value"])
        probes = F.when(kind == "domain", parent_domains(low)).when(kind == "ip", F.array(ip_text(entry["value"]))).otherwise(F.array(low))
        return F.transform(probes, lambda v: F.struct(kind.alias("kind"), v.alias("value")))

    return F.array_distinct(F.flatten(F.transform(keyed_strings(raw, LEAF_KINDS), values)))


def match_intel(events: DataFrame, intel: DataFrame, candidates: Column | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Hits `intel:<kind>:<value>`, one for each event and indicator that was valid at the event's time: id, ts, class_uid, keep, rule_id, severity, ioc_id."""
    cols = ["id", "ts", "class_uid", *keep]
    probes = events.select(*cols, F.explode(candidates if candidates is not None else intel_candidates(F.col("raw"))).alias("c")).select(*cols, F.col("c.kind").alias("kind"), F.col("c.value").alias("value")).distinct()
    known = intel.select("kind", F.when(F.col("kind") == "ip", ip_text("value")).otherwise(F.lower("value")).alias("value"), F.col("severity"), F.col("id").alias("ioc_id"), "expires_at")
    hits = probes.join(known, ["kind", "value"]).where(F.col("expires_at").isNull() | (F.col("ts") <= F.col("expires_at")))
    return hits.select(*cols, F.concat_ws(":", F.lit("intel"), "kind", "value").alias("rule_id"), "severity", "ioc_id")


def import_intel(lines: DataFrame, existing: DataFrame, source: str = "import", severity: int = 4, expires_days: int = 0, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """lines: text (one or many lines a row). (new rows, one row with imported and skipped); blank lines and # comments don't count, duplicates are skipped."""
    now = now if now is not None else F.current_timestamp()
    one = lines.select(F.posexplode(F.split("text", "\n")).alias("at", "line")).select("at", F.trim(F.regexp_replace("line", "\r$", "")).alias("line"))
    one = one.where((F.col("line") != "") & ~F.col("line").startswith("#")).select("at", ioc_kind("line").alias("k")).select("at", "k.kind", "k.value")
    first = one.withColumn("n", F.row_number().over(Window.partitionBy("kind", "value").orderBy("at"))).where("n = 1")
    fresh = first.join(existing.select("kind", F.lower("value").alias("value")).distinct(), ["kind", "value"], "left_anti")
    expires = now + F.make_interval(days=F.lit(expires_days)) if expires_days else F.lit(None).cast("timestamp")
    new = fresh.select("kind", "value", F.lit(source).alias("source"), F.lit(severity).alias("severity"), expires.alias("expires_at"))
    counts = one.agg(F.count("*").alias("total")).join(new.agg(F.count("*").alias("imported"))).select("imported", (F.col("total") - F.col("imported")).alias("skipped"))
    return new, counts


def union_detections(*hits: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), hits)


# Suppressions


def apply_suppressions(hits: DataFrame, suppressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed with suppression_id). A suppression holds for its rule, for its asset or all, until it expires; one at most is credited, the oldest.

    Two left joins of the hits with the suppressions of their rule, general ones and those of their asset; the hits enter once.
    """
    entry = F.struct(F.col("created_at").alias("created"), F.col("id").cast("string").alias("id"), F.col("expires_at").alias("expires"))
    listed = suppressions.groupBy(F.col("rule_id").alias("_rule"), F.col("asset_id").alias("_asset")).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    general = listed.where(F.col("_asset").isNull()).select("_rule", F.col("_s").alias("_general"))
    own = listed.where(F.col("_asset").isNotNull()).select(F.col("_rule").alias("_rule2"), "_asset", F.col("_s").alias("_own"))
    both = hits.join(general, F.col("rule_id") == F.col("_rule"), "left").join(own, (F.col("rule_id") == F.col("_rule2")) & (F.col("asset_id") == F.col("_asset")), "left")
    valid = lambda c: F.get(F.filter(c, lambda s: s["expires"].isNull() | (F.col("ts") <= s["expires"])), 0)
    judged = both.withColumn("suppression_id", F.least(valid("_general"), valid("_own"))["id"]).drop("_rule", "_rule2", "_asset", "_general", "_own")
    return judged.where(F.col("suppression_id").isNull()).drop("suppression_id"), judged.where(F.col("suppression_id").isNotNull())


def match_counters(matched: DataFrame, key: str) -> DataFrame:
    """Hits and last hit of each suppression or indicator."""
    return matched.groupBy(key).agg(F.count("*").alias("hits"), F.max("ts").alias("last"))


def with_rule_title(df: DataFrame, rules: DataFrame) -> DataFrame:
    titles = rules.groupBy("rule_id").agg(F.first("title").alias("title"))
    own = F.when(F.col("rule_id") == "bruteforce:success", "Login after repeated failures").when(F.col("rule_id") == "ueba:first_seen", "Program first seen on this asset")
    return df.join(titles, "rule_id", "left").withColumn("title", F.coalesce("title", own, "rule_id"))


# Rule coverage and the labelled corpus


def attack_coverage(rules: DataFrame, tactics: Iterable[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells: tactic, technique, rules, has_data; all tactics in order with their totals; summary)."""
    has_data = F.col("class_uid").isNull() | F.col("class_uid").isin(*CLASS_SOURCES)
    pairs = rules.withColumn("has_data", has_data).select("rule_id", "has_data", F.explode("tactics").alias("tactic"), "techniques").select("rule_id", "has_data", "tactic", F.explode("techniques").alias("technique"))
    cells = pairs.groupBy("tactic", "technique").agg(F.count("*").alias("rules"), F.bool_or("has_data").alias("has_data"))
    order = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(t).alias("tactic")) for k, t in enumerate(tactics)]))
    every = rules.sparkSession.range(1).select(order.alias("t")).select("t.position", "t.tactic")
    totals = every.join(cells.groupBy("tactic").agg(F.count("*").alias("techniques"), F.sum("rules").alias("rules")), "tactic", "left").na.fill(0)
    summary = rules.agg(F.count("*").alias("total"), F.count_if(F.size("techniques") == 0).alias("untagged"), F.count_if(~has_data).alias("no_data"))
    return cells, totals, summary


def rule_load_report(rules: RuleSet | DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row: total, loaded, live, rate; rules per class; skip reasons with a sample) of a rule set or of what check_rules gives."""
    if isinstance(rules, RuleSet):
        loaded, skipped = rules.rules_df, rules.skipped_df
    else:
        loaded, skipped = rules.where("skip_reason is null"), rules.where("skip_reason is not null")
    live = F.col("class_uid").isNull() | F.col("class_uid").isin(*CLASS_SOURCES)
    counts = loaded.agg(F.count("*").alias("loaded"), F.count_if(live).alias("live"))
    one = counts.join(skipped.agg(F.count("*").alias("skipped"))).select((F.col("loaded") + F.col("skipped")).alias("total"), "loaded", "live", F.try_divide(F.col("loaded"), F.col("loaded") + F.col("skipped")).alias("rate"))
    return one, loaded.groupBy("class_uid").count(), skipped.groupBy("skip_reason").agg(F.count("*").alias("count"), F.min("name").alias("sample"))


def replay_corpus(cases: DataFrame, rules: RuleSet) -> DataFrame:
    """cases (name, case_name, technique, class_uid, os, event, expect) with detected and outcome: `detected`, `known_gap` or `mismatch`."""
    events = cases.withColumn("id", F.concat_ws("\x1f", "name", "case_name")).withColumn("ts", F.lit(None).cast("timestamp"))
    hits = match_rules(events, rules, keep=("technique",), raw="event", os="os").join(rules.rules_df.select("rule_id", "techniques"), "rule_id")
    detected = hits.where(F.exists("techniques", lambda t: technique_match(t, F.col("technique")))).select("id").distinct().withColumn("detected", F.lit(True))
    out = events.join(detected, "id", "left").withColumn("detected", F.coalesce("detected", F.lit(False)))
    wanted = F.col("expect") != "undetected"
    return out.withColumn("outcome", F.when(wanted & F.col("detected"), "detected").when(~wanted & ~F.col("detected"), "known_gap").otherwise("mismatch")).drop("id", "ts")


def corpus_report(results: DataFrame) -> DataFrame:
    found = F.col("outcome") == "detected"
    return results.agg(F.count_if(found).alias("detected"), F.count_if(F.col("outcome") == "known_gap").alias("known_gap"), F.count_if(F.col("outcome") == "mismatch").alias("mismatch"), F.count_distinct(F.when(found, F.col("technique"))).alias("covered"), F.count_distinct("technique").alias("techniques"))
