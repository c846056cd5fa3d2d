from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tracehold.functions.rule_index import RuleIndex
from tracehold.functions.rules import RuleRejected, compile_rule, match_value, parse_attack_tags
from tracehold.operators import detect
from tracehold.sources import readers

BASE = {"logsource": {"category": "process_creation"}}


def rule(detection, **more):
    return compile_rule({"id": "r", **BASE, **more, "detection": detection})


def hit_ids(spark, rules, bodies, os=None, class_uid=1007):
    rows = [(k, class_uid, json.dumps(b), os) for k, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "id long, class_uid int, raw string, os string").withColumn("ts", F.lit(None).cast("timestamp"))
    hits = sorted((r.id, r.rule_id) for r in detect.match_rules(df, rules, os="os").collect())
    assert hits == sorted((r.id, r.rule_id) for r in detect.match_rules(df, rules, os="os", few=0).collect())  # through the index
    return hits


def process(path="", cmd="", **more):
    return {"process": {"file": {"path": path}, "cmd_line": cmd, **more}}


def test_values_and_modifiers(spark):
    bodies = [process(r"C:\Windows\cmd.exe", "CMD /c Whoami"), process("/bin/sh", "sh -c id"), {"process": {"pid": 7}}, {}]
    cases = [
        ({"s": {"CommandLine|contains": "WHOAMI"}, "condition": "s"}, [0]),
        ({"s": {"Image|endswith": r"\CMD.exe"}, "condition": "s"}, [0]),
        ({"s": {"Image|startswith": "/bin"}, "condition": "s"}, [1]),
        ({"s": {"CommandLine|contains|all": ["c", "id"]}, "condition": "s"}, [1]),
        ({"s": {"CommandLine|contains": ["zzz", "whoami"]}, "condition": "s"}, [0]),
        ({"s": {"CommandLine": "sh -? i*"}, "condition": "s"}, [1]),
        ({"s": {"CommandLine|re": "^sh.*d$"}, "condition": "s"}, [1]),
        ({"s": {"ProcessId": 7}, "condition": "s"}, [2]),
        ({"s": {"process.pid": 7}, "condition": "s"}, [2]),
        ({"s": {"CommandLine": None}, "condition": "s"}, [2, 3]),
        ({"s": {"CommandLine|all": []}, "condition": "s"}, [0, 1, 2, 3]),
        ({"s": {"CommandLine": []}, "condition": "s"}, []),
        ({"s": {"CommandLine|contains": "sh"}, "condition": "not s"}, [0, 2, 3]),
        ({"a": {"Image|contains": "cmd"}, "b": {"CommandLine|contains": "id"}, "condition": "a or b"}, [0, 1]),
        ({"a": {"Image|contains": "cmd"}, "b": {"CommandLine|contains": "id"}, "condition": "not a and not b"}, [2, 3]),
        ({"a1": {"Image|contains": "sh"}, "a2": {"CommandLine|contains": "id"}, "condition": "all of a*"}, [1]),
        ({"a1": {"Image|contains": "sh"}, "a2": {"CommandLine|contains": "c"}, "condition": "1 of them"}, [0, 1]),
        ({"a1": {"Image|contains": "sh"}, "condition": "2 of them or nothing"}, []),
        ({"a": {"Image|contains": "sh"}, "condition": "any of b*"}, []),
        ({"a": [{"Image|contains": "sh"}, {"Image|contains": "cmd"}], "condition": "a"}, [0, 1]),
        ({"a": ["whoami", "nothing"], "condition": "a"}, [0]),
        ({"a": [{"Image|contains": "sh"}, "whoami"], "condition": "a"}, [0]),
        ({"a": {"process.file": "x"}, "condition": "a"}, []),
    ]
    for detection, want in cases:
        assert [k for k, _ in hit_ids(spark, [rule(detection)], bodies)] == want, detection


def test_letters_and_line_ends(spark):
    bodies = [process(cmd=c) for c in ("éire x", "abc\n", "abc", "a\rc", "a\nc", "ÀB")]
    cases = [("CommandLine", "ÉIRE*", [0]), ("CommandLine", "a?c", [2, 3]), ("CommandLine", "a*c", [2, 3]), ("CommandLine|re", "^abc$", [2]), ("CommandLine|re", "àb", [5]), ("CommandLine|re", r"a\sc", [3, 4]), ("CommandLine|contains", "Éi?e", [0]), ("CommandLine|endswith", "b*", [2, 5])]
    for name, value, want in cases:
        assert [k for k, _ in hit_ids(spark, [rule({"s": {name: value}, "condition": "s"})], bodies)] == want, value


def test_many_rules_parse_a_body_once(spark):
    rules = [rule({"s": {"Image|endswith": f"tool{k}", "CommandLine|contains": "x"}, "condition": "s"}, id=f"r{k}") for k in range(250)]
    df = spark.createDataFrame([(k, 1007, json.dumps(process(f"/bin/tool{k % 300}", "x"))) for k in range(600)], "id long, class_uid int, raw string").withColumn("ts", F.lit(None).cast("timestamp"))
    hits = detect.match_rules(df, rules)
    assert hits.count() == 500
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1 and plan.count("Union") == 0


def test_gates(spark):
    r = compile_rule({"id": "l", "logsource": {"product": "Linux"}, "detection": {"s": {"a": "b"}, "condition": "s"}})
    for os, want in (("linux", 1), ("WINDOWS", 0), (None, 1), ("", 1)):
        assert len(hit_ids(spark, [r], [{"a": "b"}], os)) == want
    assert hit_ids(spark, [rule({"s": {"a": "b"}, "condition": "s"})], [{"a": "b"}], class_uid=4001) == []


@pytest.mark.parametrize(
    "doc",
    [
        {"detection": {"s": {"a|cidr": "b"}, "condition": "s"}, **BASE},
        {"detection": {"s": {"a": "b"}, "condition": "s | count() > 3"}, **BASE},
        {"detection": {"s": {"a": "b"}}, **BASE},
        {"detection": {"s": {"a": "b"}, "condition": "s"}, "logsource": {"category": "unheard_of"}},
        {"detection": {"s": {"a": "b"}, "condition": "s"}, "logsource": {"product": "amiga"}},
        {"detection": {"s": {"a": "b"}, "condition": "s"}, "logsource": {}},
        {"detection": {"s": {"a": "b"}, "condition": "s"}},
        {"detection": {"s": {"a": "b"}, "condition": "(s"}, **BASE},
        {"detection": {"s": {"a": "b"}, "condition": "s s"}, **BASE},
        {"detection": {"s": {"a|re": "("}, "condition": "s"}, **BASE},
        {"detection": {"s": {"a|re": "a(?=b)"}, "condition": "s"}, **BASE},
        {"detection": {"s": {"a": "b"}, "condition": "0 of them"}, **BASE},
        {"detection": {"s": 5, "condition": "s"}, **BASE},
        {},
    ],
)
def test_rejected(doc):
    with pytest.raises(RuleRejected):
        compile_rule({"id": "x", **doc})
    with pytest.raises(RuleRejected):
        compile_rule({"logsource": BASE["logsource"], "detection": {"s": {"a": "b"}, "condition": "s"}})


def test_tags_and_severity():
    assert parse_attack_tags(["attack.T1059.001", "attack:t1003", "attack.lateral_movement", "attack.execution", "car.x", "attack.t1059.001"]) == (("execution", "lateral-movement"), ("T1003", "T1059.001"))
    assert rule({"s": {"a": "b"}, "condition": "s"}).severity == 3
    assert rule({"s": {"a": "b"}, "condition": "s"}, level="Critical").severity == 5


def test_folder_reload_and_report(spark, tmp_path):
    yml = "title: T\nid: {}\ntags: [attack.execution, attack.t1059]\nlogsource: {{category: process_creation}}\ndetection: {{s: {{Image|contains: sh}}, condition: s}}\n"
    (tmp_path / "a.yml").write_text(yml.format("one"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.yaml").write_text(yml.format("two"))
    (tmp_path / "bad.yml").write_text("title: x\ndetection: {s: {a|b64: c}, condition: s}\nlogsource: {category: dns}\n")
    (tmp_path / "note.txt").write_text("no rule")
    rules = readers.load_rules(spark, f"file://{tmp_path}")
    assert sorted(r.id for r in rules.rules) == ["one", "two"] and rules.skipped_df.count() == 1
    assert readers.reload_rules(spark, f"file://{tmp_path}", rules) is rules
    (tmp_path / "a.yml").write_text(yml.format("three"))
    assert sorted(r.id for r in readers.reload_rules(spark, f"file://{tmp_path}", rules).rules) == ["three", "two"]
    one, per_class, reasons = detect.rule_load_report(rules)
    assert tuple(one.head()) == (3, 2, 2, pytest.approx(2 / 3)) and per_class.count() == 1 and reasons.count() == 1
    cells, totals, summary = detect.attack_coverage(rules.rules_df, ["reconnaissance", "execution"])
    assert [tuple(r) for r in cells.collect()] == [("execution", "T1059", 2, True)]
    assert totals.count() == 2 and tuple(summary.head()) == (2, 0, 0)


def test_corpus(spark, tmp_path):
    (tmp_path / "c.yml").write_text("""
name: shell
technique: T1059
class_uid: 1007
cases:
  - {name: hit, event: {process: {file: {path: /bin/sh}}}}
  - {name: other, technique: T1003, event: {process: {file: {path: /bin/sh}}}}
  - {name: gap, event: {process: {file: {path: /bin/ls}}}, expect: undetected}
  - {name: sub, technique: T1059.004, event: {process: {file: {path: /bin/sh}}}}
""")
    cases = readers.read_corpus(spark, f"file://{tmp_path}")
    rules = detect.rule_set(spark, [("r", {"id": "r", "tags": ["attack.t1059"], **BASE, "detection": {"s": {"Image|endswith": "/sh"}, "condition": "s"}})])
    results = detect.replay_corpus(cases, rules)
    assert {r.case_name: r.outcome for r in results.collect()} == {"hit": "detected", "other": "mismatch", "gap": "known_gap", "sub": "detected"}
    assert tuple(detect.corpus_report(results).head()) == (2, 1, 1, 2, 3)


def test_index_lets_all_hits_through(spark):
    """Random rules over a few words, letters that patterns and lower() treat differently among them, tried one by one and through the index."""
    rng = random.Random(1)
    parts = ["cmd", "CMD.exe", " /c ", "ſtar", "star", "Kit", "\u212ait", "İnk", "ink", "ınk", "-a", "x", "ΣΑΣ", "abc", "b.c"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))

    def test():
        field = rng.choice(("Image", "CommandLine"))
        how = rng.choice(("", "|contains", "|startswith", "|endswith", "|contains|all", "|re", "wild"))
        one = lambda: rng.choice(("^", "")) + re.escape(rng.choice(parts)) + rng.choice((".*", "[a-z]?", "(?:star)?", "", "$"))
        if how == "|re":
            return {field + how: one()}
        if how == "wild":
            return {field: rng.choice(("*", "")) + text() + rng.choice(("*", "?", ""))}
        return {field + how: None if how == "" and rng.random() < 0.1 else [rng.choice(parts) if rng.random() < 0.7 else text() for _ in range(rng.randint(0, 3))]}

    def one_rule(k):
        detection = {f"s{j}": {**test(), **(test() if rng.random() < 0.3 else {})} if rng.random() < 0.85 else [rng.choice(parts)] for j in range(rng.randint(1, 4))}
        detection["condition"] = rng.choice(("all of s*", "1 of s*", "2 of s*", "s0", "not s0", "s0 and not s1", "s0 or (s1 and not s2)"))
        return compile_rule({"id": f"r{k}", "detection": detection, "logsource": {"category": "process_creation", **({"product": "linux"} if rng.random() < 0.2 else {})}})

    rules = [one_rule(k) for k in range(150)]
    bodies = [process(text(), text()) if rng.random() < 0.9 else {"process": {"cmd_line": ""}} for _ in range(120)]
    assert len(hit_ids(spark, rules, bodies, os="windows")) > 1000


def test_index_passes_deep_rules_on():
    deep = rule({**{f"s{k}": {"Image|contains": f"abc{k}"} for k in range(70)}, "condition": "1 of s*"})
    flat = rule({"s": {"Image|contains": [f"abc{k}" for k in range(500)]}, "condition": "s"})
    index = RuleIndex([deep, flat], {"process.file.path": 0})
    assert index.left == [deep] and len(index.listed) == 1 and not index.open
    assert 400 < sum(map(len, index.slots)) <= 500  # some of the 500 go by one gram


def test_required_literals_of_patterns():
    found = lambda p: match_value(p, {"re"}).literals
    assert found(r"job 14 as u[0-9]$") == ("job 14 as u",)
    assert found(r"a(bc)+d|x") == () and found(r"foo(?:bar)?Baz") == ("foo", "baz") and found(r"\bPower\.Shell\b.{3}X{2,}") == ("power.shell", "x")
