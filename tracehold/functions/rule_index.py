"""Many rules as data: an index of the literals that events must have, and programs for the rules that it lets through.

A plan that holds each rule as an expression takes longer to compile than to run, and tries every rule on every event.
Here rules are two constant tables, so the plan is the same for ten rules and for ten thousand:

* `gates`: for each rule, literals of which an event that hits must have one at least. A whole value is looked up by
  its checksum, a part of one by that of GRAM of its characters; what stands in a slot of the table are rule numbers. Rules
  without such literals (only negations, short parts or regular expressions) are candidates of every event of their class.
* `program`: a rule's tests in postfix order. Candidates run them on a stack of bits, and a test whose result can't change
  its list's any more is not made.

Gates compare folded text: lower case, with the four letters that a pattern takes for ASCII ones replaced by these.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Absent, AtLeast, Node, Not, Rule, Test

GRAM = 3
DEPTH = 60  # bits of the stack; rules that need more are compiled as expressions
#: Codes of the tests, in the order of the expression below.
TESTS = {"equals": 0, "contains": 1, "startswith": 2, "endswith": 3, "re": 4}
ABSENT, ANY, EVERY, PUSH, NOT, GATHER = 5, 10, 20, 40, 41, 42

_FOLD_FROM, _FOLD_TO = "ſıK̇", "sik"  # long s, dotless i, the Kelvin sign; the dot of a lower-cased I with a dot goes


def folded(text: str) -> str:
    return text.translate(str.maketrans({a: (_FOLD_TO[k] if k < len(_FOLD_TO) else None) for k, a in enumerate(_FOLD_FROM)}))


@dataclass(frozen=True)
class Gate:
    """A whole value, or GRAM characters of one, of the field with that number."""

    path: int
    text: str
    whole: bool

    def key(self) -> str:
        return f"{'=' if self.whole else '*'}{self.path}:{self.text}"


def _choices(test: Test, paths: dict[str | None, int]) -> list[list[Gate]]:
    """For each value the gates that it could go by."""
    out = []
    for v in test.values:
        texts = [folded(p) for p in v.literals]
        if v.kind == "equals":
            out.append([Gate(paths[test.path], t, True) for t in texts])
        else:
            out.append([Gate(paths[test.path], t[k : k + GRAM], False) for t in texts for k in range(len(t) - GRAM + 1)])
    return out


def _tests(node: Node) -> list[Test]:
    if isinstance(node, Not):
        return _tests(node.part)
    if isinstance(node, AtLeast):
        return [t for p in node.parts for t in _tests(p)]
    return [node] if isinstance(node, Test) else []


def program(node: Node, paths: dict[str | None, int]) -> tuple[list[dict], int]:
    """(steps, bits of stack that they need)."""
    if isinstance(node, Test):
        base = EVERY if node.every else ANY
        steps = [{"o": base + TESTS[v.kind], "p": paths[node.path], "v": v.text} for v in node.values]
        return [{"o": PUSH, "p": int(node.every)}, *steps], 1
    if isinstance(node, Absent):
        return [{"o": PUSH, "p": 0}, {"o": ANY + ABSENT, "p": paths[node.path]}], 1
    if isinstance(node, Not):
        steps, need = program(node.part, paths)
        return [*steps, {"o": NOT}], need
    steps, need = [], 1
    for k, part in enumerate(node.parts):
        own, depth = program(part, paths)
        steps += own
        need = max(need, k + depth)
    return [*steps, {"o": GATHER, "p": len(node.parts), "n": node.least}], need


def gates(node: Node, paths: dict[str | None, int], shared: Counter) -> list[Gate] | None:
    """Gates of which any event that hits has one; None if there is no such list. Of several lists the one whose gates the fewest rules share."""
    cost = lambda found: sum(shared[g] for g in found)

    def best(lists: list[list[Gate] | None]) -> list[Gate] | None:
        known = [x for x in lists if x is not None]
        return min(known, key=cost) if known else None

    def union(lists: list[list[Gate] | None]) -> list[Gate] | None:
        return None if any(x is None for x in lists) else [g for x in lists for g in x]

    if isinstance(node, Test):
        of_values = [[min(c, key=lambda g: (shared[g], g.text))] if c else None for c in _choices(node, paths)]
        return best(of_values) if node.every else union(of_values)
    if isinstance(node, AtLeast) and node.least > 0:
        of_parts = [gates(p, paths, shared) for p in node.parts]
        if node.least == len(node.parts):
            return best(of_parts)
        # Of any so many parts that can't all miss.
        known = sorted((g for g in of_parts if g is not None), key=cost)
        need = len(node.parts) - node.least + 1
        return union(known[:need]) if len(known) >= need else None
    return None


def _constant(value: object, schema: str) -> Column:
    """A table as one constant: the optimizer folds it before anything runs."""
    return F.from_json(F.lit(json.dumps(value)), schema, {"mode": "FAILFAST"})


class RuleIndex:
    """Rules over texts by path; `paths` numbers the paths, None (the whole body) too if a rule asks for it."""

    def __init__(self, rules: list[Rule], paths: dict[str | None, int]):
        self.paths, self.left = paths, []
        self.listed, found = [], []
        shared = Counter(g for r in rules for g in {g for t in _tests(r.predicate) for c in _choices(t, paths) for g in c})
        for r in rules:
            steps, need = program(r.predicate, paths)
            if need > DEPTH:
                self.left.append(r)
                continue
            self.listed.append({"i": r.id, "s": r.severity, "c": r.class_uid, "o": r.product, "t": steps})
            found.append(gates(r.predicate, paths, shared))
        self.open = [k for k, g in enumerate(found) if g is None]
        size = 16
        while size < 4 * sum(len(g) for g in found if g):
            size *= 2
        slots: list[set[int]] = [set() for _ in range(size)]
        self.whole_paths, self.gram_paths = set(), set()
        for k, own in enumerate(found):
            for g in own or []:
                (self.whole_paths if g.whole else self.gram_paths).add(g.path)
                slots[zlib.crc32(g.key().encode()) % size].add(k)
        self.slots = [sorted(s) for s in slots]

    def candidates(self, low: Column) -> Column:
        """Numbers of the rules that may hit; low: array of lower-cased texts by path number."""
        slots = _constant(self.slots, "array<array<int>>")
        fold = lambda c: F.translate(c, _FOLD_FROM, _FOLD_TO)
        of_key = lambda key: F.coalesce(F.get(slots, (F.crc32(key) % len(self.slots)).cast("int")), F.array().cast("array<int>"))
        lists = [F.array(*[F.lit(k) for k in self.open]).cast("array<int>")] if self.open else []
        for p in sorted(self.whole_paths):
            lists.append(of_key(F.concat(F.lit(f"={p}:"), fold(F.coalesce(F.get(low, F.lit(p)), F.lit("\0")))).cast("binary")))
        lists += [self._of_grams(fold(F.coalesce(F.get(low, F.lit(p)), F.lit(""))), p, of_key) for p in sorted(self.gram_paths)]
        if not lists:
            return F.array().cast("array<int>")
        return F.array_distinct(F.concat(*lists) if len(lists) > 1 else lists[0])

    def _of_grams(self, text: Column, path: int, of_key: Callable[[Column], Column]) -> Column:
        places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
        parts = F.array_distinct(F.transform(places, lambda k: F.substring(text, k, F.lit(GRAM))))
        return F.flatten(F.transform(parts, lambda g: of_key(F.concat(F.lit(f"*{path}:"), g).cast("binary"))))

    def hits(self, candidates: Column, text: Column, low: Column, in_scope: Callable[[Column, Column], Column]) -> Column:
        """array<struct<rule_id, severity>> of the candidates that hit. text, low: arrays of texts by path number; in_scope: (class, product) of a rule to a boolean."""
        table = _constant(self.listed, "array<struct<i:string,s:int,c:int,o:string,t:array<struct<o:int,p:int,v:string,n:int>>>>")
        one = F.lit(1).cast("long")

        def step(s: Column, t: Column) -> Column:
            code, at, value, lower = t["o"], t["p"], t["v"], F.get(low, t["p"])
            kind = code % 10
            tests = (lower == value, F.contains(lower, value), F.startswith(lower, value), F.endswith(lower, value), F.regexp(F.get(text, at), value))
            hit = F.get(text, at).isNull()
            for k, test in reversed(list(enumerate(tests))):
                hit = F.when(kind == k, test).otherwise(hit)
            hit, top = F.coalesce(hit, F.lit(False)), s.bitwiseAND(one) == 1
            bits = F.bit_count(s.bitwiseAND(F.call_function("shiftleft", one, at) - 1))
            gathered = F.shiftleft(F.call_function("shiftright", s, at), 1).bitwiseOR((bits >= t["n"]).cast("long"))
            return (
                F.when(code < EVERY, F.when(top, s).when(hit, s.bitwiseOR(one)).otherwise(s))
                .when(code < PUSH, F.when(~top, s).when(hit, s).otherwise(s - 1))
                .when(code == PUSH, F.shiftleft(s, 1).bitwiseOR(at.cast("long")))
                .when(code == NOT, s.bitwiseXOR(one))
                .otherwise(gathered)
            )

        runs = lambda r: F.aggregate(r["t"], F.lit(0).cast("long"), step).bitwiseAND(one) == 1
        chosen = F.transform(candidates, lambda k: F.get(table, k))
        return F.transform(F.filter(chosen, lambda r: in_scope(r["c"], r["o"]) & runs(r)), lambda r: F.struct(r["i"].alias("rule_id"), r["s"].alias("severity")))
