"""Detection rules in the Sigma format, compiled to boolean columns.

`compile_rule` turns the text of one rule into a `Rule`, whose predicate is a tree of nodes that, called with a `Body` (how fields of
an event are read), gives a Column; Catalyst does the rest. A rule that can't be honoured exactly raises `RuleRejected`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # rules can still be given as dictionaries
    yaml = None

# Rule field names and the places in an event body that they stand for.
FIELD_PATHS = {
    "image": "process.file.path",
    "originalfilename": "process.file.name",
    "commandline": "process.cmd_line",
    "currentdirectory": "process.working_directory",
    "processid": "process.pid",
    "parentimage": "process.parent_process.file.path",
    "parentcommandline": "process.parent_process.cmd_line",
    "parentprocessid": "process.parent_process.pid",
    "integritylevel": "process.integrity",
    "user": "actor.user.name",
    "username": "actor.user.name",
    "targetusername": "user.name",
    "logonid": "actor.session.uid",
    "targetfilename": "file.path",
    "filename": "file.path",
    "imageloaded": "module.file.path",
    "hashes": "file.hashes",
    "md5": "file.md5",
    "sha256": "file.sha256",
    "destinationip": "dst_endpoint.ip",
    "destinationport": "dst_endpoint.port",
    "destinationhostname": "dst_endpoint.hostname",
    "sourceip": "src_endpoint.ip",
    "sourceport": "src_endpoint.port",
    "initiated": "connection_info.direction",
    "protocol": "connection_info.protocol_name",
    "query": "query.hostname",
    "queryname": "query.hostname",
    "c-uri": "http_request.url.path",
    "cs-uri-stem": "http_request.url.path",
    "c-useragent": "http_request.user_agent",
    "useragent": "http_request.user_agent",
    "c-host": "http_request.hostname",
    "ja3": "tls.ja3_hash",
    "targetobject": "reg_key.path",
    "details": "reg_value.data",
}
# Rule categories and the event classes they speak of.
CATEGORY_CLASSES = {
    "process_creation": 1007,
    "process_access": 1007,
    "process_tampering": 1007,
    "create_remote_thread": 1007,
    "file_event": 1001,
    "file_change": 1001,
    "file_delete": 1001,
    "file_access": 1001,
    "file_rename": 1001,
    "create_stream_hash": 1001,
    "image_load": 1005,
    "driver_load": 1005,
    "registry_set": 201002,
    "registry_add": 201002,
    "registry_event": 201002,
    "registry_delete": 201002,
    "network_connection": 4001,
    "dns_query": 4003,
    "dns": 4003,
    "proxy": 4002,
    "webserver": 4002,
    "authentication": 3002,
    "application": 100001,
    "antivirus": 100001,
}
# Classes that a source of events exists for.
CLASS_SOURCES = {1001: "file activity", 1005: "module load", 1007: "process activity", 3002: "authentication", 201002: "registry change", 4001: "network activity", 4003: "dns activity", 100001: "application log"}
# Severities of levels, products, modifiers, tactics in the order of an attack.
LEVELS = {"informational": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}
PRODUCTS = frozenset({"windows", "linux", "macos"})
MODIFIERS = frozenset({"contains", "startswith", "endswith", "re", "all"})
TACTICS = (
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion",
    "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
)
_STATISTICS = re.compile(r"\|\s*(count|min|max|avg|sum|near)\b")
#: Constructs that Java's regular expressions read otherwise than the format's dialect, or that it doesn't have.
_DIALECT = re.compile(r"\\z|\\Z|\\C|\\[1-9]|\[\[:|\(\?P<|\(\?[=!>]|\(\?<[=!]|[*+?}]\+")
#: Letters of all alphabets match in either case, and only \n ends a line.
_FLAGS = "(?iud)"


class RuleRejected(ValueError):
    """The rule can't be honoured; the message says why."""


class Body:
    """Reads fields of an event: `fields` are typed columns by path, everything else comes from the JSON in `raw`."""

    def __init__(self, raw: Column | None = None, fields: dict[str, Column] | None = None):
        self.variant = F.try_parse_json(raw) if raw is not None else None
        self.raw, self.fields = raw, fields or {}

    def text(self, path: str) -> Column:
        """The value as text; null if it is absent, null, an object or an array."""
        if path in self.fields:
            return self.fields[path].cast("string")
        return F.lit(None).cast("string") if self.variant is None else scalar_at(self.variant, path)

    def flat(self) -> Column:
        """All scalar values, lower-cased and joined by line ends; keys don't take part."""
        values = [c.cast("string") for c in self.fields.values()]
        if self.raw is not None:
            values.append(flatten_scalars(self.raw))
        return F.lower(F.concat_ws("\n", *values))


def scalar_at(variant: Column, path: str) -> Column:
    at = "$" + "".join("['{}']".format(p.replace("'", "\\'")) for p in path.split("."))
    found = F.try_variant_get(variant, at, "variant")
    nested = F.schema_of_variant(found).rlike("^(OBJECT|ARRAY)")
    return F.when(~nested, F.try_variant_get(variant, at, "string"))


def flatten_scalars(raw: Column) -> Column:
    """The scalar values of a JSON text, joined by line ends: strings unescaped, and numbers and booleans that stand as values."""
    string = r'"(?:[^"\\]|\\.)*"'
    strings = F.regexp_extract_all(raw, F.lit(f"({string})(\\s*:)?"), F.lit(0))
    values = F.filter(strings, lambda s: ~s.rlike(r":\s*$"))
    plain = F.transform(values, lambda s: F.coalesce(F.try_variant_get(F.try_parse_json(s), "$", "string"), s))
    bare = F.regexp_extract_all(F.regexp_replace(raw, string, '""'), F.lit(r"(?:[:\[,]\s*)(-?[0-9][0-9.eE+-]*|true|false)"), F.lit(1))
    return F.array_join(F.concat(plain, bare), "\n")


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    severity: int
    class_uid: int | None
    product: str | None
    tactics: tuple[str, ...]
    techniques: tuple[str, ...]
    predicate: Node = field(compare=False)
    text: str = ""


# Values


def _go_text(value: Any) -> str:
    return "true" if value is True else "false" if value is False else str(value)


def _portable(pattern: str) -> str:
    """The pattern with `$` as the very end of the text (Java's also stands before a last line end) and `\\s` without the vertical tab; in multi-line mode `$` stays."""
    if re.search(r"\(\?[a-z]*m", pattern):
        return pattern
    out, inside, at = [], False, 0
    while at < len(pattern):
        ch = pattern[at]
        pair = pattern[at : at + 2]
        if ch == "\\":
            out.append((r"\t\n\f\r " if inside else r"[\t\n\f\r ]") if pair == r"\s" else r"[^\t\n\f\r ]" if pair == r"\S" and not inside else pair)
            at += 2
            continue
        inside = ch == "[" or (inside and ch != "]")
        out.append(r"\z" if ch == "$" and not inside else ch)
        at += 1
    return "".join(out)


#: Where a pattern with wildcards is tied down, by modifier; without one at both ends.
_ANCHORS = {"contains": ("", ""), "startswith": (r"\A", ""), "endswith": ("", r"\z")}
_WILDCARDS = {"*": r"[^\n]*", "?": r"[^\n]"}
_LITERALS = {"contains": lambda c, v: c.contains(v), "startswith": lambda c, v: c.startswith(v), "endswith": lambda c, v: c.endswith(v)}


@dataclass(frozen=True)
class Value:
    """One value of a field test: how it is compared, and with which lower-cased literal or pattern; called with the field's text it gives a boolean."""

    kind: str  # equals, contains, startswith, endswith or re
    text: str
    literals: tuple[str, ...] = ()  # parts that are in any text that matches, of letters that a pattern treats like lower()

    def __call__(self, c: Column) -> Column:
        return c.rlike(self.text) if self.kind == "re" else _LITERALS.get(self.kind, lambda c, v: c == v)(F.lower(c), self.text)


def _required(sequence: Any) -> list[str]:
    """Texts of ASCII letters that stand in whatever a parsed pattern matches, lower-cased; alternatives and what may be left out give none."""
    out, run = [], []
    for op, arg in sequence:
        name = str(op)
        if name == "LITERAL" and 32 <= arg < 127:
            run.append(chr(arg).lower())
            continue
        if run:
            out.append("".join(run))
            run = []
        if name == "SUBPATTERN":
            out += _required(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            out += _required(arg[2])
    return [*out, "".join(run)] if run else out


def match_value(value: str, modifiers: set[str]) -> Value:
    """One value of a field test; letters match in either case."""
    if "re" in modifiers:
        if _DIALECT.search(value):
            raise RuleRejected(f"regular expression not portable: {value}")
        try:
            re.compile(value)
        except re.error as e:
            raise RuleRejected(f"regular expression: {e}") from None
        return Value("re", _FLAGS + _portable(value), tuple(_required(re._parser.parse(value))))
    place = next((m for m in _ANCHORS if m in modifiers), None)
    if any(ch in _WILDCARDS for ch in value):
        head, tail = _ANCHORS.get(place, (r"\A", r"\z"))
        pattern = _FLAGS + head + "".join(_WILDCARDS.get(ch) or re.escape(ch) for ch in value) + tail
        return Value("re", pattern, tuple(p.lower() for p in re.findall(r"[\x00-\x29\x2B-\x3E\x40-\x7F]+", value)))
    return Value(place or "equals", value.lower(), (value.lower(),))


# What a rule asks, as a tree of nodes. A node called with a body gives a column; detect.match_rules also reads the tree itself.


@dataclass(frozen=True)
class Test:
    """Values of a field (path None: of the whole body), any or all of them."""

    path: str | None
    values: tuple[Value, ...]
    every: bool = False

    def __call__(self, body: Body) -> Column:
        out = F.lit(self.every)
        text = body.flat() if self.path is None else body.text(self.path)
        for value in self.values:
            hit = F.coalesce(value(text), F.lit(False))
            out = out & hit if self.every else out | hit
        return out


@dataclass(frozen=True)
class Absent:
    path: str

    def __call__(self, body: Body) -> Column:
        return body.text(self.path).isNull()


@dataclass(frozen=True)
class Not:
    part: Node

    def __call__(self, body: Body) -> Column:
        return ~self.part(body)


@dataclass(frozen=True)
class AtLeast:
    """So many of the parts: all of none is true, one of none false."""

    least: int
    parts: tuple[Node, ...]

    def __call__(self, body: Body) -> Column:
        if self.least == len(self.parts):
            return reduce(lambda a, b: a & b, [p(body) for p in self.parts], F.lit(True))
        if self.least == 1:
            return reduce(lambda a, b: a | b, [p(body) for p in self.parts], F.lit(False))
        return reduce(lambda a, b: a + b, [p(body).cast("int") for p in self.parts], F.lit(0)) >= self.least


Node = Test | Absent | Not | AtLeast


def paths_of(node: Node) -> set[str | None]:
    """The paths that a node reads; None stands for the whole body."""
    if isinstance(node, Not):
        return paths_of(node.part)
    if isinstance(node, AtLeast):
        return set().union(*map(paths_of, node.parts))
    return {node.path}


def _test(key: str, value: Any) -> Node:
    name, *mods = key.split("|")
    modifiers = {m.lower() for m in mods}
    if unknown := modifiers - MODIFIERS:
        raise RuleRejected(f"unknown modifier: {sorted(unknown)[0]}")
    path = FIELD_PATHS.get(name.lower(), name)
    if value is None:
        return Absent(path)
    return Test(path, tuple(match_value(_go_text(v), modifiers) for v in (value if isinstance(value, list) else [value])), "all" in modifiers)


def _all_of(parts: list[Node]) -> Node:
    return AtLeast(len(parts), tuple(parts))


def _any_of(parts: list[Node]) -> Node:
    return AtLeast(1, tuple(parts))


def _selection(value: Any) -> Node:
    """A map is a conjunction of field tests, a list of maps a disjunction; plain values are looked for in the whole body, and then maps beside them don't count."""
    if isinstance(value, dict):
        return _all_of([_test(k, v) for k, v in value.items()])
    if isinstance(value, list | str):
        items = value if isinstance(value, list) else [value]
        branches = [_all_of([_test(k, v) for k, v in x.items()]) for x in items if isinstance(x, dict)]
        keywords = tuple(match_value(_go_text(x), {"contains"}) for x in items if not isinstance(x, dict))
        return Test(None, keywords) if keywords else _any_of(branches)
    raise RuleRejected(f"selection of type {type(value).__name__}")


# Conditions: not binds closer than and, and than or.


class _Condition:
    def __init__(self, text: str, selections: dict[str, Node]):
        self.tokens, self.at, self.selections = re.findall(r"[()]|[^\s()]+", text), 0, selections

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise RuleRejected("condition ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Node:
        out = self.either()
        if self.peek() is not None:
            raise RuleRejected(f"condition goes on after its end: {self.peek()}")
        return out

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek() == "or":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else _any_of(parts)

    def both(self) -> Node:
        parts = [self.negated()]
        while self.peek() == "and":
            self.take()
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else _all_of(parts)

    def negated(self) -> Node:
        if self.peek() == "not":
            self.take()
            return Not(self.negated())
        return self.single()

    def single(self) -> Node:
        token = self.take()
        if token == "(":
            out = self.either()
            if self.peek() != ")":
                raise RuleRejected("missing )")
            self.take()
            return out
        if token == ")":
            raise RuleRejected("unexpected )")
        if self.peek() == "of" and (token in ("all", "any") or (token.isdigit() and int(token) > 0)):
            self.take()
            return self.quantified(token, self.take())
        return self.selections.get(token, _any_of([]))

    def quantified(self, how: str, target: str) -> Node:
        chosen = [p for name, p in self.selections.items() if target == "them" or (target.endswith("*") and name.startswith(target[:-1])) or name == target]
        return AtLeast(max(len(chosen), 1) if how == "all" else 1 if how == "any" else int(how), tuple(chosen))


def parse_attack_tags(tags: Any) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(tactics, techniques) of `attack.` or `attack:` tags, sorted and distinct."""
    tactics, techniques = set(), set()
    for tag in tags if isinstance(tags, list) else []:
        low = str(tag).strip().lower()
        if not low.startswith(("attack.", "attack:")):
            continue
        name = low[7:]
        if re.fullmatch(r"t[0-9]{4}(\.[0-9]{3})?", name):
            techniques.add(name.upper())
        elif name.replace("_", "-") in TACTICS:
            tactics.add(name.replace("_", "-"))
    return tuple(sorted(tactics)), tuple(sorted(techniques))


def compile_rule(source: str | dict) -> Rule:
    """The rule of a YAML text or a dictionary."""
    if isinstance(source, str):
        if yaml is None:
            raise RuleRejected("no YAML reader is installed; give the rule as a dictionary")
        try:
            doc = yaml.safe_load(source)
        except yaml.YAMLError as e:
            raise RuleRejected(f"not YAML: {str(e).splitlines()[0]}") from None
    else:
        doc = source
    if not isinstance(doc, dict) or not isinstance(doc.get("detection"), dict):
        raise RuleRejected("no detection")
    detection = doc["detection"]
    condition = detection.get("condition")
    if not isinstance(condition, str):
        raise RuleRejected("no condition")
    if _STATISTICS.search(condition):
        raise RuleRejected("statistics over several events are not supported")
    selections = {}
    for name in sorted(k for k in detection if k != "condition"):
        selections[name] = _selection(detection[name])
    predicate = _Condition(condition, selections).whole()
    title = doc.get("title") if isinstance(doc.get("title"), str) else ""
    rule_id = doc.get("id") if isinstance(doc.get("id"), str) else ""
    if not (rule_id or title):
        raise RuleRejected("neither id nor title")
    origin = doc.get("logsource")
    if not isinstance(origin, dict):
        raise RuleRejected("no logsource")
    class_uid = product = None
    if isinstance(origin.get("category"), str):
        class_uid = CATEGORY_CLASSES.get(origin["category"].lower())
        if class_uid is None:
            raise RuleRejected(f"no source for category {origin['category']}")
    if isinstance(origin.get("product"), str):
        product = origin["product"].lower()
        if product not in PRODUCTS:
            raise RuleRejected(f"no source for product {product}")
    if class_uid is None and product is None:
        raise RuleRejected("logsource names neither category nor product")
    level = doc.get("level")
    tactics, techniques = parse_attack_tags(doc.get("tags"))
    severity = LEVELS.get(level.lower(), 3) if isinstance(level, str) else 3
    return Rule(rule_id or title, title or rule_id, severity, class_uid, product, tactics, techniques, predicate, source if isinstance(source, str) else "")
