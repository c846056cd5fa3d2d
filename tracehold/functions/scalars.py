"""Scalar functions: plain Columns, no Python at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
IPV6 = r"^(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?![0-9A-Fa-f:]*::[0-9A-Fa-f:]*::)(?!(?:[0-9A-Fa-f]{1,4}:+){8})[0-9A-Fa-f]{0,4}(:{1,2}[0-9A-Fa-f]{1,4})*:{0,2})(%.+)?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(_c(c), F.lit(""))


def os_lower(c: Column | str) -> Column:
    return F.lower(empty_to_null(c))


def stable_id(*parts: Column | str) -> Column:
    """A UUID fixed by its parts: SHA-256 over the parts, each followed by a zero byte, its first 16 bytes with version 8 and the variant bits."""
    data = F.concat(*[F.concat(F.coalesce(_c(p).cast("string"), F.lit("")), F.char(F.lit(0))) for p in parts])
    h = F.substring(F.sha2(data, 256), 1, 32)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def conn_tuple(proto: Column, src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    """`proto:src:sport>dst:dport`; protocol 6 is tcp, any other udp."""
    return F.format_string("%s:%s:%d>%s:%d", F.when(proto == 6, "tcp").otherwise("udp"), src, sport, dst, dport)


def parse_conn_tuple(c: Column | str) -> Column:
    pattern = r"^([a-z]+):(.*):([0-9]+)>(.*):([0-9]+)$"
    part = lambda k: empty_to_null(F.regexp_extract(_c(c), pattern, k))
    return F.struct(part(1).alias("proto"), part(2).alias("src_ip"), part(3).cast("int").alias("src_port"), part(4).alias("dst_ip"), part(5).cast("int").alias("dst_port"))


def ioc_kind(c: Column | str) -> Column:
    """struct<kind, value>: an IP address in its one spelling, a hash of 32, 40 or 64 hex digits, else a domain without one trailing dot; values in lower case."""
    v = F.trim(_c(c))
    kind = F.when(v.rlike(IPV4) | v.rlike(IPV6), "ip").when(v.rlike("^([0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"), "hash").otherwise("domain")
    return F.struct(kind.alias("kind"), F.when(kind == "domain", F.lower(F.regexp_replace(v, r"\.$", ""))).when(kind == "ip", ip_text(v)).otherwise(F.lower(v)).alias("value"))


def parent_domains(c: Column | str) -> Column:
    """The name and all its parents, longest first."""
    parts = F.split(F.lower(F.regexp_replace(_c(c), r"\.$", "")), r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def syslog_severity(c: Column) -> Column:
    """Severity 1 to 5 of syslog's 0 to 7; 3 outside."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in (5, 5, 5, 4, 3, 2, 2, 1)]), c), F.lit(3))


def parse_syslog(line: Column | str, now: Column) -> Column:
    """struct<ts, facility, severity, hostname, app, procid, msgid, content> of one line in the 5424 or 3164 form, or free form."""
    line = F.regexp_replace(_c(line), r"[\r\n]+$", "")
    pri = r"(?s)^<([0-9]{1,3})>(.*)$"
    has = line.rlike(pri)
    number = F.regexp_extract(line, pri, 1).try_cast("int")
    rest = F.when(has, F.regexp_extract(line, pri, 2)).otherwise(line)
    facility = F.when(has, F.floor(number / 8).cast("int")).otherwise(1)
    severity = F.when(has, number % 8).otherwise(6)
    modern = rest.rlike(r"(?s)^1 ([^ ]+ ){5}")
    parts = F.split(rest, " ", 7)
    dash = lambda x: F.when((x != "-") & (x != ""), x)
    body = F.regexp_replace(F.coalesce(F.get(parts, F.lit(6)), F.lit("")), r"^- ?", "")
    body = F.regexp_replace(body, r"(?s)^\[.*?\] ", "")
    old = r"(?s)^([A-Z][a-z]{2}) +([0-9]{1,2}) ([0-9]{2}:[0-9]{2}:[0-9]{2}) ([^ ]+) (.*)$"
    is_old = rest.rlike(old)
    stamp = lambda year: F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), F.regexp_extract(rest, old, 1), F.lpad(F.regexp_extract(rest, old, 2), 2, "0"), F.regexp_extract(rest, old, 3)), F.lit("yyyy MMM dd HH:mm:ss"))
    this_year = stamp(F.year(now))
    old_ts = F.when(this_year > now + F.expr("interval 24 hours"), stamp(F.year(now) - 1)).otherwise(this_year)
    message = F.regexp_extract(rest, old, 5)
    tag = r"(?s)^([^\s:\[\]]+)(?:\[([^\]]*)\])?: ?(.*)$"
    tagged = message.rlike(tag)
    return F.struct(
        F.coalesce(F.when(modern, F.try_to_timestamp(F.get(parts, F.lit(1)))).when(is_old, old_ts), now).alias("ts"),
        facility.cast("int").alias("facility"),
        severity.cast("int").alias("severity"),
        F.when(modern, dash(F.get(parts, F.lit(2)))).when(is_old, F.regexp_extract(rest, old, 4)).alias("hostname"),
        F.when(modern, dash(F.get(parts, F.lit(3)))).when(is_old & tagged, F.regexp_extract(message, tag, 1)).alias("app"),
        F.when(modern, dash(F.get(parts, F.lit(4)))).when(is_old & tagged, empty_to_null(F.regexp_extract(message, tag, 2))).alias("procid"),
        F.when(modern, dash(F.get(parts, F.lit(5)))).alias("msgid"),
        F.when(modern, body).when(is_old & tagged, F.regexp_extract(message, tag, 3)).when(is_old, message).otherwise(rest).alias("content"),
    )


def strip_nul(raw: Column | str) -> Column:
    """JSON text without U+0000 in strings; `{}` if it is no JSON."""
    clean = F.regexp_replace(F.translate(_c(raw), "\x00", ""), r"(?<!\\)((?:\\\\)*)\\u0000", "$1")
    return F.when(F.try_parse_json(clean).isNotNull(), clean).otherwise("{}")


def parse_verdict(text: Column | str) -> Column:
    """What lies between the first { and the last }, if it is JSON; else an object with the error and the first 2000 characters."""
    found = F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)
    bad = F.to_json(F.struct(F.lit("unparseable").alias("error"), F.substring(_c(text), 1, 2000).alias("raw")))
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found).otherwise(bad)


def md_cell(c: Column | str) -> Column:
    """The text as code in a table cell, of 160 characters at most."""
    v = F.replace(F.replace(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    mark = F.lit("`")
    return F.when(v == "", "-").otherwise(F.concat(mark, F.when(F.length(v) > 160, F.concat(F.substring(v, 1, 157), F.lit("…"))).otherwise(v), mark))


def cut(c: Column | str, n: int) -> Column:
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, n), F.lit("…"))).otherwise(_c(c))


def partition_key(*candidates: Column | str) -> Column:
    """The asset id, or else the agent, the source address or another origin, in the order given."""
    return F.coalesce(*[empty_to_null(_c(c).cast("string")) for c in candidates])


def fingerprint(rule_id: Column, key: Column, class_uid: Column, path: Column, user: Column) -> Column:
    """What makes hits the same alert: rule and key, with the path for file events and the user for brute force."""
    return F.concat_ws("|", rule_id, key, F.when(class_uid == 1001, path), F.when(rule_id == "bruteforce:success", user))


def technique_match(a: Column, b: Column) -> Column:
    return (a == b) | a.startswith(F.concat(b, F.lit("."))) | b.startswith(F.concat(a, F.lit(".")))


def grease_free(codes: Column) -> Column:
    """Without the reserved code points 0x0a0a, 0x1a1a, ... 0xfafa."""
    return F.filter(codes, lambda x: ~((x.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & (F.shiftright(x, 8) == x.bitwiseAND(F.lit(0xFF)))))


def ja3(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    listed = lambda c: F.array_join(c.cast("array<string>"), "-")
    return F.md5(F.concat_ws(",", version.cast("string"), listed(grease_free(ciphers)), listed(grease_free(extensions)), listed(grease_free(curves)), listed(formats)))


def ja3s(version: Column, cipher: Column, extensions: Column) -> Column:
    return F.md5(F.concat_ws(",", version.cast("string"), cipher.cast("string"), F.array_join(grease_free(extensions).cast("array<string>"), "-")))


def http_head(payload: Column | str) -> Column:
    """struct<method, uri, host, user_agent> of a head in HTTP/1; null if it is none. Headers over 512 characters are dropped, the URI is cut there."""
    p = F.substring(_c(payload), 1, 4096)
    line = r"^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE) ([^ \r\n]*) HTTP/1\."
    head = F.regexp_extract(p, r"(?s)^(.*?)(\r?\n\r?\n|$)", 1)
    header = lambda name: F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    short = lambda v: F.when((v != "") & (F.length(v) <= 512), v)
    found = F.struct(F.regexp_extract(p, line, 1).alias("method"), F.substring(F.regexp_extract(p, line, 2), 1, 512).alias("uri"), short(header("Host")).alias("host"), short(header("User-Agent")).alias("user_agent"))
    return F.when(p.rlike(line), found)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once and not written out at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ip_hex(c: Column | str) -> Column:
    """The 16 bytes of an address as hex digits, so that they order as numbers: IPv4 as mapped into IPv6, zones left out; null if it is none."""
    octets = lambda text: F.array_join(F.transform(F.split(text, r"\."), lambda x: F.lpad(F.lower(F.hex(x.try_cast("bigint"))), 2, "0")), "")
    tail = r"^(.*:)([0-9]{1,3}(?:\.[0-9]{1,3}){3})$"
    last = lambda v: F.regexp_extract(v, tail, 2)
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    plain = lambda v: F.when(last(v).rlike(IPV4), _let(octets(last(v)), lambda low: F.concat(F.regexp_extract(v, tail, 1), F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4)))).otherwise(v)

    def joined(p: Column) -> Column:
        head, rest = groups(F.regexp_extract(p, "^(.*?)(::|$)", 1)), groups(F.regexp_extract(p, "::(.*)$", 1))
        gap = lambda ends: F.greatest(F.lit(8) - F.size(ends["head"]) - F.size(ends["rest"]), F.lit(0))
        whole = _let(F.struct(head.alias("head"), rest.alias("rest")), lambda ends: F.concat(ends["head"], F.array_repeat(F.lit("0"), gap(ends)), ends["rest"]))
        return F.when(p.rlike(IPV6), F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    six = _let(F.regexp_replace(F.lower(_c(c)), "%.*$", ""), lambda v: _let(plain(v), joined))
    return F.when(_c(c).rlike(IPV4), F.concat(F.lit("0" * 20 + "ffff"), octets(_c(c)))).otherwise(_let(six, lambda h: F.when(F.length(h) == 32, h)))


def ip_text(c: Column | str) -> Column:
    """One spelling of each address: IPv4 with dots, also if it is mapped into IPv6; else lower-case groups without leading zeros, the first longest run of zero groups as `::`. What is no address stays as it is."""
    four = lambda h: F.array_join(F.transform(F.array(*[F.lit(k) for k in (25, 27, 29, 31)]), lambda k: F.conv(F.substring(h, k, F.lit(2)), 16, 10)), ".")
    groups = lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda k: F.regexp_replace(F.substring(h, k, F.lit(4)), "^0{1,3}", "")), ":")

    def short(text: Column) -> Column:
        out = text
        for n in range(2, 9):  # the longest run is asked for first
            run = r"(^|:)0(:0){%d}(:|$)" % (n - 1)
            out = F.when(text.rlike(run), F.concat(F.regexp_extract(text, rf"^(.*?){run}", 1), F.lit("::"), F.regexp_extract(text, rf"^.*?{run}(.*)$", 4))).otherwise(out)
        return out

    six = _let(ip_hex(c), lambda h: F.when(h.isNull(), _c(c)).when(h.startswith("0" * 20 + "ffff"), four(h)).otherwise(_let(groups(h), short)))
    return F.when(_c(c).rlike(IPV4), _c(c)).otherwise(six)


def flow_key(src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    """struct<a, a_port, b, b_port, forward>: ends in the order of their numbers and in one spelling, so that both directions share a key."""
    number = lambda c: F.coalesce(ip_hex(c), F.concat(F.lit("x"), c))

    def key(e: Column) -> Column:
        pick = lambda x, y: F.when(e["forward"], x).otherwise(y)
        return F.struct(pick(e["s"], e["d"]).alias("a"), pick(sport, dport).alias("a_port"), pick(e["d"], e["s"]).alias("b"), pick(dport, sport).alias("b_port"), e["forward"].alias("forward"))

    ordered = lambda e: _let(F.struct(e["s"].alias("s"), e["d"].alias("d"), ((number(e["s"]) < number(e["d"])) | ((e["s"] == e["d"]) & (sport <= dport))).alias("forward")), key)
    return _let(F.struct(ip_text(src).alias("s"), ip_text(dst).alias("d")), ordered)


def client_is_a(flags: Column, forward: Column) -> Column:
    """By the first packet: a SYN is sent by the client, a SYN with ACK by the server, anything else by the client."""
    syn_ack = flags.bitwiseAND(F.lit(18)) == 18
    return F.when(syn_ack, ~forward).otherwise(forward)


def event_xml_field(xml: Column | str, name: str) -> Column:
    return empty_to_null(F.regexp_extract(_c(xml), rf"(?s)<Data Name=['\"]{name}['\"]>(.*?)</Data>", 1))


def event_xml_id(xml: Column | str) -> Column:
    return F.regexp_extract(_c(xml), r"<EventID[^>]*>([0-9]+)</EventID>", 1).try_cast("int")


def event_xml_pid(xml: Column | str) -> Column:
    return F.regexp_extract(_c(xml), r"<Execution[^>]*ProcessID=['\"]([0-9]+)['\"]", 1).try_cast("int")


def wmi_items(text: Column | str) -> Column:
    """array<struct<name, value>> of an object or an array of objects with a Name; the value is the object's JSON."""
    v = F.try_parse_json(F.when(F.ltrim(_c(text)).startswith("["), _c(text)).otherwise(F.concat(F.lit("["), _c(text), F.lit("]"))))
    items = F.try_variant_get(v, "$", "array<variant>")
    named = F.transform(items, lambda x: F.struct(F.try_variant_get(x, "$.Name", "string").alias("name"), F.to_json(x).alias("value")))
    return F.filter(F.coalesce(named, F.array().cast("array<struct<name:string,value:string>>")), lambda x: F.coalesce(x["name"], F.lit("")) != "")


_SEVERITY = {1: "informational", 2: "low", 3: "medium", 4: "high", 5: "critical"}


def named(c: Column, names: dict) -> Column:
    """The name of a value, or the value itself where it has none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(table, c), c.cast("string")) if names else c.cast("string")


def severity_name(c: Column) -> Column:
    return named(c.cast("int"), _SEVERITY)


def status_name(c: Column) -> Column:
    return named(c, {"open": "Open", "triaged": "Triaged", "closed": "Closed", "false_positive": "False positive"})


def verdict_name(c: Column) -> Column:
    return named(c, {"malicious": "Malicious", "suspicious": "Suspicious", "benign": "Benign"})


def shard_of(key: Column, n: int) -> Column:
    """A shard for a key, fixed by the key; rows of one key share it."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
