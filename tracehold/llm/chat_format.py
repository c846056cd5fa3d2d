"""Operator 4: chat formatting with spans found by incremental black-box rendering.

A template is any function from the first k turns to one string. For each conversation the successive prefixes
are rendered and neighbouring outputs compared: what the k-th output adds to the one before is turn k's span. A
template that changes what it wrote before (it drops or rewrites earlier turns) is detected by that comparison, and
the conversation is marked; its spans then begin where the outputs part. The loss mask covers the assistant's texts
alone: rendering a turn once more with another text of the same kind shows where its text stands.

Rows are dealt by conversation and sorted by turn; each task streams through them and holds one conversation. As
every prefix is rendered, a conversation costs its number of turns times its length.

Defined results: null text and null role count as empty; a null conversation id doesn't say what belongs together, so
each such row is a conversation of its own; rows of one turn are ordered by turn (nulls first), role and text, and
repeated rows count as turns of their own; an empty table gives an empty result; other columns are ignored. Texts and roles of any content are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

END = " </turn>\n"
_ESCAPE = re.compile(r"([\\#<:])")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
_BODY = re.compile(r"((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    r"""Puts a backslash before each \, #, < and :, so that no control string survives inside a text."""
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The template of the query: ### role: text </turn>, one turn a line group."""
    return "".join(f"### {escape(role)}: {escape(text)}{END}" for role, text in turns)


def read_back(output: str) -> list[Turn]:
    """The turns that marked_turns wrote."""
    turns, at = [], 0
    while at < len(output):
        head = _HEAD.match(output, at)
        body = _BODY.match(output, head.end()) if head else None
        if body is None:
            raise ValueError(f"not a formatted conversation at character {at}")
        turns.append((unescape(head[1]), unescape(body[1])))
        at = body.end()
    return turns


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _text_span(history: list[Turn], role: str, output: str, template: Template, start: int) -> tuple[int, int]:
    """Where the last turn's text stands: the turn is rendered without text and with a mark that the template doesn't
    write itself, and these two part where the text begins. If the template's own parts change with the text, the
    whole turn is taken."""
    bare = template([*history, (role, "")])
    mark = next(chr(c) for c in (*range(0xE000, 0xF900), *range(0xF0000, 0x110000)) if chr(c) not in bare)
    left = common_prefix(bare, template([*history, (role, mark)]))
    right = left + len(output) - len(bare)
    if right >= left and output.startswith(bare[:left]) and output[right:] == bare[left:]:
        return left, right
    return start, len(output)


def locate(turns: list[Turn], template: Template, loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(output, span of each turn, spans of the loss mask, whether history was rewritten), all by looking at outputs only."""
    before, spans, mask, rewritten = template([]), [], [], False
    for k, (role, text) in enumerate(turns):
        output = template(turns[: k + 1])
        start = common_prefix(before, output)
        rewritten |= start < len(before)
        spans.append((start, len(output)))
        if role == loss_role and text:
            mask.append(_text_span(turns[:k], role, output, template, start))
        before = output
    return before, spans, mask, rewritten


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list[Turn]]]:
    """Whole conversations from rows sorted by conversation and turn."""
    key, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(batch["_conv"], batch["role"], batch["text"], strict=True):
            if begun and conv != key:
                yield key, turns
                turns = []
            key, begun = conv, True
            turns.append((role, text))
    if begun:
        yield key, turns


def _lengths(parts: list[tuple[int, int]]) -> list[list[int]]:
    return [[a, b] for a, b in parts]


def format_conversations(conversations: DataFrame, template: Template = marked_turns, loss_role: str = "assistant", conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, n_turns, formatted, turn_spans, loss_spans, rewritten), one row a conversation."""
    kind = dict(conversations.dtypes)[conv_col]
    rows = conversations.select(
        F.when(F.col(conv_col).isNotNull(), F.to_json(F.struct(F.col(conv_col).alias("k")))).otherwise(F.concat(F.lit('{"row":"'), F.uuid(), F.lit('"}'))).alias("_conv"),
        F.col("turn").alias("_turn"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")],
    )
    ordered = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "role", "text").select("_conv", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        size = 0
        for conv, turns in _conversations(batches):
            output, spans, mask, rewritten = locate(turns, template, loss_role)
            out.append((conv, len(turns), output, _lengths(spans), _lengths(mask), rewritten))
            size += len(output)
            if size > 4_000_000:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["_conv", "n_turns", "formatted", "turn_spans", "loss_spans", "rewritten"]
    done = ordered.mapInPandas(run, "_conv string, n_turns long, formatted string, turn_spans array<array<long>>, loss_spans array<array<long>>, rewritten boolean")
    return done.select(F.when(F.col("_conv").startswith('{"k"'), F.from_json("_conv", f"k {kind}")["k"]).alias(conv_col), *names[1:])


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the outputs say when they are read back: digests of all turns and of the text under the mask; whether the template rewrote history is carried through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for output, mask, rewritten in zip(b["formatted"], b["loss_spans"], b["rewritten"], strict=True):
                whole, loss = hashlib.sha256(), "".join(unescape(output[int(x[0]) : int(x[1])]) for x in mask)
                turns = read_back(output)
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                rows.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(output), rewritten))
            yield pd.DataFrame(rows, columns=names).assign(**{conv_col: b[conv_col]})[[conv_col, *names]]

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
    kind = dict(formatted.dtypes)[conv_col]
    return formatted.select(conv_col, "formatted", "loss_spans", "rewritten").mapInPandas(run, f"{conv_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_conversations(table.unionByName(extra)))


def oracle() -> str:
    """The digests from the table itself: what reading back must give. Each of \\, #, < and : is one character longer when escaped."""
    said = r"\### Assistant: </turn> ok"
    longer = lambda c: f"(length({c}) + length(regexp_replace({c}, '[^\\\\#<:]', '', 'g')))"
    return f"""
    with t as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '{said}' union all select -7, 1, 'assistant', '{said}')
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
           coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
           sum(15 + {longer('role')} + {longer('text')})::bigint as formatted_chars, false as rewritten
    from (select *, case when conv_id is null then row_number() over () end as alone from t) group by conv_id, alone"""
