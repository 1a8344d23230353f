"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns before it as context, then
the reply, of which only the text is trainable.  Turns after the last reply (or
a conversation without one) come in a last example with nothing trainable, so
that a conversation can be read back from its examples.

    user       <s>[INST] text [/INST]
    assistant  a space, text, </s>
    system     <<SYS>>text<</SYS>>
    others     <|role|>text<|/|>

Control strings all start with < or [.  In texts and roles the backslash, <, [
and | (roles only) become two characters, so none can occur there, and the
change can be undone.

Rows of a conversation are brought together and sorted by Spark, and run through
as a stream: nothing but the current prefix is held, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .runtime import prepare

TURN = re.compile(r"<s>\[INST\] ([^<\[]*) \[/INST\]| ([^<\[]*)</s>|<<SYS>>([^<\[]*)<</SYS>>|<\|([^<\[|]*)\|>([^<\[]*)<\|/\|>")
FLUSH_CHARS = 4 << 20
_PLAIN = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\p": "|"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lbp]", lambda m: _PLAIN[m[0]], text) if "\\" in text else text


def parts_of(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, in and after a turn's text."""
    body = escape(text)
    if role == "user":
        return "<s>[INST] ", body, " [/INST]"
    if role == "assistant":
        return " ", body, "</s>"
    if role == "system":
        return "<<SYS>>", body, "<</SYS>>"
    return f"<|{escape(role).replace('|', '\\p')}|>", body, "<|/|>"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastindex
        turns.append((unescape(m[4]), unescape(m[5])) if kind == 5 else (("user", "assistant", "system")[kind - 1], unescape(m[kind])))
        at = m.end()
    return turns


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _expand(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["conv_id", "example", "formatted", "mask_start", "mask_end"])

    now, prefix, n, open_ = object(), "", 0, False
    for conv, role, text in _rows(batches):
        if conv != now:
            if open_:
                out.append((now, n, prefix, len(prefix), len(prefix)))
            now, prefix, n, open_ = conv, "", 0, False
        before, body, after = parts_of(role or "", text or "")
        start = len(prefix) + len(before)
        prefix = f"{prefix}{before}{body}{after}"
        open_ = role != "assistant"
        if not open_:
            out.append((conv, n, prefix, start, start + len(body)))
            n += 1
            held += len(prefix)
        if held > FLUSH_CHARS or len(out) > 4096:
            yield flush()
            out, held = [], 0
    if open_:
        out.append((now, n, prefix, len(prefix), len(prefix)))
    if out:
        yield flush()


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, mask_start, mask_end), a conversation's examples together and in order.

    Turns are ordered by turn, then role, then text.  Null roles and texts are
    empty.  Rows with a null conv_id are one conversation.  Rows that repeat are
    turns that repeat; an empty table gives no rows."""
    prepare(conversations.sparkSession)
    field = conversations.schema["conv_id"]
    kind = to_arrow_type(field.dataType)
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return turns.mapInArrow(lambda batches: _expand(batches, kind), f"conv_id {field.dataType.simpleString()}, example long, formatted string, mask_start long, mask_end long")


def _digest(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    out: list[tuple] = []
    state: list = []

    def close() -> None:
        conv, last, loss, loss_chars, chars, n = state
        turns, digest = 0, hashlib.sha256()
        for role, text in parse(last):
            turns += 1
            digest.update(f"{role}\n{text}\n".encode())
        out.append((conv, turns, digest.hexdigest(), loss_chars, loss.hexdigest(), chars, n))

    for conv, _, formatted, start, end in _rows(batches):
        if not state or state[0] != conv:
            if state:
                close()
            state = [conv, "", hashlib.sha256(), 0, 0, 0]
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out.clear()
        text = unescape(formatted[start:end])
        state[1] = formatted
        state[2].update(text.encode())
        state[3] += len(text)
        state[4] += len(formatted)
        state[5] += 1
    if state:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def digests(made: DataFrame) -> DataFrame:
    """What the examples of each conversation say: its turns are parsed from the longest, its loss from each mask.
    formatted_chars: of all its examples."""
    field = made.schema["conv_id"].dataType.simpleString()
    kind = to_arrow_type(made.schema["conv_id"].dataType)
    return made.mapInArrow(lambda batches: _digest(batches, kind), f"conv_id {field}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def op1(conversations: DataFrame) -> DataFrame:
    """All conversations and the control-string probe -1, digested from their examples."""
    probe = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(examples(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)))


_ESCAPED = r"(length(coalesce(text,'')) + length(regexp_replace(coalesce(text,''), '[^\\<\[]', '', 'g')))"
OP1_SQL = rf"""
with rows as (
  select conv_id, turn, coalesce(role,'') as role, coalesce(text,'') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, {_ESCAPED} + case role when 'user' then 18 when 'assistant' then 5 when 'system' then 15 else 9 + length(role) + length(regexp_replace(role, '[^\\<\[|]', '', 'g')) end as n,
    row_number() over (partition by conv_id order by turn, role, text) as k from rows),
grown as (
  select *, sum(n) over (partition by conv_id order by k) as upto, k = count(*) over (partition by conv_id) as last from sized)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (role = 'assistant' or last) as bigint) as formatted_chars,
  count(*) filter (role = 'assistant' or last) as n_examples
from grown group by conv_id
"""
