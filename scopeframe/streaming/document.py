"""Documents that change: line-by-line state, edits, snapshots; in batch and as a stateful stream."""

from __future__ import annotations

import bisect
import itertools
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grammar.engine import Highlighter, Token, shared, unpacked
from ..operators.highlight import carried
from ..sources.session import prepare

EVERY = 32
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def split(text: str) -> list[str]:
    found = LINE.findall(text)
    return [*found, ""] if not text or text[-1] in "\r\n" else found


def units(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text) if not text.isascii() else len(text)


def place_of(text: str, offset: int) -> int | None:
    """The code point at a UTF-16 offset; None inside a surrogate pair."""
    if text.isascii():
        return offset
    at = 0
    for k, c in enumerate(text):
        if at >= offset:
            return k if at == offset else None
        at += 1 + (c > "\uffff")
    return len(text) if at == offset else None


@dataclass
class Document:
    """A text under one language (None: plain).  Each line starts from the state of the one before; at least every EVERY lines the state is kept.

    An edit touches the lines around it; parsing starts at the last kept state before and ends where a state kept before
    comes again and only lines as before follow."""

    language: str | None
    lines: list[str] = field(default_factory=lambda: [""])
    tokens: list[list[Token]] = field(default_factory=list)
    #: by line, the state before it
    kept: dict[int, tuple | None] = field(default_factory=dict)
    reparsed: int = 0
    registry: Highlighter | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "registry"} | {"registry": None}

    @staticmethod
    def of(text: str, language: str | None, registry: Highlighter | None = None, detect: bool = False) -> Document:
        """detect: the language is chosen once, by the first text."""
        own = registry or shared()
        if detect:
            language = own.detect(text, utf16=False).language
        out = Document(language if language is None else own.grammar_name(language), split(text), registry=registry)
        out.parse(0, 0, 0, {}, [])
        return out

    def parse(self, first: int, same: int, shift: int, old: dict, old_tokens: list) -> None:
        """From the last kept state up to line first on.  The last same lines are those of before, moved by shift lines."""
        begin = max((k for k in self.kept if k <= first), default=0)
        state = self.kept.get(begin)
        self.kept = {k: s for k, s in self.kept.items() if k <= begin}
        self.kept[begin] = state
        del self.tokens[begin:]
        self.reparsed, last, own = 0, begin, self.registry or shared()
        for k in range(begin, len(self.lines)):
            if k > first and k >= len(self.lines) - same and k - shift in old and old[k - shift] == state:
                self.tokens += old_tokens[k - shift :]
                self.kept |= {j + shift: s for j, s in old.items() if j >= k - shift}
                return
            if k - last >= EVERY:
                self.kept[k], last = state, k
            if self.language is None:
                self.tokens.append([])
            else:
                r = own.highlight(self.lines[k], self.language, state=state)
                state = r.state
                self.tokens.append(r.tokens)
            self.reparsed += 1

    def find(self, ends: list[int], offset: int) -> tuple[int, int] | None:
        """The line and the code point in it at an offset; None for one outside or inside a surrogate pair."""
        if not 0 <= offset <= ends[-1]:
            return None
        line = min(bisect.bisect_right(ends, offset), len(ends) - 1)
        at = place_of(self.lines[line], offset - (ends[line - 1] if line else 0))
        return None if at is None else (line, at)

    def replace(self, start: int, length: int, new: str) -> int:
        """Edits UTF-16 units; returns the line that the range starts in (the one before, where its end merges with what is new), whether or not
        its text comes out as before.  A range outside, or one that splits a surrogate pair, is a ValueError
        and changes nothing."""
        ends = list(itertools.accumulate(map(units, self.lines)))
        a, b = self.find(ends, start), self.find(ends, start + length) if length >= 0 else None
        if a is None or b is None:
            raise ValueError(f"no range {start}+{length}")
        # a line's end may merge with what is before or behind
        lo, hi = max(a[0] - 1, 0), min(b[0] + 2, len(self.lines))
        head, tail = "".join(self.lines[lo : a[0]]) + self.lines[a[0]][: a[1]], self.lines[b[0]][b[1] :] + "".join(self.lines[b[0] + 1 : hi])
        fresh = split(head + new + tail)
        if hi < len(self.lines) and fresh[-1] == "":
            fresh.pop()
        before = self.lines[lo:hi]
        front = next((k for k, (x, y) in enumerate(zip(before, fresh, strict=False)) if x != y), min(len(before), len(fresh)))
        self.reparsed = 0
        if before == fresh:
            return a[0]
        back = next((k for k, (x, y) in enumerate(zip(reversed(before[front:]), reversed(fresh[front:]), strict=False)) if x != y), min(len(before), len(fresh)) - front)
        old, old_tokens, same, shift = dict(self.kept), list(self.tokens), len(self.lines) - hi + back, len(fresh) - len(before)
        self.lines[lo:hi] = fresh
        self.parse(min(lo + front, len(self.lines) - 1), same, shift, old, old_tokens)
        return min(a[0], lo + front)

    def snapshot(self, start: int, length: int, most: int | None = None) -> tuple[list[Token], int]:
        """Tokens inside a range of UTF-16 units, counted from its start, at most so many; and how many more there are."""
        out, base = [], 0
        for line, tokens in zip(self.lines, self.tokens, strict=True):
            for t in tokens:
                a, b = max(base + t.start, start), min(base + t.start + t.length, start + length)
                if b > a:
                    out.append(Token(a - start, b - a, t.scopes))
            base += units(line)
        return (out, 0) if most is None else (out[:most], max(len(out) - most, 0))


REPORT = "edit_seq long, first_line long, lines long, reparsed long, tokens long, error string"
_EDIT = ("edit_seq", "start", "length", "replacement")


def _apply(document: Document | None, rows: list[tuple], language: str | None, registry: Highlighter) -> tuple[Document, list[tuple]]:
    out = []
    for seq, start, length, text in rows:
        error, line = None, 0
        if document is None:
            document = Document.of(text or "", language, registry, language is None)
        else:
            document.registry = registry
            try:
                line = document.replace(int(start), int(length), text or "")
            except ValueError as e:
                error, document.reparsed = str(e), 0
        out.append((seq, line, len(document.lines), document.reparsed, sum(map(len, document.tokens)), error))
    return document, out


def edits(df: DataFrame, key: str, language: str | None, registry: Highlighter | None = None) -> DataFrame:
    """A report an edit (edit_seq, start, length, replacement) of each document, in order; a document's first row is its whole text.

    Of equal edit_seq, edits go by start, length, replacement.  Without a language each document's is detected once, on its first text.  A
    document's edits are streamed in order; only its present text and states are held."""
    prepare(df.sparkSession)
    kind, packed = df.schema[key].dataType.simpleString(), carried(registry)
    if language is not None:
        (registry or shared()).grammar_name(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, document = unpacked(packed), None, None
        for batch in batches:
            reports: list[tuple] = []
            for k, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                document, made = _apply(document if (k,) == last else None, [tuple(row)], language, own)
                last = (k,)
                reports += made
            columns = list(zip(*reports, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, *(x.split()[0] for x in REPORT.split(", "))])

    sorted_ = df.select(key, *_EDIT).repartition(key).sortWithinPartitions(key, *_EDIT)
    return sorted_.mapInArrow(run, f"{key} {kind}, {REPORT}")


def stream_edits(df: DataFrame, key: str, language: str | None, registry: Highlighter | None = None) -> DataFrame:
    """The same over a stream.  A document's lines, tokens and kept states are its state, so an edit costs what it changes, not a parse of
    the whole.  Edits of a batch go in order; those of later batches come after."""
    prepare(df.sparkSession)
    kind, packed = df.schema[key].dataType.simpleString(), carried(registry)

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(list(_EDIT))
        document = pickle.loads(state.get[0]) if state.exists else None
        document, out = _apply(document, list(frame[list(_EDIT)].itertuples(index=False, name=None)), language, unpacked(packed))
        state.update((pickle.dumps(document, 5),))
        made = pd.DataFrame(out, columns=["edit_seq", "first_line", "lines", "reparsed", "tokens", "error"])
        made.insert(0, key, keys[0])
        yield made

    return df.select(key, *_EDIT).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {REPORT}", "document binary", "append", "NoTimeout")


def checkpoints(df: DataFrame, line: str, every: int = EVERY) -> DataFrame:
    """Adds checkpoint: the last line up to a column's whose state a freshly parsed document keeps."""
    return df.withColumn("checkpoint", F.col(line) - F.pmod(F.col(line), F.lit(every)))


def snapshots(df: DataFrame, start: Column, length: Column, most: int | None = None, tokens: str = "result.tokens") -> DataFrame:
    """Adds snapshot (the tokens inside a range, counted from its start, at most so many) and left_out (how many more there are).  No shuffle."""
    a = lambda t: F.greatest(t["start"], start)
    b = lambda t: F.least(t["start"] + t["length"], start + length)
    inside = F.filter(tokens, lambda t: b(t) > a(t))
    cut = F.transform(inside, lambda t: F.struct((a(t) - start).cast("int").alias("start"), (b(t) - a(t)).cast("int").alias("length"), t["scopes"].alias("scopes")))
    out = df.withColumn("snapshot", cut)
    if most is None:
        return out.withColumn("left_out", F.lit(0))
    return out.withColumn("left_out", F.greatest(F.size("snapshot") - most, F.lit(0))).withColumn("snapshot", F.slice("snapshot", 1, most) if most else F.slice("snapshot", 1, 0))


def line_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, offset, length): where each line starts, in UTF-16 units."""
    from pyspark.sql import Window

    from ..functions.text import lines, utf16_length

    rows = df.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "_line")).withColumn("length", utf16_length(F.col("_line")))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, F.col("line_no").cast("long").alias("line_no"), F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"), F.col("length").cast("long").alias("length"))
