"""Places of regular-expression matches, with Spark's own functions only.

split() and regexp_extract_all() see the same matches; the lengths of the pieces
between and of the matches give each match's place in code points.  Prefix sums
are folded in blocks and texts are cut from chunks, so a text with very many matches
costs little more than its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, CHUNK = 128, 4096


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def scan(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array, what join makes of zero and all elements before it; join is associative."""

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, summed)

    def summed(blocks: Column) -> Column:
        return let(F.transform(blocks, lambda x: F.aggregate(x, zero, join)), lambda sums: F.flatten(F.transform(blocks, lambda x, b: let(F.aggregate(F.slice(sums, F.lit(1), b), zero, join), lambda start: F.transform(x, lambda _, i: F.aggregate(F.slice(x, F.lit(1), i), start, join))))))

    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.slice(v, F.lit(1), F.lit(0))))


def places(pieces: Column, lengths: Column) -> Column:
    """array<struct<at, to>> of matches with these lengths, between these pieces."""
    gaps = F.transform(F.slice(pieces, F.lit(1), F.size(lengths)), lambda p: F.length(p))
    steps = F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("g"), n.alias("n")))
    made = let(steps, lambda s: F.zip_with(s, scan(F.transform(s, lambda x: x["g"] + x["n"]), F.lit(0), lambda a, b: a + b), lambda x, before: F.struct((before + x["g"]).alias("at"), (before + x["g"] + x["n"]).alias("to"))))
    return F.when(F.size(lengths) > 0, made).otherwise(F.array().cast("array<struct<at:int,to:int>>"))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches (or their group); none for texts without, at the price of one search."""
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def between(text: Column, pattern: str, matches: Column) -> Column:
    return F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(parts: Column, a: Column, b: Column) -> Column:
    """The code points from a to b of a text in chunks."""
    first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    whole = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    apart = F.concat(F.substr(F.get(parts, first), a % CHUNK + 1, F.lit(CHUNK)), whole, F.coalesce(F.substr(F.get(parts, last), F.lit(1), b % CHUNK), F.lit("")))
    return F.when(b <= a, "").when(first == last, F.substr(F.get(parts, first), a % CHUNK + 1, b - a)).otherwise(apart)


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span (struct with at, to; sorted by at) replaced by the mark; those that overlap together."""

    def one(parts: Column, s: Column) -> Column:
        before = scan(F.transform(s, lambda x: x["to"]), F.lit(0), lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(s, before, lambda x, to: F.when(x["at"] >= to, F.concat(cut(parts, to, x["at"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), cut(parts, F.array_max(F.transform(s, lambda x: x["to"])), F.length(text)))

    return let(chunks(text), lambda parts: let(spans, lambda s: one(parts, s)))
