"""Modes that many languages share; every call makes a fresh tree."""

from __future__ import annotations

from .model import Mode

ESCAPE = Mode(begin=r"\\[\s\S]", relevance=0)
IDENT = r"[a-zA-Z]\w*"
NUMBER = r"\b\d+(?:\.\d+)?"
C_NUMBER = r"(?:-?)(?:\b0[xX][a-fA-F0-9]+|(?:\b\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?)"
SHORT_WORDS = ("I", "a", "is", "so", "us", "to", "at", "if", "in", "it", "on")


def single() -> Mode:
    return Mode(scope="string", begin="'", end="'", illegal=r"\n", contains=[ESCAPE])


def double() -> Mode:
    return Mode(scope="string", begin='"', end='"', illegal=r"\n", contains=[ESCAPE])


def comment(begin: str, end: str, **more) -> Mode:
    """A comment with doc tags; runs of prose in it lose nothing and gain nothing."""
    out = Mode(scope="comment", begin=begin, end=end, contains=[], **more)
    out.contains.append(Mode(scope="doctag", begin=r"[ ]*(?=(TODO|FIXME|NOTE|BUG|OPTIMIZE|HACK|XXX):)", end=r"(TODO|FIXME|NOTE|BUG|OPTIMIZE|HACK|XXX):", exclude_begin=True, relevance=0))
    word = "(?:" + "|".join(SHORT_WORDS) + r"|[A-Za-z]+['](?:d|ve|re|ll|t|s|n)|[A-Za-z]+[-][a-z]+|[A-Za-z][a-z]{2,})"
    out.contains.append(Mode(begin=rf"[ ]+((?:{word})[.]?[:]?(?:[.][ ]|[ ])){{3}}"))
    return out


def line_comment(begin: str = "//", **more) -> Mode:
    return comment(begin, "$", **more)


def block_comment() -> Mode:
    return comment(r"/\*", r"\*/")


def hash_comment(**more) -> Mode:
    return comment("#", "$", **more)


def number(pattern: str = C_NUMBER, **more) -> Mode:
    return Mode(scope="number", begin=pattern, **({"relevance": 0} | more))


def shebang(pattern: str) -> Mode:
    return Mode(scope="meta", begin=rf"\A#![ ]*/.*\b{pattern}\b.*", end="$", relevance=0)
