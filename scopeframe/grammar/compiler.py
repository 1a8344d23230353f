"""From modes to tables of compiled rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _compiler as sre
from re import _constants as _c
from re import _parser as _p

from .model import SELF, GrammarError, Language, Mode

NEVER, ALWAYS = r"(?!)", r""


def joined(parts: str | tuple[str, ...]) -> str:
    """Parts as groups in a row; references inside a part count from that part."""
    if isinstance(parts, str):
        return parts
    out, before = [], 0
    for part in parts:
        own = re.compile(part).groups
        out.append("(" + shifted(part, before + 1) + ")")
        before += own + 1
    return "".join(out)


def shifted(pattern: str, by: int) -> str:
    """The pattern with its back-references moved up."""
    return re.sub(r"\\\\|\\([1-9]\d*)", lambda m: f"\\{int(m[1]) + by}" if m[1] else m[0], pattern)


def either(*patterns: str) -> str:
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def group_scopes(parts: tuple[str, ...], scopes: dict[int, str]) -> list[tuple[int, str | None]]:
    """(group of the joined pattern, scope or None for keyword search) of every part."""
    out, at = [], 1
    for k, part in enumerate(parts, 1):
        out.append((at, scopes.get(k)))
        at += 1 + re.compile(part).groups
    return out


class Runs:
    """A pattern that starts with a run of parts.  A run without a match is passed over as a whole, so a search takes
    time in proportion to the text, not to its square."""

    def __init__(self, whole: re.Pattern, run: re.Pattern):
        self.whole, self.run = whole, run

    def search(self, text: str, at: int) -> re.Match | None:
        while found := self.run.search(text, at):
            if whole := self.whole.match(text, found.start()):
                return whole
            at = found.end()
        return None


def _first(items: list) -> list:
    """A parsed pattern's items, groups at its front opened."""
    while items and items[0][0] is _c.SUBPATTERN and not items[0][1][1] and not items[0][1][2]:
        items = [*items[0][1][3], *items[1:]]
    return items


def _any_of(item: tuple, state, flags: int) -> set[str] | None:
    """The characters (of those looked at) that one item matches; none for what is no single character."""
    if item[0] not in (_c.IN, _c.LITERAL, _c.NOT_LITERAL):
        return None
    one = sre.compile(_p.SubPattern(state, [item]), flags)
    return {c for c in SEEN if one.match(c)}


#: Characters by which classes are compared.
SEEN = [chr(i) for i in (*range(0x250), 0x3B1, 0x416, 0x5D0, 0x4E2D, 0x1F600)]


def by_word(pattern: re.Pattern) -> re.Pattern | Runs:
    """The pattern, as Runs if it begins with a name: one or more of a class, or one of a class and any number of another that holds it.  What
    fails at one character of such a run fails at the next."""
    flags = pattern.flags
    parsed = _p.parse(pattern.pattern, flags & ~re.UNICODE)
    items = _first(list(parsed))
    if not items or re.search(r"\(\?P=|\\[1-9]", pattern.pattern):
        return pattern
    op, of = items[0]
    if op is _c.MAX_REPEAT and of[0] in (1, 2) and of[1] is _c.MAXREPEAT and len(of[2]) == 1:
        run, begin = items[:1], _any_of(of[2][0], parsed.state, flags)
    else:
        run, begin = items[:2], _any_of(items[0], parsed.state, flags)
        if begin is None or len(items) < 2 or items[1][0] is not _c.MAX_REPEAT or items[1][1][0] != 0 or items[1][1][1] is not _c.MAXREPEAT or len(items[1][1][2]) != 1:
            return pattern
        rest = _any_of(items[1][1][2][0], parsed.state, flags)
        if rest is None or not begin <= rest:
            return pattern
    return Runs(pattern, sre.compile(_p.SubPattern(parsed.state, run), flags)) if begin and {"a", "b"} <= begin else pattern


@dataclass(eq=False)
class Compiled:
    """ident is the mode's place in its language, the same in every process."""

    mode: Mode
    ident: int
    scope: str | None
    relevance: float
    begin: str | None
    end: re.Pattern | None = None
    terminator: str | None = None
    begin_wrap: str | None = None
    end_wrap: str | None = None
    begin_groups: list | None = None
    end_groups: list | None = None
    keywords: dict[str, tuple[str, float]] | None = None
    keyword_pattern: re.Pattern | None = None
    starts: Compiled | None = None
    #: (pattern, kind, mode): beginnings of contained modes, then end, then illegal
    rules: list[tuple[re.Pattern | Runs, str, Compiled | None]] = field(default_factory=list)
    begins: int = 0
    after_dot: bool = False
    #: whether the end sees what is before it, so that it must be matched on the rest of the text alone
    end_looks_back: bool = False
    #: the rules' search functions
    searches: list = field(default_factory=list)
    #: the same for texts with very long words, in time proportional to the text
    careful: list = field(default_factory=list)
    #: how many of the rules matter where illegal text is ignored
    quiet: int = 0

    def end_at(self, text: str, at: int) -> re.Match | None:
        return self.end.match(text[at:]) if self.end_looks_back else self.end.match(text, at)

    def keyword_words(self, text: str) -> list[str]:
        """All words of a text; whole matches."""
        if self.keyword_pattern.groups:
            return [m[0] for m in self.keyword_pattern.finditer(text)]
        return self.keyword_pattern.findall(text)


#: Parts of a pattern that depend on what is before the place it is matched at.
LOOKS_BACK = re.compile(r"\\\\|\\\[|\[\^?\]?(?:\\.|[^\]\\])*\]|(\\[bBA]|\(\?<[=!]|\^)", re.DOTALL)


class Compiler:
    def __init__(self, language: Language):
        self.language = language
        self.flags = re.MULTILINE | (re.IGNORECASE if language.case_insensitive else 0)
        self.modes: list[Compiled] = []
        self.done: dict[tuple[int, int], Compiled] = {}
        self.variants: dict[int, list[Mode]] = {}
        self.keep: list[Mode] = []

    def regex(self, pattern: str) -> re.Pattern:
        try:
            return re.compile(pattern, self.flags)
        except re.error as e:
            raise GrammarError(f"{self.language.name}: {pattern!r}: {e}") from e

    def compile(self) -> list[Compiled]:
        if SELF in (self.language.root.contains or []):
            raise GrammarError("the root can't contain itself")
        self.one(self.language.root, None)
        return self.modes

    def expand(self, mode: Mode) -> list[Mode]:
        """The mode's variants; a mode that depends on its parent is copied for each."""
        if mode.variants:
            if id(mode) not in self.variants:
                self.variants[id(mode)] = [v.over(mode) for v in mode.variants]
                self.keep.append(mode)
            return self.variants[id(mode)]
        depends = mode
        while depends is not None:
            if depends.ends_with_parent:
                copy = mode.copy()
                if mode.starts:
                    copy.starts = mode.starts.copy()
                self.keep.append(copy)
                return [copy]
            depends = depends.starts
        return [mode]

    def one(self, mode: Mode, parent: Compiled | None) -> Compiled:
        key = (id(mode), id(parent) if mode.ends_with_parent else 0)
        if key in self.done:
            return self.done[key]
        self.keep.append(mode)
        source, mode = mode, mode.copy()
        if mode.match is not None:
            if mode.begin or mode.end:
                raise GrammarError("match goes with neither begin nor end")
            mode.begin = mode.match
        if isinstance(mode.scope, dict):
            mode.begin_scope, mode.scope = mode.scope, None
        keywords = mode.keywords
        if mode.before is not None:
            if mode.starts or isinstance(mode.begin, tuple):
                raise GrammarError("before goes with a single begin and without starts")
            inner = source.copy()
            inner.before, inner.ends_parent = None, True
            mode = Mode(relevance=0, begin=f"{mode.before}(?={mode.begin or mode.match})", starts=Mode(relevance=0, contains=[inner]), keywords=mode.keywords)
            self.keep.append(inner)
        out = Compiled(mode, len(self.modes), mode.scope if isinstance(mode.scope, str) else None, 1.0 if mode.relevance is None else mode.relevance, None)
        self.modes.append(out)
        self.done[key] = out
        for side in ("begin", "end"):
            scopes, pattern = getattr(mode, f"{side}_scope"), getattr(mode, side)
            if isinstance(scopes, dict):
                if not isinstance(pattern, tuple):
                    raise GrammarError(f"{side}_scope by group needs {side} in parts")
                if side == "begin" and (mode.skip or mode.exclude_begin or mode.return_begin) or side == "end" and (mode.skip or mode.exclude_end or mode.return_end):
                    raise GrammarError(f"{side}_scope by group goes without skip, exclude and return")
                setattr(out, f"{side}_groups", group_scopes(pattern, scopes))
            elif scopes:
                setattr(out, f"{side}_wrap", scopes)
        begin, end = joined(mode.begin) if mode.begin else None, joined(mode.end) if mode.end else None
        if mode.begin_keywords:
            listed = mode.begin_keywords.split()
            begin = r"\b(?:" + "|".join(listed) + r")(?!\.)(?=\b|\s)"
            out.after_dot = True
            if mode.relevance is None:
                out.relevance = 0.0
            if keywords is None:
                from .model import Keywords

                keywords = Keywords({"keyword": mode.begin_keywords})
        if keywords:
            lower = self.language.case_insensitive
            out.keywords = {(w.lower() if lower else w): (s, r) for w, s, r in keywords.pairs()}
            out.keyword_pattern = self.regex(keywords.pattern)
        if parent is not None:
            out.begin = begin or ALWAYS
            if not end and not mode.ends_with_parent:
                end = ALWAYS
            if end is not None:
                out.end = self.regex(end)
                out.end_looks_back = any(m[1] for m in LOOKS_BACK.finditer(end))
            terminator = end
            if mode.ends_with_parent and parent.terminator is not None:
                terminator = f"(?:{end})|{parent.terminator}" if end is not None else parent.terminator
            out.terminator = terminator
        for child in mode.contains or []:
            for each in self.expand(source if child is SELF else child):
                made = self.one(each, out)
                pattern = self.regex(made.begin)
                out.rules.append((Runs(pattern, self.regex(made.mode.run)) if made.mode.run else pattern, "begin", made))
        out.begins = len(out.rules)
        if out.terminator is not None:
            out.rules.append((self.regex(out.terminator), "end", None))
        out.quiet = len(out.rules)
        if mode.illegal:
            listed = [mode.illegal] if isinstance(mode.illegal, str) else mode.illegal
            pattern = self.regex(either(*listed))
            out.rules.append((pattern, "illegal", None))
            # ignored, it only keeps what it matches from the other rules: nothing, if that is one character, which they had first
            if _p.parse(pattern.pattern, pattern.flags & ~re.UNICODE).getwidth() != (1, 1):
                out.quiet = len(out.rules)
        out.searches = [pattern.search for pattern, *_ in out.rules]
        out.careful = [(by_word(pattern) if isinstance(pattern, re.Pattern) else pattern).search for pattern, *_ in out.rules]
        if mode.starts:
            out.starts = self.one(mode.starts, parent)
        return out
