"""One pass over one text: scoped tokens, relevance, and the state to go on from.

Offsets are in UTF-16 units in results and in code points inside.  Rules see the
whole text; end checks and keyword searches see a substring of it.
"""

from __future__ import annotations

import bisect
import functools
import pickle
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from .compiler import Compiled, Compiler
from .model import GrammarError, Hints, Language, UnknownLanguage

MOST_HITS = 7
#: In a text with such a word, rules that begin with a name are searched for word by word.
LONG_WORD = re.compile(r"\w{1000}")
FUSE = 100_000
MOST_DEPTH = 64


class Illegal(Exception):
    pass


class Loop(Exception):
    pass


class Cancelled(Exception):
    """The caller's probe asked to stop; there is no result."""


@dataclass
class Token:
    start: int
    length: int
    scopes: tuple[str, ...]


@dataclass
class Result:
    language: str | None
    relevance: float = 0.0
    illegal: bool = False
    tokens: list[Token] = field(default_factory=list)
    source_length: int = 0
    state: tuple | None = None
    second: tuple[str, float] | None = None


class Emitter:
    """Tokens in code points; touching runs with equal scopes become one."""

    def __init__(self) -> None:
        self.tokens: list[Token] = []
        self.scopes: list[str] = []
        self.at = 0

    def text(self, n: int, *more: str) -> None:
        scopes = (*self.scopes, *more)
        if n and scopes:
            last = self.tokens[-1] if self.tokens else None
            if last and last.start + last.length == self.at and last.scopes == scopes:
                last.length += n
            else:
                self.tokens.append(Token(self.at, n, scopes))
        self.at += n

    def splice(self, tokens: list[Token], n: int) -> None:
        begin = self.at
        for t in tokens:
            self.text(begin + t.start - self.at)
            self.text(t.length, *t.scopes)
        self.text(begin + n - self.at)


@dataclass
class Frame:
    mode: Compiled
    parent: Frame | None
    data: dict = field(default_factory=dict)

    def path(self) -> tuple:
        out, at = [], self
        while at is not None:
            out.append((at.mode.ident, tuple(sorted(at.data.items()))))
            at = at.parent
        return tuple(reversed(out))


class Grammar:
    """A compiled language."""

    def __init__(self, language: Language):
        self.language = language
        self.modes = Compiler(language).compile()


class Highlighter:
    """Compiled grammars by name or alias, built when first asked for.

    identity names the registry and revision its contents; both are part of the keys of stored results."""

    def __init__(self, factories: dict[str, Callable[[], Language]], identity: str | None = None):
        self.identity = identity or uuid.uuid4().hex
        self.revision = 0
        self.names: dict[str, str] = {}
        self.languages: dict[str, Language] = {}
        self.hints: dict[str, Hints] = {}
        #: the revision at which each language came
        self.generations: dict[str, int] = {}
        self.grammars: dict[str, Grammar | GrammarError] = {}
        self.building: list[str] = []
        for name, factory in factories.items():
            self.register(name, factory)
        self.bundled = dict(self.languages) if identity else {}

    def register(self, name: str, factory: Callable[[], Language], hints: Hints | None = None) -> None:
        """Adds or replaces a language and the names its files go by.  A replaced one gives up the aliases it still owns; later owners displace earlier ones."""
        language = self.built(name, factory)
        for alias in [a for a, owner in self.names.items() if owner == name]:
            del self.names[alias]
        self.languages[name], self.hints[name] = language, hints or Hints()
        self.grammars.pop(name, None)
        for alias in language.aliases:
            if alias.lower() not in self.languages:
                self.names[alias.lower()] = name
        self.names[name.lower()] = name
        self.revision += 1
        self.generations[name] = self.revision

    def built(self, name: str, factory: Callable[[], Language]) -> Language:
        self.building.append(name)
        try:
            return factory()
        finally:
            self.building.pop()

    def resolve(self, name: str) -> str | None:
        return self.names.get(name.lower())

    def grammar_name(self, name: str) -> str:
        canonical = self.resolve(name)
        if canonical is None:
            raise UnknownLanguage(name)
        return canonical

    def grammar(self, name: str) -> Grammar:
        """The compiled grammar.  One that contradicts itself fails each time it is asked for, until it is replaced."""
        if self.building:
            raise GrammarError(f"{self.building[-1]}: a factory can't compile languages")
        canonical = self.grammar_name(name)
        known = self.grammars.get(canonical)
        if known is None:
            try:
                known = Grammar(self.languages[canonical])
            except GrammarError as e:
                known = e
            self.grammars[canonical] = known
        if isinstance(known, GrammarError):
            raise known
        return known

    def owner(self, canonical: str) -> tuple:
        """What a state to go on from belongs to."""
        return self.identity, canonical, self.generations[canonical]

    @property
    def changed(self) -> bool:
        """Whether it is other than what every process has by itself."""
        return not self.bundled or len(self.languages) != len(self.bundled) or any(self.bundled.get(n) is not x for n, x in self.languages.items())

    def packed(self) -> bytes | None:
        """What another process needs to make the same registry; nothing for the bundled one as it is."""
        if not self.changed:
            return None
        from pyspark import cloudpickle

        own = {n: x for n, x in self.languages.items() if self.bundled.get(n) is not x}
        return cloudpickle.dumps((self.identity, self.revision, [n for n in self.languages if n not in own], own, self.names, self.generations))

    def highlight(self, text: str, name: str, ignore_illegals: bool = True, state: tuple | None = None, utf16: bool = True, above: tuple = (), cancelled: Callable[[], bool] | None = None) -> Result:
        """state: that of a result before, to go on from; one of another registry, language or generation is as none."""
        run = Run(self, self.grammar(name), text, ignore_illegals, state, above, cancelled)
        canonical = run.grammar.language.name
        try:
            result = run.go()
        except Illegal:
            result = Result(canonical, illegal=True)
        except Loop:
            result = Result(canonical)
        result.source_length = len(text)
        return in_utf16(result, text) if utf16 else result

    def detect(self, text: str, among: list[str] | None = None, utf16: bool = True, above: tuple = (), cancelled: Callable[[], bool] | None = None) -> Result:
        """The best of the plain reading (relevance 0) and the languages that take part and find nothing illegal."""
        tried = [Result(None, source_length=len(text))]
        for name in sorted(self.languages) if among is None else among:
            canonical = self.resolve(name)
            if canonical is None or not self.languages[canonical].detectable:
                continue
            result = self.highlight(text, canonical, ignore_illegals=False, utf16=False, above=above, cancelled=cancelled)
            if not result.illegal:
                tried.append(result)
        ranked = self.rank([(r.language, r.relevance) for r in tried])
        best = tried[ranked[0]]
        if len(ranked) > 1 and tried[ranked[1]].language is not None:
            best.second = (tried[ranked[1]].language, tried[ranked[1]].relevance)
        return in_utf16(best, text) if utf16 else best

    def rank(self, tried: list[tuple[str | None, float]]) -> list[int]:
        """Places by relevance; of equals the base comes before its superset, else the given order holds."""
        order = sorted(range(len(tried)), key=lambda i: -tried[i][1])
        out: list[int] = []
        while order:
            top = tried[order[0]][1]
            group = [i for i in order if tried[i][1] == top]
            order = order[len(group) :]
            while group:
                named = {tried[i][0] for i in group}
                free = [i for i in group if tried[i][0] is None or self.languages[tried[i][0]].superset_of not in named - {tried[i][0]}]
                pick = (free or group)[0]
                out.append(pick)
                group.remove(pick)
        return out


def in_utf16(result: Result, text: str) -> Result:
    """Offsets from code points to UTF-16 units."""
    wide = [i for i, c in enumerate(text) if c > "￿"] if text and max(text) > "￿" else []
    if wide:
        for t in result.tokens:
            a, b = t.start + bisect.bisect_left(wide, t.start), t.start + t.length + bisect.bisect_left(wide, t.start + t.length)
            t.start, t.length = a, b - a
    result.source_length = len(text) + len(wide)
    return result


class Run:
    def __init__(self, owner: Highlighter, grammar: Grammar, text: str, ignore_illegals: bool, state: tuple | None, above: tuple, cancelled: Callable[[], bool] | None = None):
        self.owner, self.grammar, self.text, self.ignore, self.cancelled = owner, grammar, text, ignore_illegals, cancelled
        self.aliases = grammar.language.scope_aliases
        self.ci = grammar.language.case_insensitive
        self.out = Emitter()
        self.relevance = 0.0
        self.top = Frame(grammar.modes[0], None)
        self.hits: dict[str, int] = {}
        self.nested: dict[str, tuple] = {}
        self.belongs = owner.owner(grammar.language.name)
        if state and state[0] == self.belongs:
            for k, (ident, data) in enumerate(state[1]):
                self.top = Frame(grammar.modes[ident], self.top if k else None, dict(data))
                if k and self.top.mode.scope:
                    self.out.scopes.append(self.name(self.top.mode.scope))
            self.hits, self.nested = dict(state[2]), dict(state[3])
        self.above = (*above, (grammar.language.name, len(text), self.top.mode.ident))
        self.said: dict = {}
        self.begin = 0  # of what is buffered
        self.end = 0
        #: by mode: next starts of its rules (past the text's end without), their matches, and from where these were searched
        self.slots: dict[int, tuple[list[int], list, list[int]]] = {}
        self.lowest: dict[int, int] = {}
        self.long = LONG_WORD.search(text) is not None

    def name(self, scope: str) -> str:
        return self.aliases.get(scope, scope)

    def go(self) -> Result:
        text, n = self.text, len(self.text)
        index, same, cursor, last, rounds = 0, False, 0, None, 0
        while True:
            rounds += 1
            if self.cancelled and rounds % 64 == 1 and self.cancelled():
                raise Cancelled
            if not same:
                cursor = 0
            found = self.scan(cursor, index)
            if cursor and (found is None or found[0].start() != index):
                cursor, found = 0, self.scan(0, index + 1)
            same = False
            if found is None:
                break
            m, rule = found
            pattern, kind, mode = self.top.mode.rules[rule]
            cursor = 0 if rule + 1 == self.top.mode.begins else rule + 1
            at = m.start()
            if rounds > FUSE and rounds > 3 * at:
                raise Loop
            self.end = at
            size = m.end() - at
            if last == ("begin", at) and kind == "end" and not size:
                self.end = min(at + 1, n)
                last, index = (kind, at), at + 1
                continue
            last = (kind, at)
            if kind == "begin":
                if self.vetoed(mode, m):
                    if cursor == 0:
                        self.end = min(at + 1, n)
                        index = at + 1
                    else:
                        same, index = True, at
                    continue
                index = self.begun(mode, m)
                continue
            if kind == "illegal":
                if not self.ignore:
                    raise Illegal
                if not size:
                    self.end = min(at + 1, n)
                    index = at + 1
                    continue
            elif kind == "end":
                to = self.ended(m)
                if to is not None:
                    index = to
                    continue
            self.end = m.end()
            index = m.end() if size else at
            if not size:
                index = at + 1
                self.end = min(index, n)
            if index > n:
                break
        self.end = n
        self.flush()
        # what an embedded language left open goes on only where its host is open
        open_ = {mode.mode.sub_language for mode in self.stack() if isinstance(mode.mode.sub_language, str)}
        nested = {name: state for name, state in self.nested.items() if any(self.owner.resolve(x) == name for x in open_)}
        state = (self.belongs, self.top.path(), tuple(sorted(self.hits.items())), tuple(sorted(nested.items())))
        return Result(self.grammar.language.name, self.relevance, False, self.out.tokens, n, state)

    def stack(self) -> list[Compiled]:
        out, frame = [], self.top
        while frame is not None:
            out.append(frame.mode)
            frame = frame.parent
        return out

    def scan(self, first: int, at: int):
        """The earliest match at or after at of the rules from first on; of equals the first rule's.

        A rule is searched again only when its last match lies behind, so rules that match far ahead cost nothing."""
        mode, text, none = self.top.mode, self.text, len(self.text) + 1
        if at >= none:
            return None
        slot = self.slots.get(mode.ident)
        if slot is None:
            n = mode.quiet if self.ignore else len(mode.rules)
            slot = self.slots[mode.ident] = [-1] * n, [None] * n, [0] * n
        starts, found, since = slot
        if at < self.lowest.get(mode.ident, 0):
            # the scan went back: what was searched from further on may have passed over a match
            for k, s in enumerate(since):
                if s > at:
                    starts[k] = -1
        self.lowest[mode.ident] = at
        best = none
        for k, start in enumerate(starts if not first else starts[first:], first):
            if start < at:
                m = (mode.careful if self.long else mode.searches)[k](text, at)
                start = starts[k] = none if m is None else m.start()
                found[k], since[k] = m, at
            if start == at:
                return found[k], k
            if start < best:
                best, which = start, k
        return None if best == none else (found[which], which)

    def vetoed(self, mode: Compiled, m) -> bool:
        if mode.after_dot and m.start() and self.text[m.start() - 1] == ".":
            return True
        self.said = {}
        return bool(mode.mode.on_begin and mode.mode.on_begin(m, self.said))

    def begun(self, mode: Compiled, m) -> int:
        raw = mode.mode
        if raw.skip:
            self.end = m.end()
        else:
            if raw.exclude_begin:
                self.end = m.end()
            self.flush()
            if not raw.return_begin and not raw.exclude_begin:
                self.end = m.end()
        self.enter(mode, m)
        return m.start() if raw.return_begin else m.end()

    def enter(self, mode: Compiled, m) -> None:
        if mode.scope:
            self.out.scopes.append(self.name(mode.scope))
        if mode.begin_wrap:
            self.out.text(self.end - self.begin, self.name(mode.begin_wrap))
            self.begin = self.end
        elif mode.begin_groups:
            self.groups(mode.begin_groups, m, mode)
        # what the beginning's callback noted is there for the end's
        self.top, self.said = Frame(mode, self.top, self.said), {}
        if mode.mode.end_same_as_begin:
            self.top.data["same"] = m[1] or "" if m.re.groups else ""

    def groups(self, groups: list, m, mode: Compiled) -> None:
        for group, scope in groups:
            size = len(m[group] or "")
            if not size:
                continue
            self.end = self.begin + size
            if scope:
                self.out.text(size, self.name(scope))
                self.begin = self.end
            else:
                self.words(mode)

    def closing(self, frame: Frame, at: int) -> Frame | None:
        mode, found = frame.mode, None
        if mode.end is not None and (found := mode.end_at(self.text, at)):
            if mode.mode.end_same_as_begin and (found[1] if found.re.groups else None) != frame.data.get("same"):
                found = None
            elif mode.mode.on_end and mode.mode.on_end(found, frame.data):
                found = None
        if found:
            while frame.mode.mode.ends_parent and frame.parent is not None and frame.parent.parent is not None:
                frame = frame.parent
            return frame
        if mode.mode.ends_with_parent and frame.parent is not None:
            return self.closing(frame.parent, at)
        return None

    def ended(self, m) -> int | None:
        target = self.closing(self.top, m.start())
        if target is None or target.parent is None:
            return None
        origin, raw = self.top.mode, self.top.mode.mode
        if origin.end_wrap:
            self.flush()
            self.out.text(m.end() - m.start(), self.name(origin.end_wrap))
            self.begin = self.end = m.end()
        elif origin.end_groups:
            self.flush()
            own = origin.end_at(self.text, m.start()) or m
            self.groups(origin.end_groups, own, origin)
        elif raw.skip:
            self.end = m.end()
        else:
            if not (raw.return_end or raw.exclude_end):
                self.end = m.end()
            self.flush()
            if raw.exclude_end:
                self.end = m.end()
        above = target.parent
        while self.top is not above:
            if self.top.mode.scope and self.out.scopes:
                self.out.scopes.pop()
            if not self.top.mode.mode.skip and self.top.mode.mode.sub_language is None:
                self.relevance += self.top.mode.relevance
            self.top = self.top.parent
        if target.mode.starts:
            self.enter(target.mode.starts, m)
        return m.start() if raw.return_end else m.end()

    def flush(self) -> None:
        if self.top.mode.mode.sub_language is not None:
            self.sub()
        else:
            self.words(self.top.mode)

    def absent(self, mode: Compiled, part: str) -> bool:
        """Whether no keyword is in this part."""
        return mode.keywords.keys().isdisjoint(mode.keyword_words(part.lower() if self.ci else part))

    def words(self, mode: Compiled) -> None:
        """Emits the buffer; keywords in it as tokens."""
        if mode.keywords and self.end > self.begin:
            part, at = self.text[self.begin : self.end], 0
            if self.absent(mode, part):
                self.out.text(len(part))
                self.begin = self.end
                return
            for m in mode.keyword_pattern.finditer(part):
                word = m[0].lower() if self.ci else m[0]
                known = mode.keywords.get(word)
                if known is None:
                    continue
                scope, relevance = known
                if relevance:
                    hits = self.hits[word] = self.hits.get(word, 0) + 1
                    if hits <= MOST_HITS:
                        self.relevance += relevance
                if scope[0] != "_":
                    self.out.text(m.start() - at)
                    self.out.text(m.end() - m.start(), self.name(scope))
                    at = m.end()
            self.out.text(len(part) - at)
        else:
            self.out.text(self.end - self.begin)
        self.begin = self.end

    def sub(self) -> None:
        part, wanted = self.text[self.begin : self.end], self.top.mode.mode.sub_language
        self.begin = self.end
        if not part:
            return
        result = None
        if len(self.above) < MOST_DEPTH:
            if isinstance(wanted, str):
                canonical = self.owner.resolve(wanted)
                state = self.nested.get(canonical)
                # the same language must get a smaller text, or one of equal size in another mode
                mode = state[1][-1][0] if state else 0
                if canonical and not any(name == canonical and (size < len(part) or (size == len(part) and ident == mode)) for name, size, ident in self.above):
                    result = self.owner.highlight(part, canonical, True, state, utf16=False, above=self.above, cancelled=self.cancelled)
                    if result.state:
                        self.nested[canonical] = result.state
            elif not any(size <= len(part) for _, size, _ in self.above):
                result = self.owner.detect(part, wanted or None, utf16=False, above=self.above, cancelled=self.cancelled)
        if result is None:
            self.out.text(len(part))
            return
        if self.top.mode.relevance > 0:
            self.relevance += result.relevance
        self.out.splice(result.tokens, len(part))


@functools.cache
def shared() -> Highlighter:
    """The bundled languages, compiled once in each process.  What is registered here later is carried to tasks by the operators."""
    from .languages import FACTORIES, HINTS

    out = Highlighter(FACTORIES, "bundled")
    out.hints |= HINTS
    return out


@functools.lru_cache(maxsize=8)
def unpacked(data: bytes | None) -> Highlighter:
    """The registry that packed() was called on, made once in each process."""
    from .languages import FACTORIES

    if data is None:
        return shared()
    identity, revision, bundled, own, names, generations = pickle.loads(data)
    out = Highlighter({n: FACTORIES[n] for n in bundled}, identity)
    out.languages |= own
    out.revision, out.names, out.generations = revision, names, generations
    return out


def saved(state: tuple | None) -> bytes | None:
    """A state as a column's value."""
    return None if state is None else pickle.dumps(state, 5)


def restored(data: bytes | None) -> tuple | None:
    return None if data is None else pickle.loads(bytes(data))
