"""Grammars as data: modes, keywords and language definitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

#: Stands for the mode it occurs in.
SELF = "self"


class GrammarError(ValueError):
    """A grammar that contradicts itself."""


class UnknownLanguage(LookupError):
    """No language of this name or alias is registered."""


@dataclass(eq=False)
class Mode:
    scope: str | dict[int, str] | None = None
    begin: str | tuple[str, ...] | None = None
    end: str | tuple[str, ...] | None = None
    match: str | tuple[str, ...] | None = None
    before: str | None = None
    #: the repeated part that begin starts with; where it matches and begin doesn't, begin doesn't anywhere in that match
    run: str | None = None
    begin_keywords: str | None = None
    begin_scope: str | dict[int, str] | None = None
    end_scope: str | dict[int, str] | None = None
    keywords: Keywords | None = None
    contains: list | None = None
    variants: list[Mode] | None = None
    starts: Mode | None = None
    illegal: str | list[str] | None = None
    relevance: float | None = None
    #: a language, several to detect among, or none to detect among all
    sub_language: str | list[str] | None = None
    ends_parent: bool = False
    ends_with_parent: bool = False
    exclude_begin: bool = False
    exclude_end: bool = False
    return_begin: bool = False
    return_end: bool = False
    skip: bool = False
    end_same_as_begin: bool = False
    #: (match, data of the frame) -> True to veto
    on_begin: Callable | None = None
    on_end: Callable | None = None

    def over(self, base: Mode) -> Mode:
        """This variant laid over its base: set fields win, flags can only be turned on."""
        out = Mode()
        for f in fields(Mode):
            own, other = getattr(self, f.name), getattr(base, f.name)
            setattr(out, f.name, own or other if isinstance(own, bool) else other if own is None else own)
        out.variants = None
        return out

    def copy(self) -> Mode:
        return Mode().over(self) if self.variants is None else Mode(**{f.name: getattr(self, f.name) for f in fields(Mode)})


@dataclass
class Keywords:
    """Words by scope; "word|3" has relevance 3.  A scope that starts with _ counts but isn't shown."""

    words: dict[str, str | list[str]]
    pattern: str = r"\w+"

    def pairs(self) -> Iterator[tuple[str, str, float]]:
        """(word, scope, relevance), scopes in sorted order; a later one wins."""
        for scope in sorted(self.words):
            listed = self.words[scope]
            for entry in listed.split() if isinstance(listed, str) else listed:
                word, _, relevance = entry.partition("|")
                yield word, scope, float(relevance) if relevance else 0.0 if word.lower() in COMMON else 1.0


#: Words too common in all languages to tell one (fixed values).
COMMON = frozenset("of and for in not or if then parent list value".split())


def words(default: str = "", pattern: str = r"\w+", **scopes: str) -> Keywords:
    found = dict(scopes)
    if default:
        found["keyword"] = default
    return Keywords(found, pattern)


@dataclass
class Language:
    name: str
    root: Mode
    aliases: tuple[str, ...] = ()
    case_insensitive: bool = False
    scope_aliases: dict[str, str] = field(default_factory=dict)
    detectable: bool = True
    superset_of: str | None = None


@dataclass(frozen=True)
class Hints:
    """By what names files of a language go."""

    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    interpreters: tuple[str, ...] = ()

    @staticmethod
    def of(extensions: str = "", filenames: str = "", interpreters: str = "") -> Hints:
        once = lambda text, strip=None: tuple(dict.fromkeys(w.lower().lstrip(strip) if strip else w.lower().rsplit("/", 1)[-1] for w in text.split()))
        return Hints(once(extensions, "."), once(filenames), once(interpreters))
