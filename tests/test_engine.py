"""The tokenising engine by itself: golden pairs, compiler checks, behaviour."""

import glob
import json
import os
import re

import pytest

from scopeframe.grammar.compiler import Runs, by_word
from scopeframe.grammar.engine import Emitter, Highlighter, shared
from scopeframe.grammar.languages import FACTORIES
from scopeframe.grammar.model import SELF, GrammarError, Language, Mode, UnknownLanguage, words
from scopeframe.streaming.document import Document, split

#: A folder of golden pairs, one folder a language.
GOLDEN = os.environ.get("GOLDEN_PAIRS", "")
#: Golden pairs of the bundled languages that agree in full; the README lists how many there are.
LEAST_GOLDEN = 231


def of(mode, **more):
    return Highlighter({"x": lambda: Language("x", mode, **more)})


def spans(result):
    return [(t.start, t.length, t.scopes) for t in result.tokens]


@pytest.mark.skipif(not os.path.isdir(GOLDEN), reason="GOLDEN_PAIRS names no folder")
def test_golden():
    good = 0
    for name in FACTORIES:
        for f in glob.glob(f"{GOLDEN}/{name}/*.tokens.json"):
            source = f.replace(".tokens.json", ".code.txt")
            if os.path.exists(source):
                with open(f) as a, open(source, newline="") as b:
                    want, r = json.load(a), shared().highlight(b.read(), name)
                good += spans(r) == [(t["start"], t["length"], tuple(t["scopes"])) for t in want["tokens"]] and abs(r.relevance - want["relevance"]) < 1e-3
    assert good >= LEAST_GOLDEN


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("nim", "let x: int = 0x1F'i32 # n", [("let", "keyword"), ("int", "type"), ("0x1F'i32", "number"), ("# n", "comment")]),
        ("armasm", "main:\n  mov r0, #1 ; n\n", [("main:", "symbol"), ("mov", "keyword"), ("r0", "built_in"), ("#1", "number"), ("; n", "comment")]),
        ("c", "int f(char c) { return 0x1; }", [("int", "type"), ("f", "title.function"), ("char", "type"), ("return", "keyword"), ("0x1", "number")]),
        ("ocaml", "let x = 'a' (* n *)", [("let", "keyword"), ("'a'", "string"), ("(* n *)", "comment")]),
        ("apache", "Listen 80\n", [("Listen", "attribute"), ("80", "number")]),
        ("nginx", "listen 80;\n", [("listen", "attribute"), ("80", "number")]),
        ("leaf", "#if(a):", [("#", "punctuation"), ("if", "keyword"), ("a", "variable"), (":", "punctuation")]),
        ("nix", "{ a = 1 - 2; }", [("a", "attr"), ("=", "operator"), ("1", "number"), ("-", "operator"), ("2", "number")]),
        ("basic", '10 PRINT "a" \'n\n', [("10 ", "symbol"), ("PRINT", "keyword"), ('"a"', "string"), ("'n", "comment")]),
        ("scss", "$a: 1px;\n.b { color: #fff; &:hover { @include c; } }", [("$a", "variable"), ("1px", "number"), (".b", "selector-class"), ("color", "attribute"), ("#fff", "number"), ("&", "selector-tag"), (":hover", "selector-pseudo"), ("@include", "keyword")]),
        ("stylus", "$a = 1px\n.b\n  color #fff\n", [("$a", "variable"), ("1px", "number"), (".b", "selector-class"), ("color", "attribute"), ("#fff", "number")]),
        ("lua", "local x = 1 -- n", [("local", "keyword"), ("1", "number"), ("-- n", "comment")]),
    ],
)
def test_languages_without_golden_pairs(name, text, want):
    found = [(text[t.start : t.start + t.length], t.scopes[-1]) for t in shared().highlight(text, name).tokens]
    assert [f for f in found if f in want] == want


def test_json_slice():
    r = shared().highlight('{"k": 69}', "json")
    assert spans(r) == [(0, 1, ("punctuation",)), (1, 3, ("attr",)), (4, 1, ("punctuation",)), (6, 2, ("number",)), (8, 1, ("punctuation",))]
    assert r.relevance == pytest.approx(1.01)


@pytest.mark.parametrize("name", sorted(FACTORIES))
def test_all_text_is_covered_once(name):
    text = "a 'b' \"c\" # d\n<x y='z'>{1: [2]}</x> 😀 $e = f(g) // h\n"
    r = shared().highlight(text, name)
    ends = 0
    for t in r.tokens:
        assert t.start >= ends and t.length > 0 and t.scopes
        ends = t.start + t.length
    assert ends <= r.source_length == len(text) + 1


def test_utf16_offsets():
    assert spans(of(Mode(contains=[Mode(scope="number", match=r"\d+")])).highlight("x😀é 20中0", "x")) == [(5, 2, ("number",)), (8, 1, ("number",))]


def test_keyword_hits_saturate_and_hidden_scopes_count():
    h = of(Mode(keywords=words("go|2", _hidden="dark")))
    assert h.highlight("go " * 9, "x").relevance == 14
    r = h.highlight("dark", "x")
    assert r.relevance == 1 and not r.tokens


def test_illegal():
    h = of(Mode(illegal="!", keywords=words("a")))
    assert h.highlight("a ! a", "x", ignore_illegals=False).illegal
    assert len(h.highlight("a ! a", "x").tokens) == 2


def test_compiler_rejects():
    for mode in (Mode(contains=[Mode(match="a", begin="b")]), Mode(contains=[SELF]), Mode(contains=[Mode(begin="a", scope={1: "b"})]), Mode(contains=[Mode(begin="(")])):
        with pytest.raises(GrammarError):
            of(mode).highlight("a", "x")


def test_end_same_as_begin_and_parts():
    h = of(Mode(contains=[Mode(scope="string", begin=r"<(\w)", end=r"(\w)>", end_same_as_begin=True), Mode(match=(r"(d)ef", r"\s+", r"\w+"), scope={1: "keyword", 3: "title"})]))
    assert spans(h.highlight("<a b> a>", "x")) == [(0, 8, ("string",))]
    assert spans(h.highlight("def  f", "x")) == [(0, 3, ("keyword",)), (5, 1, ("title",))]


def test_veto_after_a_dot_and_zero_width_rules_end():
    h = of(Mode(contains=[Mode(scope="k", begin_keywords="for"), Mode(begin="(?=z)", end="(?=z)")]))
    assert [t.start for t in h.highlight("x.for for zz", "x").tokens] == [6]


def test_detection():
    h = Highlighter({"a": lambda: Language("a", Mode(keywords=words("one"))), "b": lambda: Language("b", Mode(keywords=words("one")), superset_of="c"), "c": lambda: Language("c", Mode(keywords=words("one")))})
    r = h.detect("one", ["b", "c"])
    assert (r.language, r.second) == ("c", ("b", 1.0))
    assert h.detect("nothing").language is None
    assert h.detect("one", ["missing", "a"]).second is None


def test_registry_moves_aliases():
    h = Highlighter({"a": lambda: Language("a", Mode(), ("n",)), "b": lambda: Language("b", Mode(), ("n",))})
    assert h.resolve("N") == "b"
    h.register("a", lambda: Language("a", Mode(), ("m",)))
    assert (h.resolve("n"), h.resolve("m")) == ("b", "a")
    with pytest.raises(UnknownLanguage):
        h.highlight("", "zzz")


def test_runs_without_a_match_are_passed_over():
    plain = re.compile(r"(?:[a-z]+ )+[a-z]+\(")
    runs = Runs(plain, re.compile(r"(?:[a-z]+ )+"))
    for text in ("a b c(", "a b. c d(", "a b", "", "x y, z w(q e(", "a  b(c d("):
        for at in range(len(text) + 1):
            a, b = plain.search(text, at), runs.search(text, at)
            assert (a and a.span()) == (b and b.span())
    assert runs.search("ab " * 20000, 0) is None


@pytest.mark.parametrize("pattern, is_word", [(r"[a-z]\w*(?=:)", True), (r"([a-z_]\w*)(\s*)(=)", True), (r"\w+!", True), (r"[a-z]{2,}\d", True), (r"[a-z][a-z0-9]*!?:", True), (r"[a-z][0-9]*x", False), (r"\b[a-z]+:", False), (r"(\w+) \1", False), (r"a|b+", False), (r" +x", False), (r"[a-z]\w*|:", False)])
def test_words_are_found_where_the_pattern_finds_them(pattern, is_word):
    import itertools

    plain, word = re.compile(pattern), by_word(re.compile(pattern))
    assert isinstance(word, Runs) == is_word
    for text in map("".join, itertools.product("a1: !", repeat=5)):
        for at in range(len(text) + 2):
            x, y = plain.search(text, at), word.search(text, at)
            assert (x and x.span()) == (y and y.span()), (text, at)


def test_long_names_take_linear_time():
    import time

    for name in ("javascript", "ruby", "nix", "bash", "elixir"):
        began = time.perf_counter()
        shared().highlight("aB3x" * 25_000, name)
        assert time.perf_counter() - began < 3


def test_emitter_merges():
    e = Emitter()
    e.text(2, "a")
    e.text(3, "a")
    e.text(1)
    e.text(1, "a")
    assert [(t.start, t.length) for t in e.tokens] == [(0, 5), (6, 1)]


def test_lines_go_on_from_a_state():
    h, state, n = shared(), None, 0
    for line in split("a = '''\nx\n'''\nb = 1\n"):
        r = h.highlight(line, "python", state=state)
        state, n = r.state, n + sum(t.length for t in r.tokens if t.scopes == ("string",))
    assert n == 9


def test_document_edits_equal_a_fresh_parse():
    text = "".join(f"x{i} = {i}  # n\n" for i in range(200))
    doc = Document.of(text, "python")
    for start, length, new in ((5, 1, "77"), (900, 0, "'''"), (900, 3, ""), (0, 10, ""), (1000, 0, "y = 1\n" * 32)):
        before = "".join(doc.lines)
        doc.replace(start, length, new)
        fresh = Document.of(before[:start] + new + before[start + length :], "python")
        assert doc.lines == fresh.lines and [spans_of(t) for t in doc.tokens] == [spans_of(t) for t in fresh.tokens]
    doc.replace(0, 1, "z")
    assert doc.reparsed < len(doc.lines)
    with pytest.raises(ValueError):
        doc.replace(10**6, 1, "")
    tokens, more = doc.snapshot(0, 40, 2)
    assert len(tokens) == 2 and more > 0


def spans_of(tokens):
    return [(t.start, t.length, t.scopes) for t in tokens]
