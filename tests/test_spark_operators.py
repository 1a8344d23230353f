"""The DataFrame operators of the engine on small frames: registries on workers, continuation, styles, cache, documents, streams."""

import pytest
from pyspark.sql import functions as F

from scopeframe.functions.text import lines
from scopeframe.grammar.engine import Cancelled, Highlighter, shared, unpacked
from scopeframe.grammar.model import GrammarError, Hints, Language, Mode, UnknownLanguage, words
from scopeframe.operators import cache, highlight, languages, styles
from scopeframe.sources.session import prepare
from scopeframe.streaming import document


def greeting():
    return Highlighter({"greeting": lambda: Language("greeting", Mode(keywords=words("hello world")), ("hi",)), "bad": lambda: Language("bad", Mode(contains=[Mode(begin="(")]))})


def test_registries_travel_to_tasks(spark):
    df = prepare(spark).createDataFrame([(1, "hello you", "HI"), (2, "x", "nonesuch"), (3, "x", "bad"), (4, None, "hi"), (5, "hello", None)], "i int, text string, lang string").repartition(3)
    got = {r.i: r.result for r in highlight.highlight(df, "text", F.col("lang"), registry=greeting()).collect()}
    assert [(t.start, t.length, t.scopes) for t in got[1].tokens] == [(0, 5, ["keyword"])]
    assert got[2].error == "unknown language nonesuch" and got[3].error.startswith("invalid grammar") and got[4].tokens == [] and got[5].language is None
    assert highlight.highlight(df, "text", "json").where("result.error is not null").count() == 0
    with pytest.raises(UnknownLanguage):
        highlight.highlight(df, "text", "nonesuch")
    best = df.select("i", highlight.detected(F.col("text"), registry=Highlighter({"greeting": lambda: greeting().languages["greeting"]})).alias("b")).collect()
    assert {r.i: r.b.language for r in best} == {1: "greeting", 2: None, 3: None, 4: None, 5: "greeting"}


def test_a_registry_is_the_same_after_its_journey():
    own = greeting()
    own.register("greeting", lambda: Language("greeting", Mode(keywords=words("bye")), ("ciao",)))
    there = unpacked(own.packed())
    assert (there.identity, there.revision, there.names, there.generations) == (own.identity, own.revision, own.names, own.generations)
    assert len(there.highlight("bye hello", "ciao").tokens) == 1 and unpacked(None) is shared() and shared().packed() is None


def test_registry_refuses_to_compile_inside_a_factory_and_keeps_failures():
    own = greeting()
    with pytest.raises(GrammarError):
        own.register("x", lambda: own.grammar("greeting") and Language("x", Mode()))
    for _ in range(2):
        with pytest.raises(GrammarError):
            own.highlight("x", "bad")
    own.register("bad", lambda: Language("bad", Mode()))
    assert own.highlight("x", "bad").tokens == []


def test_states_belong_to_a_generation():
    own = Highlighter({"x": lambda: Language("x", Mode(contains=[Mode(scope="s", begin="<", end=">")]))})
    state = own.highlight("a <", "x").state
    assert len(own.highlight("b > c", "x", state=state).tokens) == 1
    own.register("x", lambda: own.languages["x"])
    assert own.highlight("b > c", "x", state=state).tokens == []
    with pytest.raises(Cancelled):
        own.highlight("a" * 10, "x", cancelled=lambda: True)


def test_embedded_states_end_with_their_host():
    own = Highlighter({"in": lambda: Language("in", Mode(contains=[Mode(scope="s", begin="'", end="'")])), "out": lambda: Language("out", Mode(contains=[Mode(begin="<", end=">", sub_language="in")]))})
    first = own.highlight("<'a> <", "out")
    again = own.highlight("b' c>", "out", state=own.highlight("<'a", "out").state)
    assert [(t.start, t.length) for t in again.tokens] == [(0, 2)]
    assert own.highlight("<'a>", "out").state[3] == () and first.state[3] != ()


def test_beginnings_tell_ends():
    tag = Mode(scope="s", begin=r"<(\w+)", end=r"/(\w+)>", on_begin=lambda m, data: data.update(name=m[1]), on_end=lambda m, data: m[1] != data["name"])
    own = Highlighter({"x": lambda: Language("x", Mode(contains=[tag]))})
    assert [(t.start, t.length) for t in own.highlight("<ab /c> /ab> z", "x").tokens] == [(0, 12)]


def test_resolution(spark):
    own = Highlighter({})
    own.register("first", lambda: Language("first", Mode()), Hints.of("custom"))
    df = prepare(spark).createDataFrame([("x.custom", "t", "/usr/bin/ruby")], "path string, text string, by string")
    assert languages.resolve(df, F.col("path"), F.col("text"), registry=own).first().language == "first"
    own.register("second", lambda: Language("second", Mode()), Hints.of("custom"))
    r = languages.resolve(df, F.col("path"), F.col("text"), registry=own).first()
    assert (r.language, r.candidates) == (None, ["first", "second"])
    assert languages.resolve(df, F.lit("x"), F.col("text"), run_by=F.col("by")).first().language == "ruby"
    with pytest.raises(UnknownLanguage):
        languages.resolve(df, F.col("path"), override="nonesuch")


def test_chunks_go_on(spark):
    df = prepare(spark).createDataFrame([(k, i, t) for k in (1, 2, None) for i, t in enumerate(["a = '''\n", "x\n", "'''\n", "b = 1\n", None])], "k int, i int, text string").repartition(4)
    got = {(r.k, r.i): r.result for r in highlight.follow(df, "k", "i", "text", "python").collect()}
    assert all([t.scopes for t in got[k, 1].tokens] == [["string"]] and [t.scopes for t in got[k, 3].tokens] == [["number"]] for k in (1, 2, None))
    first = highlight.highlight(df.where("k = 1 and i = 0"), "text", "python", keep_state=True).select(F.lit("x\n").alias("text"), "result.state")
    on = highlight.highlight(first, "text", "python", state=F.col("state")).first().result
    assert [t.scopes for t in on.tokens] == [["string"]]
    assert highlight.highlight(first, "text", "ruby", state=F.col("state")).first().result.tokens == []


def test_render(spark):
    theme = styles.Theme(styles.Style("#000"), styles.Style("#fff"), {"keyword": styles.Style("red", bold=True), "literal": styles.Style("red", bold=True), "em": styles.Style(italic=True)})
    rows = [
        (1, [(0, 2, ["keyword"]), (2, 2, ["literal.x"]), (4, 1, ["none"]), (5, 2, ["em"])], 7, 7, None),
        (2, [(0, 4, ["keyword"])], 4, 3, None),
        (3, [(0, 4, ["a", "keyword", "none"])], 4, 20, [(1, 10, 2), (0, 0, 1)]),
        (4, [(0, 4, ["keyword"])], 4, 5, [(0, 4, 2)]),
        (5, [], 0, 9, None),
    ]
    df = prepare(spark).createDataFrame(rows, "k int, tokens array<struct<start:int,length:int,scopes:array<string>>>, source_length int, target int, mappings array<struct<src_start:int,dst_start:int,length:int>>")
    plain = styles.render(df, "k", theme, target_length="target", most_runs=1).where("error is null")
    got = sorted((r.k, r.start, r.length, r.color, r.bold, r.italic, r.applied) for r in plain.collect())
    assert got == [(1, 0, 4, "red", True, False, True), (1, 5, 2, None, False, True, False), (2, 0, 3, "red", True, False, True), (3, 0, 4, "red", True, False, True), (4, 0, 4, "red", True, False, True)]
    mapped = styles.render(df.where("mappings is not null"), "k", theme, target_length="target", mappings="mappings", traits=False).collect()
    assert sorted((r.k, r.start, r.length, r.bold) for r in mapped if r.error is None) == [(3, 0, 1, False), (3, 10, 2, False)]
    assert [r.k for r in mapped if r.error] == [4]
    assert {tuple(r) for r in styles.run_summary(plain, "k").collect()} == {(1, 1, 1), (2, 1, 0), (3, 1, 0), (4, 1, 0)}


def test_attributed_parts_are_the_text(spark):
    texts = ["let x = \"😀\" // é\n", "", None, "plain"]
    df = highlight.highlight(prepare(spark).createDataFrame(list(enumerate(texts)), "k int, text string"), "text", "swift").select("k", "text", "result.tokens", "result.source_length")
    parts = sorted(styles.attributed(df, "k", "text", styles.named("GitHub")).collect())
    for k, t in enumerate(texts):
        assert "".join(r.part for r in parts if r.k == k) == (t or "")
    assert any(r.dark_color for r in parts) and styles.named("nonesuch") is None and len(styles.THEMES) == 6


def test_attributed_works_in_the_row(spark):
    texts = ["# a\n# b\n'x' 'y''z'\n" * 50, '{"k": 1}', "", None, "def f(a=1): return a  # 😀\n", "x"]
    df = highlight.highlight(prepare(spark).createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), "text", "python").select("k", "text", "result.tokens", "result.source_length")
    # touching tokens of one style, equal keys, tokens past the text and no tokens at all
    own = spark.createDataFrame([(9, "abcdef", [(0, 2, ["string"]), (2, 1, ["string"]), (3, 0, ["number"]), (4, 9, ["string"])], 6), (9, "ab", None, 0), (8, "ab", [], 2)], f"k int, text string, tokens {highlight.TOKENS}, source_length int")
    parts = styles.attributed(df.unionAll(own), "k", "text", styles.named("github"))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted(tuple(r)[:3] for r in parts.where("k > 7").collect())
    assert got == [(8, 0, 2), (9, 0, 2), (9, 0, 3), (9, 3, 1), (9, 4, 2)]
    names = ("k", "start", "length", "color", "dark_color", "bold", "italic")
    runs = {tuple(r) for r in styles.render(df, "k", styles.named("github")).select(*names).collect()}
    rows = parts.where("k < 7").orderBy("k", "start").collect()
    assert runs and runs <= {tuple(r[c] for c in names) for r in rows}
    assert ["".join(r.part for r in rows if r.k == k) for k in range(len(texts))] == [t or "" for t in texts]


def test_cache_keys_and_policy(spark):
    same = prepare(spark).range(1).select(*[cache.request_key(F.lit("n"), F.lit("v"), cache.selection_identity(s), F.lit(3), ignore) for s, ignore in (("js", True), ("javascript", True), ("javascript", False), (None, True), ("plain", True))]).first()
    assert same[0] == same[1] and len(set(same)) == 4
    df = spark.createDataFrame([("n", "a", "let x"), ("n", "a", "let x"), ("m", "a", "let x"), ("n", None, "let y")], "ns string, v string, text string")
    answers, store, counts = highlight.cached(df, None, "text", "js", "ns", "v")
    assert answers.count() == 4 and store.count() == 2
    assert {tuple(r) for r in counts.collect()} == {("n", 1, 1, 1, 1), ("m", 0, 1, 0, 1)}
    cut, after, counts = highlight.cached(df, store, "text", "javascript", "ns", "v", most_tokens=0)
    assert {(len(r.result.tokens), r.omitted) for r in cut.collect()} == {(0, 1)} and after.count() == 2
    assert {tuple(r) for r in counts.collect()} == {("n", 2, 0, 1, 0), ("m", 1, 0, 0, 0)}
    _, after, counts = highlight.cached(df, None, "text", "js", "ns", "v", most_tokens=1)
    assert after.count() == 0 and {tuple(r) for r in counts.collect()} == {("n", 1, 1, 2, 0), ("m", 0, 1, 1, 0)}


def test_cache_replay(spark):
    log = [
        (1, "request", "a", 10, True, False, 1), (2, "request", "a", 10, True, False, 1), (3, "request", "a", 10, True, False, 2), (4, "request", "b", 10, True, True, 3), (5, "request", "b", 10, True, False, 4),
        (6, "request", "c", 10, False, False, 5), (7, "unknown", "u", 0, None, None, 6), (8, "unknown", "u", 0, None, None, 7), (9, "unkeyed", None, 0, None, None, 8), (10, "request", "a", 10, True, False, 9),
        (11, "request", "d", 10, True, False, 10), (12, "request", "b", 10, True, False, 11), (13, "request", "huge", 1000, True, False, 12),
    ]
    schema = "o int, kind string, key string, cost long, whole boolean, budgeted boolean, batch long"
    df = prepare(spark).createDataFrame([("x", *r) for r in log] + [("y", 0, "purge", None, None, None, None, None)], "ns string, " + schema).repartition(3)
    got = {r.ns: r.asDict() for r in cache.replay(df, "ns", "o", 25).collect()}
    # d pushes b out, b pushes u and a out; c is cut and huge too large
    assert got["x"] == {"ns": "x", "hits": 2, "misses": 8, "coalesced": 1, "negative_hits": 1, "bypasses": 2, "insertions": 5, "evictions": 3, "purges": 0, "entries": 2, "total_cost": 20}
    assert got["y"]["purges"] == 1 and got["y"]["entries"] == 0
    assert cache.replay(df.where("false"), "ns", "o", 25).count() == 0


def test_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\n\nd", "\r", "\n\r", "x\r\n"]
    got = prepare(spark).createDataFrame([(t,) for t in texts], "t string").select("t", lines(F.col("t")).alias("l")).collect()
    assert all(r.l == document.split(r.t) for r in got)


def test_edits_merge_line_ends():
    doc = document.Document.of("a\rb\nc\n", "python")
    for start, length, new in ((2, 0, "\n"), (2, 1, ""), (3, 1, ""), (0, 5, "x\r"), (2, 0, "\ny😀"), (4, 2, "z"), (0, 0, "\n" * 70), (71, 1, "'''\n")):
        before = "".join(doc.lines).encode("utf-16-le")
        doc.replace(start, length, new)
        fresh = document.Document.of((before[: 2 * start] + new.encode("utf-16-le") + before[2 * (start + length) :]).decode("utf-16-le"), "python")
        assert doc.lines == fresh.lines and [[(t.start, t.length, t.scopes) for t in x] for x in doc.tokens] == [[(t.start, t.length, t.scopes) for t in x] for x in fresh.tokens]
    doc = document.Document.of("a😀b", "python")
    with pytest.raises(ValueError):
        doc.replace(2, 1, "")
    assert doc.lines == ["a😀b"] and document.Document.of("{}", None, detect=True).language in (None, "json")


def test_an_edit_is_at_its_start_whatever_it_puts_there():
    doc = document.Document.of("same\nend\n", "markdown")
    # put before an equal line; the same text again; a line end that merges with the one before; the end of the text
    assert [doc.replace(*e) for e in ((0, 0, "same\n"), (0, 4, "same"), (5, 5, "same\nnew\n"), (18, 0, "x"))] == [0, 0, 1, 4]
    assert doc.lines == ["same\n", "same\n", "new\n", "end\n", "x"]
    doc = document.Document.of("a\rb", "markdown")
    assert doc.replace(2, 0, "\n") == 0


def test_edits_and_streams_report_alike(spark, tmp_path):
    text = "".join(f"x{i} = {i}\n" for i in range(100))
    rows = [(k, 0, 0, 0, text) for k in (1, 2)] + [(1, 1, 5, 0, "7"), (1, 2, 0, 10**6, ""), (2, 1, 0, 0, "'''"), (2, 2, 0, 3, ""), (2, 3, 300, 1, "\n")]
    schema = "k int, edit_seq int, start int, length int, replacement string"
    prepare(spark)
    batch = sorted(tuple(r) for r in document.edits(spark.createDataFrame(rows, schema).repartition(3), "k", "python").collect())
    assert batch[1][4] <= 64 and batch[2][-1] == "no range 0+1000000"
    for n, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    query = document.stream_edits(stream, "k", "python").writeStream.format("memory").queryName("edited").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("edited").collect()) == batch


def test_snapshots(spark):
    df = highlight.highlight(prepare(spark).createDataFrame([(0, 3), (2, 100)], "a int, n int").withColumn("text", F.lit('{"k": 69}')), "text", "json")
    got = [([(t.start, t.length) for t in r.snapshot], r.left_out) for r in document.snapshots(df, F.col("a"), F.col("n"), 2).orderBy("a").collect()]
    assert got == [([(0, 1), (1, 2)], 0), ([(0, 2), (2, 1)], 2)]
