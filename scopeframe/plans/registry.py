"""The queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import interpreter, lines, shebang, utf16_length
from ..grammar.engine import shared
from ..grammar.languages import HINTS
from ..operators import cache, highlight, languages, ranges, styles
from ..sources.session import prepare, table
from ..streaming import document

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text_of(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else repr(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """A named table of fixed rows, for SQL."""
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(text_of, r)) + ")" for r in rows) + ")"


#: Letters, marks, digits and underscore, in words that both engines of regular expressions read alike.
WORD = r"\p{L}\p{M}\p{N}_"


def spelled(pattern: str) -> str | None:
    """A pattern of keywords that Spark and SQL read alike; none if it looks around itself."""
    plain = pattern.removesuffix(r"|\.(?!\d)")  # a lone dot is no keyword
    if r"\b" in plain or "(?!" in plain:
        return None
    inside = re.sub(r"\[((?:\\.|[^\]])*)\]", lambda m: "[" + m[1].replace(r"\w", WORD) + "]", plain)
    return inside.replace(r"\w", f"[{WORD}]")


#: Ways to read words: (pattern, whether letter case matters not).  All bundled languages that take part in detection and have outermost
#: keywords are scored, but bash, fortran, powershell, sql and swift, whose words end by a look around.
_SCORED = {n: (spelled(x.root.keywords.pattern), x.case_insensitive) for n, x in sorted(shared().languages.items()) if x.root.keywords and x.detectable and spelled(x.root.keywords.pattern)}
WAYS = sorted(set(_SCORED.values()))


def keyword_rows() -> list[tuple]:
    """(way, language, word, scope, relevance)"""
    return [(WAYS.index(way), n, w, s, r) for n, way in _SCORED.items() for w, (s, r) in sorted({(w.lower() if way[1] else w): (s, r) for w, s, r in shared().languages[n].root.keywords.pairs()}.items())]


NAMES = sorted(shared().names.items())
EXTENSIONS = ["py", "PY", "tar.yml", "h", "properties", "json", "html", "d.ts", "md", "pro"]

# tokens of real texts


@query(r"""
select scope, sum(n) as n from (
  select unnest(['punctuation', 'attr', 'number']) as scope, unnest([length(regexp_replace(props, '[^{}:,\[\]]', '', 'g')), len(regexp_extract_all(props, '"[^"]*"\s*:')), len(regexp_extract_all(props, ':\s*-?[0-9.]+'))]) as n from events)
group by scope having sum(n) > 0""")
def json_token_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of events.props as JSON, counted by scope; equal props are tokenised once."""
    props = table(spark, sf_dir, "events").groupBy("props").agg(F.count(F.lit(1)).alias("times"))
    made = highlight.highlight(props, "props", "json")
    return made.select("times", F.explode("result.tokens").alias("t")).groupBy(F.element_at("t.scopes", -1).alias("scope")).agg(F.sum("times").alias("n"))


@query()
def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of web pages (tags, attributes, embedded styles and scripts), counted by page and scope."""
    made = highlight.highlight(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "xml")
    return highlight.tokens(made, "page_id").groupBy("page_id", "scope").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("units"))


# what is left of a page without comments and what stands in scripts and styles
_MARKUP = r"""regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(script|style)[^>]*>).*?</(script|style)>', '\1</\2>', 'gs')"""


@query(rf"""select page_id, name, count(*) as n from (select page_id, unnest(regexp_extract_all({_MARKUP}, '</?([A-Za-z][A-Za-z0-9]*)', 1)) as name from pages) group by all""")
def html_tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of tags of web pages, cut out of the text by the tokens' UTF-16 offsets."""
    made = highlight.highlight(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "xml")
    names = made.select("page_id", "html", F.explode("result.tokens").alias("t")).where(F.element_at("t.scopes", -1) == "name")
    return names.select("page_id", styles.utf16_slice(F.col("html"), F.col("t.start"), F.col("t.length")).alias("name")).groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""select page_id, len(regexp_extract_all({_MARKUP}, '\s[a-z]+="[^"]*"')) as attributes, len(regexp_extract_all(html, '(?s)<!--.*?-->')) as comments, len(regexp_extract_all({_MARKUP}, '(?:&[a-z]+;)+')) as symbols from pages""")
def html_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes, comments and character references of web pages."""
    made = highlight.highlight(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "xml")
    having = lambda scope: F.size(F.filter("result.tokens", lambda t: t["scopes"] == F.array(*map(F.lit, scope)))).cast("long")
    return made.select("page_id", having(["tag", "attr"]).alias("attributes"), having(["comment"]).alias("comments"), having(["symbol"]).alias("symbols"))


@query()
def detect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of conversation texts, among all that take part; equal texts are tried once."""
    prepare(spark)
    texts = table(spark, sf_dir, "conversations").select("text").distinct()
    return texts.withColumn("best", highlight.detected(F.col("text"))).select(F.sha2("text", 256).alias("text_sha256"), "best.*")


_TOKENS = r"""len(regexp_extract_all(props, '[{}\[\],:]+|"[^"]*"|-?[0-9][0-9.]*'))"""


@query(f"select event_id, least({_TOKENS}, 3) as kept, greatest({_TOKENS} - 3, 0) as omitted, length(props) as source_length from events")
def budgeted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = highlight.highlight(table(spark, sf_dir, "events").select("event_id", "props"), "props", "json", most_tokens=3)
    return made.select("event_id", F.size("result.tokens").cast("long").alias("kept"), F.col("omitted").cast("long").alias("omitted"), F.col("result.source_length").cast("long").alias("source_length"))


# scores and ranking


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, language, word, scope, relevance): a row for each keyword in a text.  The table of keywords is fixed and small, so words that are
    none go before anything is shuffled."""
    prepare(spark)
    reads = [F.struct(F.lit(k).alias("way"), F.regexp_extract_all(F.lower("text") if ci else F.col("text"), F.lit(p), F.lit(0)).alias("words")) for k, (p, ci) in enumerate(WAYS)]
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*reads)).alias("r")).select("doc_id", "r.way", F.explode("r.words").alias("word"))
    known = spark.createDataFrame(keyword_rows(), "way int, language string, word string, scope string, relevance double")
    return words.join(F.broadcast(known), ["way", "word"])


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, language, relevance): sum over words of relevance times occurrences, seven at most."""
    counted = keyword_hits(spark, sf_dir).groupBy("doc_id", "language", "word", "relevance").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("doc_id", "language").agg(F.sum(F.least(F.col("n"), F.lit(7)) * F.col("relevance")).alias("relevance"))


_KEYWORDS = values("kw", "way, language, word, scope, relevance", keyword_rows())
_HITS = f"""with {_KEYWORDS},
words as ({" union all ".join(f"select doc_id, {k} as way, unnest(regexp_extract_all({'lower(text)' if ci else 'text'}, {text_of(p)})) as word from documents" for k, (p, ci) in enumerate(WAYS))}),
hits as (select doc_id, language, word, scope, relevance from words join kw using (way, word))"""
_SCORES = f"""{_HITS},
counted as (select doc_id, language, word, relevance, count(*) as n from hits group by all),
scores as (select doc_id, language, cast(sum(least(n, 7) * relevance) as double) as relevance from counted group by all)"""
_RANKED = rf"""{_SCORES},
tried as (select doc_id, language, relevance, row_number() over (partition by doc_id order by language) as ord from scores union all select doc_id, null, 0, 0 from documents),
ranked as (select *, row_number() over (partition by doc_id order by relevance desc, ord) as k from tried)"""


@query(f"{_SCORES} select * from scores")
def kw_saturated_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_scores(spark, sf_dir)


@query(f"{_HITS} select language, scope, count(*) as n, count(distinct word) as words from hits group by all")
def kw_scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_hits(spark, sf_dir).groupBy("language", "scope", "word").agg(F.count(F.lit(1)).alias("n")).groupBy("language", "scope").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain reading (relevance 0, first of equals) and the scored languages, ranked by document."""
    scores = keyword_scores(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("language")))
    plain = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("relevance"), F.lit(0).alias("ord"))
    return scores.unionByName(plain).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("relevance"), "ord")))


@query(f"{_RANKED} select doc_id, language, relevance from ranked where k = 1")
def detect_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).where("k = 1").select("doc_id", "language", "relevance")


@query(f"{_RANKED} select doc_id, language, relevance from ranked where k = 2 and language is not null")
def detect_second_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).where("k = 2 and language is not null").select("doc_id", "language", "relevance")


# registry and resolution


@query("select * from (values " + ", ".join(f"({text_of(n)}, {text_of(x.case_insensitive)}, {text_of(x.detectable)})" for n, x in sorted(shared().languages.items())) + ") t(name, case_insensitive, detectable)")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(prepare(spark)).orderBy("name")


_ASKED = [a.upper() if i % 2 else a for i, (a, _) in enumerate(NAMES)] + ["nonesuch", ""]


@query(f"with {values('a', 'i, asked', enumerate(_ASKED))}, {values('n', 'alias, name', NAMES)} select p_partkey, asked, name as language from part join a on p_partkey % {len(_ASKED)} = i left join n on lower(asked) = alias")
def lang_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(*[F.lit(a) for a in _ASKED])
    parts = table(spark, sf_dir, "part").select("p_partkey", F.element_at(asked, (F.col("p_partkey") % len(_ASKED) + 1).cast("int")).alias("asked"))
    return languages.look_up(parts, F.col("asked"))


_EXT_ROWS = [(v, n) for n, h in sorted(HINTS.items()) for v in h.extensions]


@query(rf"""with {values('e', 'i, ext', enumerate(EXTENSIONS))}, {values('h', 'value, name', _EXT_ROWS)},
paths as (select p_partkey, 'src/f' || p_partkey || '.' || ext as path, lower('f' || p_partkey || '.' || ext) as base from part join e on p_partkey % {len(EXTENSIONS)} = i),
hit as (select p_partkey, name, dense_rank() over (partition by p_partkey order by length(value) desc) as k from paths join h on base like '%.' || value),
best as (select p_partkey, string_agg(distinct name, ',' order by name) as candidates, count(distinct name) as n, min(name) as one from hit where k = 1 group by 1)
select p_partkey, path, candidates, case when n = 1 then one end as language from paths left join best using (p_partkey)""")
def resolve_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    paths = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/f"), "p_partkey", F.lit("."), ext).alias("path"))
    return languages.resolve(paths, F.col("path")).select("p_partkey", "path", F.array_join("candidates", ",").alias("candidates"), "language")


#: (first line, program, language)
_LINES = [
    ("#!/bin/sh", "sh", "bash"), ("#!/usr/bin/env python3", "python3", "python"), ("#!/usr/bin/env -S python -u", "python", "python"), ("plain text", "", None), ("#!C:\\bin\\NODE.EXE", "node", "javascript"),
    ("#! /usr/bin/ruby -w", "ruby", "ruby"), ("#!/usr/bin/env -u HOME A=1 Rscript", "rscript", "r"), ("#!/usr/bin/env", "", None), ("#!/usr/bin/env -- lua", "lua", "lua"), (" #!/bin/sh", "", None), ("#!/opt/none", "none", None),
]


@query(f"with {values('s', 'i, line, program, language', [(i, *row) for i, row in enumerate(_LINES)])} select p_partkey, program, language from part join s on p_partkey % {len(_LINES)} = i")
def resolve_shebang(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.array(*[F.lit(x) for x, *_ in _LINES]), (F.col("p_partkey") % len(_LINES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("script").alias("path"), F.concat(line, F.lit("\nx = 1\n")).alias("text"))
    return languages.resolve(rows, F.col("path"), F.col("text")).select("p_partkey", interpreter(shebang(F.col("text"))).alias("program"), "language")


#: (path, text, override, language, error)
_FILES = [
    ("Sources/CMakeLists.TXT", "", None, "cmake", None), ("types/index.D.TS", "", None, "typescript", None), ("Main.SWIFT", "", None, "swift", None), ("x.swift", "x", "plain", None, None),
    ("x", "x", "rb", "ruby", None), ("LICENSE.unknown", "x", None, None, None), ("Box.h", "template <class T> class Box { public: T value; };", None, "cpp", None),
    ("App.m", "#import <Foundation/Foundation.h>\n@interface AppDelegate : NSObject\n@end", None, "objectivec", None), ("square.m", "function y = square(x)\ny = x.^2;\nend", None, "matlab", None),
    ("empty.h", "", None, None, None), ("a.py", "x", "nonesuch", None, "unknown language nonesuch"), ("a.py", '{"k": [1, true, null]}', "automatic", "json", None), ("a.xyz", "", "automatic", None, None),
]


@query(f"with {values('s', 'i, path, language, error', [(i, p, x, e) for i, (p, _, _, x, e) in enumerate(_FILES)])} select p_partkey, path, language, error from part join s on p_partkey % {len(_FILES)} = i")
def resolve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By file name, extension, content (where several languages have an extension) and override."""
    at = lambda k: F.element_at(F.array(*[F.lit(row[k]).cast("string") for row in _FILES]), (F.col("p_partkey") % len(_FILES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", at(0).alias("path"), at(1).alias("text"), at(2).alias("override"))
    return languages.resolve(rows, F.col("path"), F.col("text"), F.col("override")).select("p_partkey", "path", "language", "error")


# ranges


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges made of order lines: a line is as long as its quantity and has its flag for scope."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("length"), F.col("l_returnflag").alias("scope"))
    return rows.withColumn("start", F.coalesce(F.sum("length").over(w), F.lit(0))).drop("l_partkey", "l_suppkey", "l_extendedprice")


_RUNS = "runs as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as length, l_returnflag as scope, cast(coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0) as bigint) as start from lineitem)"


@query(f"with {_RUNS} select l_orderkey, l_linenumber, greatest(count(*) over (partition by l_orderkey) - 3, 0) as omitted from runs qualify row_number() over (partition by l_orderkey order by l_linenumber) <= 3")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.budget(runs(spark, sf_dir), "l_orderkey", "l_linenumber", 3).where("kept").select("l_orderkey", "l_linenumber", "omitted")


@query(f"""with {_RUNS}, marked as (select *, case when lag(start + length) over w = start and lag(scope) over w is not distinct from scope then 0 else 1 end as new from runs window w as (partition by l_orderkey order by start, length)),
islands as (select *, sum(new) over (partition by l_orderkey order by start, length rows unbounded preceding) as island from marked)
select l_orderkey, min(start) as start, cast(sum(length) as bigint) as length, min(scope) as scope, count(*) as runs from islands group by l_orderkey, island""")
def merge_adjacent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.merge_runs(runs(spark, sf_dir), "l_orderkey")


@query(f"with {_RUNS} select l_orderkey, l_linenumber, scope, greatest(start, 10) - 10 as start, least(start + length, 60) - greatest(start, 10) as length from runs where least(start + length, 60) > greatest(start, 10)")
def clip_rebase_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.clip(runs(spark, sf_dir), F.lit(10).cast("long"), F.lit(50).cast("long"))


_MAPS = [(0, 0, 100, 20), (0, 30, 150, 15), (1, 5, 0, 40)]


@query(f"""with {_RUNS}, {values('m', 'odd, src, dst, size', _MAPS)}, o as (select o_orderkey, src, dst, size from orders join m on o_orderkey % 2 = odd)
select l_orderkey, l_linenumber, scope, greatest(start, src) - src + dst as start, least(start + length, src + size) - greatest(start, src) as length from runs join o on l_orderkey = o_orderkey where least(start + length, src + size) > greatest(start, src)""")
def interval_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = prepare(spark).createDataFrame(_MAPS, "odd long, src_start long, dst_start long, size long")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 2).alias("odd")).join(F.broadcast(maps), "odd").drop("odd")
    return ranges.overlay(runs(spark, sf_dir), own, "l_orderkey")


# styles

_THEMES = [(t, *r) for t, x in sorted(styles.THEMES.items()) for r in styles.rows_of(x)]
_THEME_ROWS = values("t", "theme, scope, color, dark_color, bold, italic", _THEMES)
_STACKS = ["title.class.inherited", "string", "subst", "keyword.control", "meta", "title", "variable.language", "comment"]


@query(rf"""with {_THEME_ROWS}, {values('s', 'i, scope', enumerate(_STACKS))},
stack as (select p_partkey, unnest([1, 0]) as depth, unnest([a.scope, b.scope]) as scope from part join s a on p_partkey % 8 = a.i join s b on p_partkey % 7 = b.i),
hit as (select p_partkey, t.*, row_number() over (partition by p_partkey order by depth, length(t.scope) desc) as k from stack join t on theme = 'xcode-light' and (stack.scope = t.scope or stack.scope like t.scope || '.%'))
select p_partkey, scope as style_scope, color, bold, italic from hit where k = 1""")
def style_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = F.array(*[F.lit(s) for s in _STACKS])
    at = lambda n: F.element_at(stack, (F.col("p_partkey") % n + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(at(8), at(7)).alias("scopes"))
    return styles.styled(rows, styles.themes(spark).where("theme = 'xcode-light'").drop("theme"), "p_partkey")


@query(f"with {_THEME_ROWS}, a as (from t where theme = 'xcode-light'), b as (from t where theme = 'github-dark') select coalesce(a.scope, b.scope) as scope, a.color as light_color, b.color as dark_color, coalesce(a.bold, b.bold) as bold, coalesce(a.italic, b.italic) as italic from a full outer join b on a.scope = b.scope")
def adaptive_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = styles.themes(prepare(spark))
    return styles.adaptive(all_.where("theme = 'xcode-light'"), all_.where("theme = 'github-dark'"))


@query(f"with {_THEME_ROWS} select d.theme, d.scope, l.color as color, case when l.color <> d.color then d.color end as dark_color, l.bold, l.italic from (select replace(theme, '-dark', '') as theme, scope, color from t where theme like '%-dark') d join (select replace(theme, '-light', '') as theme, scope, color, bold, italic from t where theme like '%-light') l using (theme, scope)")
def built_in_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The themes that adapt to a light or dark appearance, made of their halves."""
    return styles.themes(prepare(spark)).where("theme in ('github', 'xcode')")


_SCOPES = ["keyword", "title.function.invoke", "nothing", "string", "keyword", "section"]


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts: a line is as long as its quantity, and every other one a token."""
    scope = F.element_at(F.array(*map(F.lit, _SCOPES)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    lines_ = runs(spark, sf_dir).withColumn("s", F.when(F.col("scope") == "N", F.array(F.lit("string"), scope)).otherwise(F.array(scope)))
    token = F.struct("l_linenumber", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"), F.col("s").alias("scopes"))
    grouped = lines_.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(token)).alias("t"), F.sum("length").cast("int").alias("source_length"))
    maps = F.when(F.col("l_orderkey") % 2 == 0, F.array(*[F.struct(F.lit(a).alias("src_start"), F.lit(b).alias("dst_start"), F.when(F.col("l_orderkey") % 10 == 0, 10**6).otherwise(F.least(F.lit(n), F.col("source_length") - a)).alias("length")) for a, b, n in ((0, 100, 20), (10, 0, 30))])).otherwise(F.array(F.struct(F.lit(0).alias("src_start"), F.lit(0).alias("dst_start"), F.col("source_length").alias("length"))))
    return grouped.where("source_length > 10").withColumn("tokens", F.transform("t", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), t["scopes"].alias("scopes")))).withColumn("mappings", maps.cast(styles.MAPPINGS)).withColumn("target", F.col("source_length") + 200)


_STYLED = f"""with {_THEME_ROWS}, {_RUNS}, {values('c', 'i, scope', enumerate(_SCOPES))},
tok as (select r.l_orderkey, r.l_linenumber, r.start, r.length, r.scope as flag, c.scope as own, sum(r.length) over (partition by r.l_orderkey) as n from runs r join c on r.l_linenumber % 6 = c.i),
cand as (select tok.*, t.*, row_number() over (partition by l_orderkey, l_linenumber, start order by case when tok.own = t.scope or tok.own like t.scope || '.%' then 0 else 1 end, length(t.scope) desc) as pick
  from tok join t on theme = 'xcode-dark' and (tok.own = t.scope or tok.own like t.scope || '.%' or (flag = 'N' and t.scope = 'string')) where n > 10 and l_orderkey % 10 <> 0),
m as (select l_orderkey, l_linenumber, start as o, start, length, color, bold, italic, unnest(case when l_orderkey % 2 = 0 then [{{'k': 0, 's': 0, 'd': 100, 'z': least(20, n)}}, {{'k': 1, 's': 10, 'd': 0, 'z': least(30, n - 10)}}] else [{{'k': 0, 's': 0, 'd': 0, 'z': n}}] end) as m from cand where pick = 1),
cut as (select l_orderkey, l_linenumber, o, m.k as k, greatest(start, m.s) - m.s + m.d as start, least(start + length, m.s + m.z) - greatest(start, m.s) as length, color, bold, italic from m where least(start + length, m.s + m.z) > greatest(start, m.s)),
marked as (select *, case when lag(start + length) over w = start and lag(color || bold || italic) over w = color || bold || italic then 0 else 1 end as new from cut window w as (partition by l_orderkey order by l_linenumber, o, k)),
island as (select *, sum(new) over (partition by l_orderkey order by l_linenumber, o, k rows unbounded preceding) as island from marked),
run as (select l_orderkey, island, min(start) as start, sum(length) as length, min(color) as color, bool_or(bold) as bold, bool_or(italic) as italic from island group by l_orderkey, island),
numbered as (select *, row_number() over (partition by l_orderkey order by start, island) as run from run)"""


@query(f"""{_STYLED} select l_orderkey, run, start, cast(length as bigint) as length, color, bold, italic, run <= 3 as applied, null as error from numbered
union all select l_orderkey, null, null, null, null, null, null, false, 'invalid range mapping' from runs where l_orderkey % 10 = 0 group by l_orderkey having sum(length) > 10""")
def render_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styled runs under a theme: mapped, clipped, runs of one style that touch as one, the first three applied."""
    made = styles.render(rendered(spark, sf_dir), "l_orderkey", styles.named("Xcode-Dark"), target_length="target", mappings="mappings", most_runs=3)
    return made.select("l_orderkey", F.col("run").cast("long").alias("run"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "color", "bold", "italic", "applied", F.regexp_extract("error", "^[a-z ]*[a-z]", 0).alias("error")).withColumn("error", F.when(F.col("error") != "", F.col("error")))


@query(f"{_STYLED} select l_orderkey, count(*) filter (run <= 3) as applied, count(*) filter (run > 3) as omitted from numbered group by l_orderkey")
def render_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = styles.render(rendered(spark, sf_dir), "l_orderkey", styles.named("xcode-dark"), target_length="target", mappings="mappings", most_runs=3)
    return styles.run_summary(made.where("error is null"), "l_orderkey")


@query(r"""select event_id, start, part, color from (select event_id, props, unnest(range(1, length(props) + 1)) as k from events), lateral (select k - 1 as start, substr(props, k, 1) as part, case when substr(props, k, 1) in ('{', '}', ':') then '#24292e' when substr(props, k, 1) similar to '[0-9]' then '#005cc5' when k in (2, 3, 4) then '#005cc5' else '#24292e' end as color) where part <> ''""")
def attributed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON as styled text, a row a character."""
    made = highlight.highlight(table(spark, sf_dir, "events").select("event_id", "props"), "props", "json").select("event_id", "props", "result.tokens", "result.source_length")
    parts = styles.attributed(made, "event_id", "props", styles.named("github-light"))
    each = parts.select("event_id", "color", F.posexplode(F.split("part", "")).alias("k", "part"), "start")
    return each.select("event_id", (F.col("start") + F.col("k")).cast("long").alias("start"), "part", "color")


# cache


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("ns"), "event_type", "props", cache.key(F.lit("json"), F.col("props"), F.length("props")).alias("key"))


_KEY = "sha256(concat_ws(chr(31), 'json', props, length(props)))"


@query(f"select key, count(*) as n, min(event_id) as first_event from (select event_id, {_KEY} as key from events) group by key")
def cache_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("with r as (select distinct event_type, sha256(concat_ws(chr(31), user_id, props)) as key from events) select distinct key from r where key not in (select key from r where event_type = 'click')")
def cache_miss_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What other events ask for and clicks haven't stored."""
    asked = table(spark, sf_dir, "events").select("event_type", cache.key(F.col("user_id"), F.col("props")).alias("key"))
    return cache.misses(asked, asked.where("event_type = 'click'"), "key").select("key")


@query(f"""with r as (select user_id % 10 as ns, case when event_type = 'error' then null else props end as value, length(props) as n from events),
c as (select ns, value, count(*) as n from r group by all)
select ns, cast(sum(case when value is null then 0 else n - 1 end) as bigint) as hits, count(value) as misses, cast(sum(case when value is null then n else 0 end) as bigint) as bypasses, count(value) as insertions from c group by ns""")
def cache_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests through a store: errors have no key, equal ones of a namespace are tokenised once."""
    asked = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("ns"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"), "props")
    return highlight.cached(asked, None, "props", "json", "ns", "value")[2].select("ns", *[F.col(c).cast("long").alias(c) for c in ("hits", "misses", "bypasses", "insertions")])


@query(f"with r as (select user_id % 10 as ns, {_KEY} as key from events) select ns, count(*) - count(distinct key) as hits, count(distinct key) as misses, count(*) as requests from r group by ns")
def cache_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.metrics(requests(spark, sf_dir), "ns", "key", "event_id")


@query(f"with {_RUNS}, {values('c', 'i, scope', enumerate(_SCOPES))} select l_orderkey, cast(64 + sum(32 + length(c.scope) + case when runs.scope = 'N' then 6 else 0 end) as bigint) as cost from runs join c on l_linenumber % 6 = i group by l_orderkey having sum(length) > 10")
def cache_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir).select("l_orderkey", cache.cost(F.col("tokens")).cast("long").alias("cost"))


_LRU = 20


@query(f"""with r as (select user_id % 10 as ns, event_id, {_KEY} as key, length(props) * 10 as size from events),
seen as (select *, lag(event_id) over (partition by ns, key order by event_id) as before from r),
apart as (select a.ns, a.event_id, a.before, count(distinct b.key) as others from seen a left join r b on a.ns = b.ns and b.event_id > a.before and b.event_id < a.event_id group by all),
counted as (select ns, count(*) filter (before is not null and others < {_LRU}) as hits, count(*) filter (before is null or others >= {_LRU}) as misses from apart group by ns),
latest as (select ns, key, max(event_id) as newest, min(size) as size from r group by all),
held as (select ns, count(*) as entries, sum(size) as total_cost from (select * from latest qualify row_number() over (partition by ns order by newest desc) <= {_LRU}) group by ns)
select ns, hits, misses, misses - entries as evictions, entries, cast(total_cost as bigint) as total_cost from counted join held using (ns)""")
def cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of 20 results a namespace: a request hits if fewer than 20 others came since the one before."""
    return cache.least_recent(requests(spark, sf_dir).withColumn("size", F.length("props") * 10), "ns", "key", "size", "event_id", 1 << 40, _LRU)


@query()
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a cache of bounded cost, with purges, unknown languages, requests without a key and requests that run together."""
    kind = F.expr("CASE WHEN event_id % 97 = 0 THEN 'purge' WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'view' AND value > 30 THEN 'unkeyed' ELSE 'request' END")
    log = requests(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    log = log.select("ns", "event_id", kind.alias("kind"), "key", (F.length("props") * 10).alias("cost"), (F.col("event_id") % 11 != 0).alias("whole"), (F.col("event_id") % 7 == 0).alias("budgeted"), F.floor(F.col("event_id") / 50).alias("batch"))
    return cache.replay(log, "ns", "event_id", 2000)


# lines and documents

@query(r"""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as k, unnest(string_split(text, chr(10))) as line, len(string_split(text, chr(10))) as n from documents),
u as (select doc_id, k, length(line) + length(regexp_replace(line, '[^\x{10000}-\x{10FFFF}]', '', 'g')) + (k < n)::int as units from l)
select doc_id, k - 1 as line_no, cast(coalesce(sum(units) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", cast(units as bigint) as length from u""")
def line_split_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.line_offsets(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"with l as (select doc_id, len(regexp_extract_all(text, '\\n')) + 1 as n from documents) select doc_id, n as lines, (n - 1) // 2 as changed, (n - 1) // 2 // {document.EVERY} * {document.EVERY} as checkpoint from l")
def checkpoint_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last kept state at or before a changed line (the middle one)."""
    n = F.size(lines(F.col("text"))).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", n.alias("lines")).withColumn("changed", F.floor((F.col("lines") - 1) / 2))
    return document.checkpoints(rows, "changed")


@query(r"select doc_id, length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) as units from documents")
def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", utf16_length(F.col("text")).cast("long").alias("units"))


@query(r"select p_partkey, tag from (select p_partkey, unnest(regexp_extract_all(c, '(TODO|FIXME|NOTE|BUG|OPTIMIZE|HACK|XXX):')) as tag from (select p_partkey, case p_partkey % 3 when 0 then 'TODO: ' || p_name when 1 then 'see NOTE: a BUG: ' || p_name else p_name end as c from part))")
def doctag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags in comments of a language."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# TODO: "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("# see NOTE: a BUG: "), "p_name")).otherwise(F.concat(F.lit("# "), "p_name"))
    made = highlight.highlight(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text", "python")
    tags = made.select("p_partkey", "text", F.explode("result.tokens").alias("t")).where(F.element_at("t.scopes", -1) == "doctag")
    return tags.select("p_partkey", styles.utf16_slice(F.col("text"), F.col("t.start"), F.col("t.length")).alias("tag"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: the first turn is the text, each later one is put before it."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("edit_seq"), F.lit(0).alias("start"), F.when(F.col("turn") == 3, 10**9).otherwise(0).alias("length"), F.concat("text", F.lit("\n")).alias("replacement"))


@query(r"""with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k, case when turn = 3 then 0 else len(regexp_extract_all(text, '\n')) + 1 end as n, turn = 3 as bad from conversations)
select conv_id, turn as edit_seq, cast(0 as bigint) as first_line, cast(1 + sum(case when bad and k > 1 then 0 else n end) over (partition by conv_id order by turn) as bigint) as lines, case when bad and k > 1 then 'no range 0+1000000000' end as error from t""")
def document_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits in order; one outside the text is an error and changes nothing."""
    return document.edits(turns(spark, sf_dir), "conv_id", "markdown").select("conv_id", "edit_seq", "first_line", "lines", "error")


@query()
def document_edit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What edits parse again, and the tokens after each; the language is detected once."""
    return document.edits(turns(spark, sf_dir), "conv_id", None).select("conv_id", "edit_seq", "reparsed", "tokens")


@query(r"""with t as (select event_id, event_id % 4 as s, [{'a': 1, 'b': 4}, {'a': 4, 'b': 5}, {'a': 6, 'b': length(props) - 1}, {'a': length(props) - 1, 'b': length(props)}] as tokens from events),
inside as (select event_id, [greatest(x.a, s) - s for x in tokens if least(x.b, s + 6) > greatest(x.a, s)] as starts from t)
select event_id, least(len(starts), 2) as kept, greatest(len(starts) - 2, 0) as left_out, array_to_string(starts[1:2], ',') as starts from inside""")
def snapshot_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of events' JSON but the first inside six units from a place on, two at most, counted from there."""
    made = highlight.highlight(table(spark, sf_dir, "events").select("event_id", "props"), "props", "json")
    made = made.withColumn("rest", F.slice("result.tokens", 2, 100))
    out = document.snapshots(made, (F.col("event_id") % 4).cast("int"), F.lit(6), 2, "rest")
    return out.select("event_id", F.size("snapshot").cast("long").alias("kept"), F.col("left_out").cast("long").alias("left_out"), F.array_join(F.transform("snapshot", lambda t: t["start"].cast("string")), ",").alias("starts"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 2 else 0 end as tokens from part")
def custom_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language of the driver's own, known to the tasks."""
    from ..grammar.engine import Highlighter
    from ..grammar.model import Language, Mode, words

    own = Highlighter({"greeting": lambda: Language("greeting", Mode(keywords=words("hello world")), ("hi",))})
    texts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "hello, world").otherwise("good bye").alias("text"))
    made = highlight.highlight(texts, "text", "HI", registry=own)
    return made.select("p_partkey", F.size("result.tokens").cast("long").alias("tokens"))


@query(r"""with t as (select conv_id, turn, text, role from conversations) select conv_id, turn, turn % 2 = 0 as opens, count(*) filter (turn % 2 = 0) over (partition by conv_id order by turn) % 2 = 1 as open from t""")
def continued_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that go on from one another: a text literal that even turns open or close goes through odd ones."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "x = \'\'\'\n").otherwise("y\n").alias("text"))
    made = highlight.follow(own, "conv_id", "turn", "text", "python")
    last = F.element_at("result.tokens", -1)
    inside = F.size("result.tokens") > 0
    covers = F.when(inside, last["start"] + last["length"] == F.length("text")).otherwise(False)
    return made.select("conv_id", "turn", (F.col("turn") % 2 == 0).alias("opens"), covers.alias("open"))
