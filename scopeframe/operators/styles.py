"""Themes as tables, styles of scopes by falling back to shorter scopes, and styled runs of tokens.

A theme is a small, fixed table, so it is sent to all; tokens meet it without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The built-in themes (fixed values): foreground and background; then color, traits, scopes.
GITHUB_LIGHT = """
#24292e #ffffff
#d73a49 keyword doctag template-tag template-variable type variable.language
#6f42c1 title title.class title.class.inherited title.function
#005cc5 attr attribute literal meta number operator selector-attr selector-class selector-id
#e36209 variable
#005cc5 variable.constant
#032f62 regexp string meta.string
#22863a char.escape
#e36209 built_in symbol
#6a737d comment code formula
#22863a name quote selector-pseudo selector-tag tag
#24292e subst
#005cc5 bold section
#735c0f bullet
#24292e italic emphasis
#24292e bold strong
#22863a addition
#b31d28 deletion
#032f62 link
#24292e punctuation
#005cc5 property
#24292e params
"""
GITHUB_DARK = """
#c9d1d9 #0d1117
#ff7b72 keyword doctag template-tag template-variable type variable.language
#d2a8ff title title.class title.class.inherited title.function
#79c0ff attr attribute literal meta number operator selector-attr selector-class selector-id
#ffa657 variable
#79c0ff variable.constant
#a5d6ff regexp string meta.string
#7ee787 char.escape
#ffa657 built_in symbol
#8b949e comment code formula
#7ee787 name quote selector-pseudo selector-tag tag
#c9d1d9 subst
#1f6feb bold section
#f2cc60 bullet
#c9d1d9 italic emphasis
#c9d1d9 bold strong
#aff5b4 addition
#ffdcd7 deletion
#a5d6ff link
#c9d1d9 punctuation
#79c0ff property
#c9d1d9 params
"""
XCODE_LIGHT = """
#000000 #ffffff
#9b2393 bold keyword template-tag template-variable variable.language
#c41a16 string regexp meta.string char.escape
#1c00cf number literal symbol
#536579 comment code formula quote
#506375 bold doctag
#3900a0 type title.class title.class.inherited
#326d74 title title.function
#6c36a9 built_in
#643820 meta
#947100 attr attribute property
#0f68a0 variable variable.constant
#326d74 name tag selector-tag
#947100 selector-attr
#3900a0 selector-class selector-id
#326d74 selector-pseudo
#000000 subst operator punctuation params
#1c00cf bold section
#643820 bullet
#000000 italic emphasis
#000000 bold strong
#0f68a0 link
#22863a addition
#b31d28 deletion
"""
XCODE_DARK = """
#ffffff #292a30
#fc5fa3 bold keyword template-tag template-variable variable.language
#fc6a5d string regexp meta.string char.escape
#d0bf69 number literal symbol
#6c7986 comment code formula quote
#92a9bd bold doctag
#d0a8ff type
#9ef1dd title.class
#d0a8ff title.class.inherited
#67b7a4 title title.function
#a167e6 built_in
#fd8f3f meta
#bf8555 attr attribute property
#6bdfff variable variable.constant
#67b7a4 name tag selector-tag
#bf8555 selector-attr
#d0a8ff selector-class selector-id
#67b7a4 selector-pseudo
#ffffff subst operator punctuation params
#d0bf69 bold section
#fd8f3f bullet
#ffffff italic emphasis
#ffffff bold strong
#6bdfff link
#aff5b4 addition
#ffdcd7 deletion
"""


@dataclass(frozen=True)
class Style:
    """A color (of a light and a dark appearance, where they differ) and traits."""

    color: str | None = None
    dark_color: str | None = None
    bold: bool = False
    italic: bool = False


@dataclass(frozen=True)
class Theme:
    foreground: Style
    background: Style
    styles: dict[str, Style]


def _read(text: str) -> Theme:
    (foreground, background), *rows = (line.split() for line in text.split("\n") if line)
    styles = {}
    for color, *names in rows:
        traits = [n for n in names[:1] if n in ("bold", "italic")]
        styles |= {n: Style(color, None, "bold" in traits, "italic" in traits) for n in names[len(traits) :]}
    return Theme(Style(foreground), Style(background), styles)


def _both(a: Style | None, b: Style | None) -> Style:
    traits = a or b
    light, dark = a and a.color, b and b.color
    return Style(light or dark, dark if light and dark != light else None, traits.bold, traits.italic)


def adapted(light: Theme, dark: Theme) -> Theme:
    """Both as one: all scopes of either; a scope's traits are the light one's, if it has the scope."""
    return Theme(_both(light.foreground, dark.foreground), _both(light.background, dark.background), {k: _both(light.styles.get(k), dark.styles.get(k)) for k in [*light.styles, *(x for x in dark.styles if x not in light.styles)]})


THEMES = {"github-light": _read(GITHUB_LIGHT), "github-dark": _read(GITHUB_DARK), "xcode-light": _read(XCODE_LIGHT), "xcode-dark": _read(XCODE_DARK)}
THEMES |= {"github": adapted(THEMES["github-light"], THEMES["github-dark"]), "xcode": adapted(THEMES["xcode-light"], THEMES["xcode-dark"])}


def named(name: str) -> Theme | None:
    """A built-in theme, whatever the letter case."""
    return THEMES.get(name.lower())


def rows_of(theme: Theme) -> list[tuple]:
    return [(scope, s.color, s.dark_color, s.bold, s.italic) for scope, s in theme.styles.items()]


STYLE = "scope string, color string, dark_color string, bold boolean, italic boolean"


def themes(spark: SparkSession) -> DataFrame:
    """(theme, scope, color, dark_color, bold, italic) of the built-in themes; dark_color only where a theme adapts."""
    return spark.createDataFrame([(name, *row) for name, theme in sorted(THEMES.items()) for row in rows_of(theme)], f"theme string, {STYLE}")


def adaptive(light: DataFrame, dark: DataFrame) -> DataFrame:
    """Both themes (scope, color, bold, italic) as one: (scope, light_color, dark_color, bold, italic); traits are the light one's where it has the scope."""
    a, b = (df.select("scope", F.col("color").alias(f"{x}_color"), F.col("bold").alias(f"{x}_bold"), F.col("italic").alias(f"{x}_italic")) for df, x in ((light, "light"), (dark, "dark")))
    return a.join(b, "scope", "full_outer").select("scope", "light_color", "dark_color", F.coalesce("light_bold", "dark_bold").alias("bold"), F.coalesce("light_italic", "dark_italic").alias("italic"))


def styled(df: DataFrame, theme: DataFrame, key: str, scopes: str = "scopes") -> DataFrame:
    """(key, style_scope, color, bold, italic): the innermost scope with a style, each tried whole and then without its last parts.  Keys are distinct."""
    tried = df.select(key, F.posexplode(F.reverse(scopes)).alias("_depth", "_scope"))
    parts = F.split("_scope", r"\.")
    tried = tried.select(key, "_depth", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("_cut", "scope"))
    hits = tried.join(F.broadcast(theme), "scope").groupBy(key).agg(F.min_by(F.struct("scope", "color", "bold", "italic"), F.struct("_depth", "_cut")).alias("_s"))
    return hits.select(key, F.col("_s.scope").alias("style_scope"), "_s.color", "_s.bold", "_s.italic")


def style_of(scopes: Column, theme: Theme) -> Column:
    """struct<color, dark_color, bold, italic> of an array of scopes, outermost first; null without a style."""
    one = lambda s: F.struct(F.lit(s.color).alias("color"), F.lit(s.dark_color).alias("dark_color"), F.lit(s.bold).alias("bold"), F.lit(s.italic).alias("italic"))
    if not theme.styles:
        return F.lit(None).cast("struct<color:string,dark_color:string,bold:boolean,italic:boolean>")
    table = F.create_map(*[x for scope, s in theme.styles.items() for x in (F.lit(scope), one(s))])
    parts = lambda s: F.split(s, r"\.")
    shorter = lambda s: F.transform(F.sequence(F.size(parts(s)), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts(s), F.lit(1), n), "."))
    tried = F.flatten(F.transform(F.reverse(scopes), shorter))
    return F.get(F.filter(F.transform(tried, lambda s: F.element_at(table, s)), lambda s: s.isNotNull()), F.lit(0))


#: Ranges of a source that go to a destination, as a column of each row.
MAPPINGS = "array<struct<src_start:int,dst_start:int,length:int>>"


def _bad(mappings: Column, source: Column, target: Column) -> Column:
    """The first mapping outside the source or the destination; null without."""
    bad = lambda m: (m["src_start"] < 0) | (m["dst_start"] < 0) | (m["length"] < 0) | (m["src_start"] + m["length"] > source) | (m["dst_start"] + m["length"] > target)
    return F.get(F.filter(mappings, bad), F.lit(0))


def render(df: DataFrame, key: str, theme: Theme, tokens: str = "tokens", source_length: str = "source_length", target_length: str | None = None, mappings: str | None = None, colors: bool = True, traits: bool = True, most_runs: int | None = None) -> DataFrame:
    """(key, run, start, length, color, dark_color, bold, italic, applied, error): the styled runs that tokens give a text, in order.

    target_length: the text's units, if it may not be the tokens' source; runs are clipped to what both share.  mappings: a column of
    MAPPINGS; a text with any out of bounds has one row with an error instead of runs.  Runs that follow each other, touch and have equal styles are one.  Without
    colors or traits these are null or false, and runs with nothing else are left out.  Only the first most_runs are
    applied.  Keys are distinct; rows without runs give none."""
    source = F.col(source_length)
    target = F.col(target_length) if target_length else source
    source = F.when(source == 0, target).otherwise(source)
    shared = F.least(source, target)
    maps = F.col(mappings) if mappings else F.array(F.struct(F.lit(0).alias("src_start"), F.lit(0).alias("dst_start"), shared.cast("int").alias("length"))).cast(MAPPINGS)
    own = df.select(F.col(key).alias("_key"), F.col(tokens).alias("_tokens"), maps.alias("_maps"), (_bad(maps, source, target) if mappings else F.lit(None)).alias("_bad"))
    failed = own.where("_bad is not null").select(F.col("_key").alias(key), F.concat(F.lit("invalid range mapping "), F.to_json("_bad")).alias("error")) if mappings else None
    own = own.where("_bad is null").drop("_bad")
    own = own.select("_key", "_maps", F.posexplode("_tokens").alias("_k", "_t")).withColumn("_style", style_of(F.col("_t.scopes"), theme)).where("_style is not null")
    kept = F.lit(False)
    if colors:
        kept = kept | F.col("_style.color").isNotNull()
    if traits:
        kept = kept | F.col("_style.bold") | F.col("_style.italic")
    own = own.where(kept).select("_key", "_k", "_t.start", "_t.length", "_style", F.posexplode("_maps").alias("_m", "_map"))
    a, b = F.greatest("start", "_map.src_start"), F.least(F.col("start") + F.col("length"), F.col("_map.src_start") + F.col("_map.length"))
    own = own.withColumn("_a", a).withColumn("_b", b).where("_b > _a").withColumn("start", F.col("_a") - F.col("_map.src_start") + F.col("_map.dst_start")).withColumn("length", F.col("_b") - F.col("_a"))
    order = Window.partitionBy("_key").orderBy("_k", "_m")
    new = F.when((F.lag(F.col("start") + F.col("length")).over(order) == F.col("start")) & F.lag("_style").over(order).eqNullSafe(F.col("_style")), 0).otherwise(1)
    marked = own.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("_key", "_island").agg(F.min("start").alias("start"), F.sum("length").cast("int").alias("length"), F.first("_style").alias("_style"))
    runs = runs.withColumn("run", F.row_number().over(Window.partitionBy("_key").orderBy("start", "_island")))
    shown = [F.col(f"_style.{c}") if colors else F.lit(None).cast("string").alias(c) for c in ("color", "dark_color")]
    shown += [F.col(f"_style.{c}") if traits else F.lit(False).alias(c) for c in ("bold", "italic")]
    out = runs.select(F.col("_key").alias(key), "run", "start", "length", *shown, (F.lit(True) if most_runs is None else F.col("run") <= most_runs).alias("applied"), F.lit(None).cast("string").alias("error"))
    return out if failed is None else out.unionByName(failed.withColumn("applied", F.lit(False)), allowMissingColumns=True)


def run_summary(runs: DataFrame, key: str) -> DataFrame:
    """(key, applied, omitted) of render's runs."""
    return runs.groupBy(key).agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("omitted"))


def utf16_slice(text: Column, start: Column, length: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-16BE"), 2 * start + 1, 2 * length), "UTF-16BE")


def _runs_within(df: DataFrame, theme: Theme, tokens: str, shared: Column) -> DataFrame:
    """Adds _runs: what render would list as runs of each row (start, length, color, dark_color, bold, italic), by start.  No shuffle; a row costs its tokens."""
    whole = "struct<start:int,length:int,style:struct<color:string,dark_color:string,bold:boolean,italic:boolean>>"
    cut = lambda t: F.struct(F.greatest(t["start"], F.lit(0)).alias("start"), (F.least(t["start"] + t["length"], shared) - F.greatest(t["start"], F.lit(0))).alias("length"), style_of(t["scopes"], theme).alias("style")).cast(whole)
    seen = lambda c: (c["length"] > 0) & (c["style"]["color"].isNotNull() | c["style"]["bold"] | c["style"]["italic"])
    # each step is a column of its own that the next refers to more than once, so that Spark doesn't put one inside the other's loop
    df = df.withColumn("_cut", F.filter(F.transform(F.coalesce(tokens, F.array().cast("array<struct<start:int,length:int,scopes:array<string>>>")), cut), seen))
    last = lambda i: F.get(F.col("_cut"), i - 1)
    new = F.transform("_cut", lambda c, i: F.when((i > 0) & (last(i)["start"] + last(i)["length"] == c["start"]) & last(i)["style"].eqNullSafe(c["style"]), -1).otherwise(i))
    df = df.withColumn("_first", F.filter(new, lambda i: i >= 0))
    upto = lambda k: F.coalesce(F.get(F.col("_first"), k + 1), F.size("_cut")) - 1
    head, tail = lambda i: F.get(F.col("_cut"), i), lambda k: F.get(F.col("_cut"), upto(k))
    run = lambda i, k: F.struct(head(i)["start"].alias("start"), (tail(k)["start"] + tail(k)["length"] - head(i)["start"]).alias("length"), *[head(i)["style"][c].alias(c) for c in ("color", "dark_color", "bold", "italic")])
    return df.withColumn("_runs", F.sort_array(F.transform("_first", run)))


def attributed(df: DataFrame, key: str, text: str, theme: Theme, tokens: str = "tokens", source_length: str = "source_length") -> DataFrame:
    """(key, start, length, part, color, dark_color, bold, italic): the whole text as parts in order, what no run covers in the theme's
    foreground.  Null and empty texts give no parts.  Each row is worked on where it is: nothing is grouped, joined or sent."""
    from ..functions.text import utf16_length

    own = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(tokens).alias("_tokens"), F.col(source_length).alias("_source"), utf16_length(F.col(text)).alias("_n")).where("_n > 0")
    own = own.withColumn("_shared", F.when(F.col("_source") == 0, F.col("_n")).otherwise(F.least("_source", "_n")))
    listed = _runs_within(own, theme, "_tokens", F.col("_shared"))
    base = lambda a, n: F.struct(a.alias("start"), n.alias("length"), F.lit(theme.foreground.color).alias("color"), F.lit(theme.foreground.dark_color).alias("dark_color"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
    ends = F.transform("_runs", lambda r: r["start"] + r["length"])
    gap = lambda r, i: F.when(i == 0, 0).otherwise(F.get(F.col("_ends"), i - 1))
    full = lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), F.coalesce(r["color"], F.lit(theme.foreground.color)).alias("color"), F.when(r["color"].isNull(), F.lit(theme.foreground.dark_color)).otherwise(r["dark_color"]).alias("dark_color"), r["bold"].alias("bold"), r["italic"].alias("italic"))
    pieces = F.flatten(F.transform("_runs", lambda r, i: F.array(base(gap(r, i), r["start"] - gap(r, i)), full(r))))
    last = F.coalesce(F.get(F.col("_ends"), F.size("_ends") - 1), F.lit(0))
    joined = listed.withColumn("_ends", ends).withColumn("_parts", F.filter(F.concat(pieces, F.array(base(last, F.col("_n") - last))), lambda p: p["length"] > 0))
    # no list is empty here; the outer form keeps Spark from pushing a filter on the list's size, and with it all of the above, under every step
    out = joined.select("_key", "_text", F.explode_outer("_parts").alias("p"))
    return out.select(F.col("_key").alias(key), "p.start", "p.length", utf16_slice(F.col("_text"), F.col("p.start"), F.col("p.length")).alias("part"), "p.color", "p.dark_color", "p.bold", "p.italic")
