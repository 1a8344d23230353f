"""Languages, their names and hints as tables, and the joins that look them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, interpreter, shebang
from ..grammar.engine import Highlighter, shared
from .highlight import detected, named


def languages(spark: SparkSession, registry: Highlighter | None = None) -> DataFrame:
    """(name, case_insensitive, detectable), by name."""
    rows = [(n, x.case_insensitive, x.detectable) for n, x in sorted((registry or shared()).languages.items())]
    return spark.createDataFrame(rows, "name string, case_insensitive boolean, detectable boolean")


def names(spark: SparkSession, registry: Highlighter | None = None) -> DataFrame:
    """(alias, name): every lower-case name and alias with its owner."""
    return spark.createDataFrame(sorted((registry or shared()).names.items()), "alias string, name string")


def hints(spark: SparkSession, registry: Highlighter | None = None) -> DataFrame:
    """(kind, value, name)"""
    rows = [(kind, v, n) for n, h in (registry or shared()).hints.items() for kind, values in (("extension", h.extensions), ("filename", h.filenames), ("interpreter", h.interpreters)) for v in values]
    return spark.createDataFrame(rows, "kind string, value string, name string")


def look_up(df: DataFrame, name: Column, registry: Highlighter | None = None) -> DataFrame:
    """Adds language, null for unknown names.  The table of names is small and fixed, so it is broadcast."""
    known = names(df.sparkSession, registry).select(F.col("alias").alias("_alias"), F.col("name").alias("language"))
    return df.join(F.broadcast(known), F.lower(name) == F.col("_alias"), "left").drop("_alias")


def keywords(spark: SparkSession, chosen: list[str]) -> DataFrame:
    """(language, word, scope, relevance) of the languages' outermost keywords."""
    rows = []
    for name in chosen:
        root = shared().languages[name].root
        rows += [(name, w, s, r) for w, (s, r) in sorted({w: (s, r) for w, s, r in root.keywords.pairs()}.items())] if root.keywords else []
    return spark.createDataFrame(rows, "language string, word string, scope string, relevance double")


def _candidates(df: DataFrame, kind: str, value: Column, out: str, registry: Highlighter) -> DataFrame:
    table = hints(df.sparkSession, registry).where(F.col("kind") == kind).groupBy(F.col("value").alias("_v")).agg(F.array_sort(F.collect_set("name")).alias(out))
    return df.join(F.broadcast(table), value == F.col("_v"), "left").drop("_v")


def _by_extension(base: Column, registry: Highlighter) -> Column:
    """The languages of the longest suffix behind a dot (or the whole name) that is known."""
    by_suffix: dict[str, list[str]] = {}
    for name, h in registry.hints.items():
        for v in h.extensions:
            by_suffix.setdefault(v, []).append(name)
    if not by_suffix:
        return F.lit(None).cast("array<string>")
    parts = F.split(base, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    lookup = F.create_map(*[x for v, n in sorted(by_suffix.items()) for x in (F.lit(v), F.array(*[F.lit(y) for y in sorted(n)]))])
    hits = F.filter(F.transform(suffixes, lambda s: F.element_at(lookup, s)), lambda n: n.isNotNull())
    return F.when(F.size(hits) > 0, hits[0])


def resolve(df: DataFrame, path: Column, text: Column | None = None, override: str | Column | None = None, run_by: Column | None = None, registry: Highlighter | None = None) -> DataFrame:
    """Adds candidates (array), language and error: by file name, interpreter (run_by, else the text's first line) and longest extension.

    One candidate is the language.  Of several, detection on the text chooses; without relevance, without a text, and without
    candidates the language is null: plain.  override goes before all: plain, automatic (detection among all), or a language's name; an
    unknown name raises, or, in a column, is that row's error.  A null override is none.  Only texts that need
    detection go to Python."""
    registry = registry or shared()
    if isinstance(override, str) and override != "automatic":
        known = named(override, registry)
        return df.withColumn("candidates", F.lit(None).cast("array<string>")).withColumn("language", F.lit(known).cast("string")).withColumn("error", F.lit(None).cast("string"))
    forced = F.lit(override).cast("string") if override is None or isinstance(override, str) else override
    out = df.withColumn("_base", basename(path)).withColumn("_forced", forced)
    out = _candidates(out, "filename", F.col("_base"), "_by_name", registry)
    own = interpreter(shebang(text)) if text is not None else F.lit("")
    if run_by is not None:
        own = F.coalesce(interpreter(run_by), own)
    out = _candidates(out.withColumn("_program", own), "interpreter", F.col("_program"), "_by_program", registry)
    out = out.withColumn("candidates", F.coalesce("_by_name", "_by_program", _by_extension(F.col("_base"), registry)))
    out = look_up(out, F.col("_forced"), registry).withColumnRenamed("language", "_asked")
    automatic = F.col("_forced") == "automatic"
    out = out.withColumn("candidates", F.when(automatic, F.array(*[F.lit(n) for n in sorted(registry.languages)])).when(F.col("_forced").isNull(), F.col("candidates")))
    found = F.when(F.size("candidates") == 1, F.col("candidates")[0])
    if text is not None:
        several = F.size("candidates") > 1
        out = out.withColumn("_best", detected(F.when(several, text), F.when(several, F.col("candidates")).otherwise(F.array().cast("array<string>")), registry))
        found = found.when(several & (F.col("_best.relevance") > 0), F.col("_best.language"))
    given = F.col("_forced").isNotNull() & ~automatic
    out = out.withColumn("language", F.when(given, F.col("_asked")).otherwise(found))
    out = out.withColumn("error", F.when(given & F.col("_asked").isNull() & (F.col("_forced") != "plain"), F.concat(F.lit("unknown language "), "_forced")))
    return out.drop("_base", "_program", "_by_name", "_by_program", "_forced", "_asked", "_best")
