"""Language identification by Bayesian evidence fusion.

Log posterior = log host prior + tempered text log likelihood + log likelihoods
of the declared markup language and of the address suffix.

Text: byte-bigram models with add-one smoothing, fitted on a bounded sample of
labelled documents (SAMPLE_ROWS different texts for each language, by their hash) and
applied to whole texts.  Host priors: each text votes for its likeliest language;
votes are counted over all rows by host and by site (the host without its first
label, or the source's letters), and smoothed from all to site to host.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import prepare, salted_join
from .wordbuf import pieces

#: Different labelled texts for each language that the models are fitted on, whole.
SAMPLE_ROWS = 300
#: Bigrams overlap and depend on one another; their log likelihood is divided by this.
TEMPER = 4.0
#: How often a page declares the language it is in, and an address ends in its country's code.
DECLARED, SUFFIXED = 0.9, 0.8
#: Votes that the wider level counts for.
SMOOTHING = 20.0
#: A document is kept if its best language is at least so likely, and likelier than no known language, and its text has a pair of letters.
LEAST = 0.3
#: Where a language is compared with none: what a byte pair counts before any is seen (little, so that pairs of other scripts stay unlikely), and the
#: share of pairs in a text of the language that are as in none.
UNSEEN, FOREIGN = 0.001, 0.02
#: Hosts whose priors may be broadcast; more are joined by a shuffle, in which the rows of a frequent host are dealt over many tasks.
BROADCAST_HOSTS = 50_000
#: Suffixes of countries with one of the languages (fixed values).
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}

_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLD[[*range(32), *range(33, 65), *range(91, 97), *range(123, 128)]] = 32
_FOLD = _FOLD.astype(np.uint8)
#: Pairs of two letters; and the log likelihoods of pairs in no known language: half for ASCII, half for the rest, all alike.
_LETTER = np.bincount(_FOLD, minlength=256) > 0
_LETTER[32] = False
_LETTERS = (_LETTER[:, None] & _LETTER[None, :]).ravel()
_ASCII = ((np.arange(256) < 128)[:, None] & (np.arange(256) < 128)[None, :]).ravel()
_NONE = np.where(_ASCII, np.log(0.5 / 27**2), np.log(0.5 / (155**2 - 27**2)))


def bigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of folded bytes (as numbers) of all texts, and the number of pairs of each.  Pairs of two blanks don't count."""
    raw = b"".join([b" " + (t or b"") + b" " for t in texts])
    size = np.fromiter((len(t or b"") + 2 for t in texts), np.int64, len(texts))
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    use = pair != 0x2020
    use[np.cumsum(size)[:-1] - 1] = False
    text_end = np.cumsum(size) - 1
    upto = np.r_[0, np.cumsum(use)][text_end]
    return pair[use], np.diff(np.r_[0, upto])


class Models:
    """known: by language, log likelihoods of pairs against those in no known language; without it, all is known."""

    def __init__(self, names: list[str], table: np.ndarray, known: np.ndarray | None = None):
        self.names, self.table, self.known = names, table, known

    def likelihoods(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tempered log likelihoods (texts by languages), numbers of pairs, and whether a known language is likelier than none."""
        pair, count = bigrams(texts)
        out, known = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), bool)
        some = np.flatnonzero(count)
        if len(some):
            at = np.cumsum(count) - count
            for k in range(len(self.names)):
                out[some, k] = np.add.reduceat(self.table[k][pair], at[some])
                known[some] |= self.known is None or np.add.reduceat(self.known[k][pair], at[some]) > 0
            known[some] &= np.add.reduceat(_LETTERS[pair].astype(np.int64), at[some]) > 0
        return out / TEMPER, count, known


def _sampled(known: DataFrame, rows: int) -> DataFrame:
    """(lang, h): the rows least hashes of different texts of each language, first of each task and then of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, h = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            of = langs.indices.to_numpy()
            for k, name in enumerate(langs.dictionary.to_pylist()):
                least[name] = np.unique(np.r_[least.get(name, h[:0]), h[of == k]])[:rows]
        for name, h in least.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h)], names=["lang", "h"])

    some = known.select("lang", F.xxhash64("t").alias("h")).mapInArrow(run, "lang string, h long").distinct()
    return some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= rows).select("lang", "h")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Models:
    """Models of all languages named in lang_col, from at most rows different texts of each."""
    prepare(labelled.sparkSession)
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    names = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not names:
        return Models(["und"], np.zeros((1, 1 << 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pair, n = np.unique(bigrams([text.encode()])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pair), pa.string()), pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "pair", "n"])

    picked = known.withColumn("h", F.xxhash64("t")).join(F.broadcast(_sampled(known, rows)), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("t").alias("t"))
    found = picked.select("lang", "t").mapInArrow(run, "lang string, pair long, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")).toArrow()
    count, place = np.zeros((len(names), 1 << 16)), {name: k for k, name in enumerate(names)}
    count[[place[x] for x in found.column("lang").to_pylist()], found.column("pair").to_numpy()] = found.column("n").to_numpy()
    seen = (count.sum(axis=0) > 0).sum() + 1
    table = np.log((count + 1) / (count.sum(axis=1, keepdims=True) + seen))
    known = np.log((1 - FOREIGN) * (count + UNSEEN) / (count.sum(axis=1, keepdims=True) + UNSEEN * 155**2) / np.exp(_NONE) + FOREIGN)
    return Models(names, table - table.max(axis=0), known)


def likelihoods(df: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The columns of df, and _ll (tempered log likelihoods), _n (pairs of bytes but two blanks) and _known (whether a known language is likelier than none).  Nothing is shuffled."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(models)
    names = [f"c{i}" for i in range(len(df.columns))]
    place = f"c{df.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, place, 1 << 20):
            ll, n, known = shared.value.likelihoods(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, ll.shape[1], dtype=np.int32)), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(n.astype(np.int64)), pa.array(known)], names=[*names, "_ll", "_n", "_known"])

    renamed = df.toDF(*names)
    schema = T.StructType([*renamed.schema.fields, T.StructField("_ll", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType()), T.StructField("_known", T.BooleanType())])
    return renamed.mapInArrow(run, schema).toDF(*df.columns, "_ll", "_n", "_known")


def _vote(n: int) -> Column:
    return F.expr(f"CASE WHEN _known THEN array_position(slice(_ll, 1, {n}), array_max(_ll)) - 1 END")


def site_of(host: Column) -> Column:
    """The wider group of a host: without its first label, or, for a name without dots, its letters."""
    return F.when(host.contains("."), F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(F.regexp_replace(host, r"[0-9]+$", ""))


def host_priors(scored: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """(_host, _prior: log priors by language) from the votes of all rows, and the shares over all; columns _host, _ll, _known."""
    votes = scored.select("_host", _vote(n).alias("v")).where("v is not null")
    by_host = votes.groupBy("_host").agg(*[F.count(F.when(F.col("v") == k, 1)).alias(f"h{k}") for k in range(n)]).withColumn("_site", site_of(F.col("_host"))).checkpoint()
    total = by_host.agg(*[F.sum(f"h{k}") for k in range(n)]).first()
    whole = sum(x or 0 for x in total)
    base = [((x or 0) + SMOOTHING / n) / (whole + SMOOTHING) for x in total]
    by_site = by_host.groupBy("_site").agg(*[F.sum(f"h{k}").alias(f"s{k}") for k in range(n)])
    joined = by_host.join(by_site, by_host._site.eqNullSafe(by_site._site))
    s, h = reduce(lambda a, b: a + b, [F.col(f"s{k}") for k in range(n)]), reduce(lambda a, b: a + b, [F.col(f"h{k}") for k in range(n)])
    site = [(F.col(f"s{k}") + SMOOTHING * base[k]) / (s + SMOOTHING) for k in range(n)]
    return joined.select("_host", F.array(*[F.log((F.col(f"h{k}") + SMOOTHING * site[k]) / (h + SMOOTHING)) for k in range(n)]).alias("_prior")), base


def _declared(value: Column, names: list[str], sure: float) -> Column:
    """Log likelihoods of a declaration by true language; none without one of the languages."""
    n = max(2, len(names))
    own = F.array(*[F.when(value == F.lit(name), F.log(F.lit(sure))).otherwise(F.log(F.lit((1 - sure) / (n - 1)))) for name in names])
    return F.when(value.isin(names), own).otherwise(F.array(*[F.lit(0.0)] * len(names)))


def fuse(scored: DataFrame, models: Models, markup: Column | None = None, suffix: Column | None = None, votes: DataFrame | None = None) -> DataFrame:
    """Adds _lang, _posterior, _second, _kept to rows with _host, _ll, _n, _known.  votes: the rows that vote, if a narrower table has them.

    Without votes in all the table, or for a null host, the prior is that of all rows."""
    names, n = models.names, len(models.names)
    priors, base = host_priors(scored if votes is None else votes, n)
    default = F.array(*[F.lit(float(np.log(b))) for b in base])
    if priors.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        priors = F.broadcast(priors.withColumnRenamed("_host", "_h"))
        out = scored.join(priors, scored._host == priors._h, "left").drop("_h")
    else:
        out = salted_join(scored, priors, "_host", by=F.monotonically_increasing_id(), how="left")
    parts = [F.col("_ll"), F.coalesce("_prior", default)]
    parts += [_declared(x, names, sure) for x, sure in ((markup, DECLARED), (suffix, SUFFIXED)) if x is not None]
    out = out.withColumn("_sum", reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)).drop("_prior")
    out = out.withColumn("_p", F.transform("_sum", lambda x: F.exp(x - F.array_max("_sum"))))
    order = F.expr("array_sort(transform(_p, (p, i) -> struct(-p as p, i as i)))")
    out = out.withColumn("_order", order).withColumn("_total", F.expr("aggregate(_p, 0D, (a, x) -> a + x)"))
    name = F.array(*[F.lit(x) for x in names])
    out = out.withColumn("_lang", F.element_at(name, F.col("_order")[0]["i"].cast("int") + 1)).withColumn("_second", F.when(F.size("_order") > 1, F.element_at(name, F.col("_order")[1]["i"].cast("int") + 1)))
    out = out.withColumn("_posterior", -F.col("_order")[0]["p"] / F.col("_total"))
    return out.withColumn("_kept", F.col("_known") & (F.col("_posterior") >= LEAST)).drop("_sum", "_p", "_order", "_total")


#: A language declared in markup, and the last label of a host.
def markup_of(text: Column) -> Column:
    return F.lower(F.substring(F.regexp_extract(text, r"""(?i)<html[^>]*\blang=["']?([a-z]{2})""", 1), 1, 2))


def suffix_of(host: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.element_at(table, F.regexp_extract(F.lower(host), r"\.([a-z]+)$", 1))


def identify_documents(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, lang, posterior, second, kept, text_pairs) of every row.

    The source serves as host.  Null and empty texts, and those without two
    letters in a row, get the prior's language and are not kept, nor are texts that are
    likelier in no known language (other scripts, junk); neither votes.  Ties go to the language first in the alphabet.  Labels serve only to fit."""
    models = fit(docs if labelled is None else labelled)
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_host"), F.when(F.col(text_col).contains("<"), markup_of(F.col(text_col))).otherwise("").alias("_markup"))
    scored = likelihoods(picked, models, "_text").drop("_text").checkpoint()
    fused = fuse(scored, models, F.col("_markup"), suffix_of(F.col("_host")))
    return fused.select(F.col("_id").alias(id_col), F.col("_lang").alias("lang"), F.col("_posterior").alias("posterior"), F.col("_second").alias("second"), F.col("_kept").alias("kept"), F.col("_n").alias("text_pairs"))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, lang, posterior, second, kept, declared, text_pairs): pages with the text between their tags, the declared
    language, the address suffix and the host's prior.  A null html has no text; a null url no host."""
    models = fit(labelled)
    html, host = F.coalesce("html", F.lit("")), F.lower(F.regexp_extract("url", r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*)", 1))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-z]+;", " ")
    picked = pages.select(F.col("page_id").alias("_id"), text.alias("_text"), host.alias("_host"), markup_of(html).alias("_markup"))
    scored = likelihoods(picked, models, "_text").drop("_text").checkpoint()
    fused = fuse(scored, models, F.col("_markup"), suffix_of(F.col("_host")))
    return fused.select(F.col("_id").alias("page_id"), F.col("_lang").alias("lang"), F.col("_posterior").alias("posterior"), F.col("_second").alias("second"), F.col("_kept").alias("kept"), F.col("_markup").alias("declared"), F.col("_n").alias("text_pairs"))


def keep_identified(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows whose language is identified, with all their columns; texts pass through without a shuffle."""
    models = fit(docs)
    names = [f"d{i}" for i in range(len(docs.columns))]
    text, host = names[docs.columns.index(text_col)], names[docs.columns.index(host_col)]
    own = docs.toDF(*names)
    marked = lambda df: df.withColumn("_host", F.col(host)).withColumn("_markup", F.when(F.col(text).contains("<"), markup_of(F.col(text))).otherwise(""))
    votes = likelihoods(marked(own.select(text, host)), models, text).select("_host", "_ll", "_known", "_markup")
    fused = fuse(likelihoods(marked(own), models, text), models, F.col("_markup"), suffix_of(F.col("_host")), votes)
    return fused.where("_kept").select(*names).toDF(*docs.columns)


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, lang, posterior (rounded to six places), second, kept, text_pairs."""
    return identify_documents(docs).withColumn("posterior", F.round("posterior", 6))
