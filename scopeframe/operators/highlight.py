"""Tokens, scores and detection of texts in a column.

The tokeniser is sequential in each text, so it runs in Python, on Arrow arrays; all
that follows it is Spark's.  Write cheap filters before it: its functions are marked
nondeterministic so that a filter on their result doesn't run them twice.

Languages registered on the driver go to the tasks with the operator: a registry's
bundled languages are made in each worker, its others travel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grammar.engine import Highlighter, Result, restored, saved, shared, unpacked
from ..grammar.model import GrammarError, UnknownLanguage
from ..sources.session import checkpointed, prepare

TOKENS = "array<struct<start:int,length:int,scopes:array<string>>>"
RESULT = f"struct<language:string,relevance:double,illegal:boolean,tokens:{TOKENS},source_length:int,second_language:string,second_relevance:double,state:binary,error:string>"
SCORE = "struct<language:string,relevance:double,second_language:string,second_relevance:double>"


def carried(registry: Highlighter | None) -> bytes | None:
    return (registry or shared()).packed()


def _offsets(counts: list[int]) -> pa.Array:
    out, total = [0], 0
    for n in counts:
        total += n
        out.append(total)
    return pa.array(out, pa.int32())


def token_array(results: list[Result]) -> pa.Array:
    """The tokens of results as one Arrow array, from flat arrays; each stack of scopes is written once and referred to."""
    starts, lengths, stacks, numbers = [], [], [], {}
    for r in results:
        for t in r.tokens:
            starts.append(t.start)
            lengths.append(t.length)
            stacks.append(numbers.setdefault(t.scopes, len(numbers)))
    table = pa.ListArray.from_arrays(_offsets([len(s) for s in numbers]), pa.array([x for s in numbers for x in s], pa.string()))
    scopes = table.take(pa.array(stacks, pa.int32())) if numbers else pa.array([], pa.list_(pa.string()))
    tokens = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), scopes], ["start", "length", "scopes"])
    return pa.ListArray.from_arrays(_offsets([len(r.tokens) for r in results]), tokens)


def result_array(results: list[Result], errors: list[str | None], states: bool) -> pa.Array:
    second = [r.second or (None, None) for r in results]
    columns = {
        "language": pa.array([r.language for r in results], pa.string()),
        "relevance": pa.array([float(r.relevance) for r in results], pa.float64()),
        "illegal": pa.array([r.illegal for r in results], pa.bool_()),
        "tokens": token_array(results),
        "source_length": pa.array([r.source_length for r in results], pa.int32()),
        "second_language": pa.array([x for x, _ in second], pa.string()),
        "second_relevance": pa.array([None if x is None else float(x) for _, x in second], pa.float64()),
        "state": pa.array([saved(r.state) if states else None for r in results], pa.binary()),
        "error": pa.array(errors, pa.string()),
    }
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def tokens_of(text: Column, language: Column | str, ignore_illegals: bool = True, registry: Highlighter | None = None, state: Column | None = None, keep_state: bool = False) -> Column:
    """struct RESULT of each text under its language; a null language (or the name plain) is plain, an unknown one, or one whose grammar
    contradicts itself, an error of that row.  Null texts are empty.

    state: the state (of a result with keep_state) of the text that this one follows; another language's is as none."""
    packed = carried(registry)

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array, names: pa.Array, states: pa.Array) -> pa.Array:
        own, results, errors = unpacked(packed), [], []
        for text, name, before in zip(texts.to_pylist(), names.to_pylist(), states.to_pylist(), strict=True):
            text, error = text or "", None
            if not name or name == "plain":
                result = Result(None, source_length=len(text.encode("utf-16-le")) // 2)
            else:
                try:
                    result = own.highlight(text, name, ignore_illegals, restored(before))
                except UnknownLanguage as e:
                    result, error = Result(None), f"unknown language {e}"
                except GrammarError as e:
                    result, error = Result(None), f"invalid grammar: {e}"
            results.append(result)
            errors.append(error)
        return result_array(results, errors, keep_state)

    return run.asNondeterministic()(text, F.lit(language) if isinstance(language, str) else language, F.lit(None).cast("binary") if state is None else state)


def detected(text: Column, among: list[str] | Column | None = None, registry: Highlighter | None = None) -> Column:
    """struct SCORE: the best and second-best language, among all that take part, a list of names or a column of lists (null: all); scores
    only, so that no losing tokens travel."""
    packed = carried(registry)

    @F.arrow_udf(SCORE)
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        own, rows = unpacked(packed), []
        for text, names in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            r = own.detect(text or "", names, utf16=False)
            rows.append((r.language, float(r.relevance), *(r.second or (None, None))))
        kinds = {"language": pa.string(), "relevance": pa.float64(), "second_language": pa.string(), "second_relevance": pa.float64()}
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    lists = among if isinstance(among, Column) else F.lit(None).cast("array<string>") if among is None else F.array(*[F.lit(x) for x in among]).cast("array<string>")
    return run.asNondeterministic()(text, lists)


def named(selection: str, registry: Highlighter | None = None) -> str | None:
    """The language's own name, null for plain; raises for an unknown one."""
    return None if selection == "plain" else (registry or shared()).grammar_name(selection)


def highlight(df: DataFrame, text: str = "text", selection: str | Column | None = None, ignore_illegals: bool = True, most_tokens: int | None = None, among: list[str] | Column | None = None, registry: Highlighter | None = None, state: Column | None = None, keep_state: bool = False) -> DataFrame:
    """Adds result.  selection: a language's name (checked at once), plain, a column of names, or None to detect (among all, or the
    languages of a list or column).  A budget of tokens cuts what is kept, not what is parsed: omitted says how many went.  state and keep_state as
    of tokens_of."""
    prepare(df.sparkSession)
    if selection is None:
        df = df.withColumn("_best", detected(F.col(text), among, registry))
        out = df.withColumn("result", tokens_of(F.col(text), F.col("_best.language"), ignore_illegals, registry, None, keep_state))
        out = out.withColumn("result", F.col("result").withField("second_language", F.col("_best.second_language")).withField("second_relevance", F.col("_best.second_relevance"))).drop("_best")
    else:
        if isinstance(selection, str):
            selection = named(selection, registry) or "plain"
        out = df.withColumn("result", tokens_of(F.col(text), selection, ignore_illegals, registry, state, keep_state))
    return out if most_tokens is None else budgeted(out, most_tokens)


def budgeted(df: DataFrame, most_tokens: int) -> DataFrame:
    """Only the first most_tokens of each result, and omitted: how many more it had."""
    size = F.size("result.tokens")
    out = df.withColumn("omitted", F.greatest(size - most_tokens, F.lit(0)))
    return out.withColumn("result", F.col("result").withField("tokens", F.slice("result.tokens", 1, most_tokens) if most_tokens else F.array().cast(TOKENS)))


def tokens(df: DataFrame, *keys: str) -> DataFrame:
    """A row a token: keys, k (its place), start, length, scopes, scope (the innermost)."""
    return df.select(*keys, F.posexplode("result.tokens").alias("k", "t")).select(*keys, "k", "t.start", "t.length", "t.scopes", F.element_at("t.scopes", -1).alias("scope"))


def cached(requests: DataFrame, stored: DataFrame | None, text: str, selection: str | None, namespace: str, value: str, ignore_illegals: bool = True, most_tokens: int | None = None, registry: Highlighter | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests (columns namespace, value, text) answered from a store (key, result) and completed by what it lacks.

    Returns (requests with key and result, and with a budget omitted; the store afterwards; metrics: hits, misses, bypasses, insertions by
    namespace).  Equal keys are computed once.  A whole stored result serves requests with a budget; what these miss
    isn't stored.  Results with an error are never stored.  Requests with a null value have no key: they bypass the store.
    An unknown language fails at once, so it needs no entry."""
    from . import cache

    registry = registry or shared()
    identity = cache.selection_identity(selection, None, registry)
    length = F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 2
    keyed = requests.withColumn("key", F.when(F.col(value).isNotNull(), cache.request_key(F.col(namespace), F.col(value), identity, length.cast("int"), ignore_illegals, None, registry)))
    if stored is None:
        stored = requests.sparkSession.createDataFrame([], f"key string, result {RESULT}")
    compute = lambda df: highlight(df.select("key", text), text, selection, ignore_illegals, registry=registry)
    asked = keyed.where("key is not null")
    # what the store is made of is read more than once
    made = checkpointed(compute(cache.misses(asked, stored, "key")).select("key", "result"))
    answers = asked.join(stored.unionByName(made), "key").select(*keyed.columns, "result")
    loose = highlight(keyed.where("key is null"), text, selection, ignore_illegals, registry=registry).select(*keyed.columns, "result")
    after = stored.unionByName(made.where("result.error is null")) if most_tokens is None else stored
    out = answers.unionByName(loose)
    counted = keyed.groupBy(namespace, "key").agg(F.count(F.lit(1)).alias("n")).join(made.select(F.col("key").alias("_made"), F.col("result.error").isNull().alias("_whole")), F.col("key") == F.col("_made"), "left")
    missed = F.col("_made").isNotNull()
    bypass = F.when(F.col("key").isNull(), F.col("n")).when(missed & F.lit(most_tokens is not None), 1).otherwise(0)
    metrics = counted.groupBy(namespace).agg(
        F.sum(F.when(F.col("key").isNull(), 0).when(missed, F.col("n") - 1).otherwise(F.col("n"))).alias("hits"),
        F.count_if(missed).alias("misses"),
        F.sum(bypass).alias("bypasses"),
        F.count_if(missed & F.col("_whole") & F.lit(most_tokens is None)).alias("insertions"),
    )
    return (out if most_tokens is None else budgeted(out, most_tokens)), after, metrics


def follow(df: DataFrame, key: str, order: str, text: str, language: str, registry: Highlighter | None = None) -> DataFrame:
    """Adds result to the chunks of each key: one goes on from the state of the one before it, in the order of a column.

    Chunks of a key are streamed in order; only a state is held.  Of equal order, chunks go by their text."""
    prepare(df.sparkSession)
    packed, canonical = carried(registry), (registry or shared()).grammar_name(language)
    names = [f"c{i}" for i in range(len(df.columns))]
    at = {c: df.columns.index(c) for c in (key, text)}
    own = df.repartition(key).sortWithinPartitions(key, order, text).toDF(*names)

    def run(batches):
        registry, last, state = unpacked(packed), None, None
        for batch in batches:
            results = []
            for k, t in zip(batch.column(at[key]).to_pylist(), batch.column(at[text]).to_pylist(), strict=True):
                r = registry.highlight(t or "", canonical, state=state if (k,) == last else None)
                last, state = (k,), r.state
                results.append(r)
            yield pa.RecordBatch.from_arrays([*batch.columns, result_array(results, [None] * len(results), False)], names=[*names, "result"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields, strict=True))
    return own.mapInArrow(run, f"{fields}, result {RESULT}").toDF(*df.columns, "result")


def plain(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the plain result: no tokens, relevance 0, the length in UTF-16 units.  No Python runs."""
    empty = F.lit(None).cast(RESULT)
    length = (F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 2).cast("int")
    fields = [F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("relevance"), F.lit(False).alias("illegal"), F.array().cast(TOKENS).alias("tokens"), length.alias("source_length")]
    return df.withColumn("result", F.struct(*fields, *[empty[c].alias(c) for c in ("second_language", "second_relevance", "state", "error")]))
