"""Results kept by content: keys, misses, single flight, storage policy, metrics, cost and eviction.

A store is a table of results by key, kept by its user as files.  One that only grows is
joined; the order of requests matters only to one of bounded size, whose log replay() runs through.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grammar.engine import Highlighter, shared
from ..sources.session import prepare


def key(*parts: Column) -> Column:
    """A digest of all that a result depends on; nulls differ from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]), 256)


def selection_identity(selection: str | None, among: list[str] | None = None, registry: Highlighter | None = None) -> str:
    """plain, named: and a language's own name (aliases share it), or automatic: and those to choose from.  Raises for an unknown name."""
    registry = registry or shared()
    if selection == "plain":
        return "plain"
    if selection is None:
        return "automatic:" + ("*" if among is None else ",".join(n for n in map(registry.resolve, among) if n))
    return "named:" + registry.grammar_name(selection)


def request_key(namespace: Column, value: Column, selection: Column | str, source_length: Column, ignore_illegals: bool = True, continuation: Column | None = None, registry: Highlighter | None = None) -> Column:
    """The key of a request: the caller's namespace and value, the registry and its revision, the selection's identity, options, length and
    the state it goes on from.  Any of these that differs makes another key."""
    registry = registry or shared()
    chosen = F.lit(selection) if isinstance(selection, str) else selection
    return key(namespace, value, F.lit(registry.identity), F.lit(registry.revision), chosen, F.lit(ignore_illegals), source_length, F.lit(None).cast("string") if continuation is None else F.sha2(continuation, 256))


def unknown_key(name: Column, registry: Highlighter | None = None) -> Column:
    """The key of a language that isn't known, whatever text and options."""
    registry = registry or shared()
    return key(F.lit("unknown"), F.lit(registry.identity), F.lit(registry.revision), F.lower(name))


def cost(tokens: Column) -> Column:
    """64 for a result, and for each token 32 and the bytes of its scopes."""
    return F.aggregate(tokens, F.lit(64), lambda acc, t: acc + 32 + F.aggregate(t["scopes"], F.lit(0), lambda n, s: n + F.octet_length(s)))


def misses(requests: DataFrame, stored: DataFrame, on: str) -> DataFrame:
    """One row for each key that isn't stored: equal requests are computed once."""
    return requests.join(stored.select(on).distinct(), on, "left_anti").dropDuplicates([on])


def through(requests: DataFrame, stored: DataFrame, on: str, compute: Callable[[DataFrame], DataFrame], keep: Column | None = None, insert: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers to all requests, what is stored afterwards); compute gets the misses and returns stored's columns.

    keep: which results may be stored (whole ones, without an error); insert: which requests store what they miss (those
    with a budget don't).  A key is stored if any request for it does."""
    made = compute(misses(requests, stored, on)).select(*stored.columns)
    kept = made if keep is None else made.where(keep)
    if insert is not None:
        kept = kept.join(requests.where(insert).select(on).distinct(), on, "left_semi")
    return requests.join(stored.unionByName(made), on), stored.unionByName(kept)


def metrics(requests: DataFrame, namespace: str, on: str, order: str) -> DataFrame:
    """(namespace, hits, misses, requests) of a store without bounds: a key's first request misses, later ones hit."""
    by_key = requests.groupBy(namespace, on).agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy(namespace).agg((F.sum("n") - F.count(F.lit(1))).alias("hits"), F.count(F.lit(1)).alias("misses"), F.sum("n").alias("requests"))


COUNTERS = ("hits", "misses", "coalesced", "negative_hits", "bypasses", "insertions", "evictions", "purges", "entries", "total_cost")


@dataclass
class Store:
    """A cache of bounded cost and size that drops the least recently used."""

    most_cost: int
    most_entries: int | None = None
    held: OrderedDict[str, int] = field(default_factory=OrderedDict)
    count: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    #: key -> (cost, whether a result may be stored, whether a request stores it), of requests that run together
    flights: dict[str, tuple[int, bool, bool]] = field(default_factory=dict)
    batch: object = None

    def put(self, k: str, cost: int) -> None:
        if cost > self.most_cost or self.most_entries == 0:
            return
        self.count["total_cost"] += cost - self.held.pop(k, 0)
        self.held[k] = cost
        self.count["insertions"] += 1
        while self.count["total_cost"] > self.most_cost or (self.most_entries is not None and len(self.held) > self.most_entries):
            self.count["total_cost"] -= self.held.popitem(last=False)[1]
            self.count["evictions"] += 1

    def land(self) -> None:
        for k, (cost, whole, inserts) in self.flights.items():
            if whole and inserts:
                self.put(k, cost)
        self.flights.clear()

    def step(self, kind: str, k: str | None, cost: int | None, whole: bool | None, budgeted: bool | None, batch: object) -> None:
        if batch is None or batch != self.batch:
            self.land()
        self.batch, n = batch, self.count
        if kind == "purge":
            self.held.clear()
            n["total_cost"] = 0
            n["purges"] += 1
        elif kind == "unkeyed" or k is None:
            n["bypasses"] += 1
        elif k in self.held:
            n["negative_hits" if kind == "unknown" else "hits"] += 1
            self.held.move_to_end(k)
        elif kind == "unknown":
            n["misses"] += 1
            self.put(k, 1)
        elif k in self.flights:
            n["coalesced"] += 1
            cost, whole, inserts = self.flights[k]
            self.flights[k] = cost, whole, inserts or not budgeted
        else:
            n["misses"] += 1
            n["bypasses"] += bool(budgeted)
            self.flights[k] = int(cost or 0), whole is not False, not budgeted

    def totals(self) -> list[int]:
        self.land()
        self.count["entries"] = len(self.held)
        return [self.count[c] for c in COUNTERS]


def replay(log: DataFrame, namespace: str, order: str, most_cost: int, most_entries: int | None = None) -> DataFrame:
    """(namespace, COUNTERS) of a cache of bounded cost and size for each namespace, from its log in order.

    Columns of the log: kind (request; unknown, for a language that isn't known; unkeyed, for requests without a key; purge), key, cost and,
    if there, whole (false: cut, failed or cancelled; such results aren't stored), budgeted (misses with a budget don't
    store), batch (requests of one batch run together, so that equal keys wait for one result).  A namespace's log is streamed in
    order; only what the cache holds is in memory.  Of equal order, rows go by kind and key.  Negative entries cost 1."""
    prepare(log.sparkSession)
    schema = log.schema[namespace].dataType.simpleString()
    null = {"whole": "boolean", "budgeted": "boolean", "batch": "long"}
    picked = log.select(F.col(namespace).alias("_ns"), F.col(order).alias("_o"), "kind", "key", F.col("cost").cast("long").alias("cost"), *[F.col(c) if c in log.columns else F.lit(None).cast(t).alias(c) for c, t in null.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, store, out = None, None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for ns, _, *row in zip(*columns, strict=True):
                if store is None or ns != now:
                    if store is not None:
                        out.append([now, *store.totals()])
                    now, store = ns, Store(most_cost, most_entries)
                store.step(*row)
        if store is not None:
            out.append([now, *store.totals()])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], ns_type), *(pa.array([r[k] for r in out], pa.int64()) for k in range(1, len(COUNTERS) + 1))], names=[namespace, *COUNTERS])

    from pyspark.sql.pandas.types import to_arrow_type

    ns_type = to_arrow_type(log.schema[namespace].dataType)
    sorted_ = picked.repartition("_ns").sortWithinPartitions("_ns", "_o", "kind", "key")
    return sorted_.mapInArrow(run, f"{namespace} {schema}, " + ", ".join(f"{c} long" for c in COUNTERS))


def least_recent(requests: DataFrame, namespace: str, on: str, size: str, order: str, most_cost: int, most_entries: int) -> DataFrame:
    """(namespace, hits, misses, evictions, entries, total_cost) of replay() for a log of plain requests."""
    log = requests.select(namespace, F.col(order).alias("_order"), F.lit("request").alias("kind"), F.col(on).alias("key"), F.col(size).alias("cost"))
    return replay(log, namespace, "_order", most_cost, most_entries).select(namespace, "hits", "misses", "evictions", "entries", "total_cost")
