"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Exact, by prefixes: two sets so similar share a shingle among the first
n - ceil(0.8 n) + 1 of each, whatever the order of shingles, so long as it is one
for all.  Here frequent ones (found in a sample; the sample only affects speed)
come last.  Equal sets are merged first.  Of the sets that share a shingle and
are near enough in size, neighbours are compared first, by their whole sets, and
then all that are not yet in one component, so a large group of near copies
costs about its size and no pair is passed over.

Most sets that share one shingle are far from similar.  A sketch of two to four
bits a shingle bounds from above what two sets can have in common, so nearly all of
these pairs are passed over, without loss, before whole sets travel.

Pairs from elsewhere (fingerprints that collide) may be added to those compared.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runtime import parts, prepare, release
from .wordbuf import LOWER, Words, mix, pieces

SHINGLE = 5
#: One set of this many is searched for frequent shingles; those found so often come last, and at most so many of them are told apart.
SAMPLED, FREQUENT, MOST = 16, 4, 1 << 20
#: Parts that shingles are dealt out in.
DEALT = 1024
#: How many more pairs a component may have in each next round.
GROWTH = 16
#: So many keys of sets to compare are sent to all tasks; if there are more, the sets are joined with them by a shuffle.
SENT = 4 << 20

_ENTRY = np.dtype([("g", np.uint64), ("item", np.int64), ("n", np.int32)])


def sets_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles (sorted hashes without repeats) of all texts, the number of each text's, and each text's key: a hash of its set.

    A text of fewer words than a shingle has one shingle, all its words; one without words has none."""
    words = Words(texts, translate=LOWER)
    start, text = words.starts(SHINGLE)
    hashes = words.runs(SHINGLE, start)
    count = np.diff(words.first)
    for n in range(1, SHINGLE):
        few = np.flatnonzero(count == n)
        hashes, text = np.concatenate([hashes, words.runs(n, words.first[few])]), np.concatenate([text, few])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if len(hashes):
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])]
        hashes, text = hashes[new], text[new]
    size = np.bincount(text, minlength=len(texts))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)]
    ends = np.cumsum(size)
    key = mix((sums[ends] - sums[ends - size]) + size.astype(np.uint64)).view(np.int64)
    return hashes, size, key


def similar(inter: int, a: int, b: int) -> bool:
    """Whether sets of a and b with so many in common have a Jaccard similarity of 0.8 or more."""
    return 9 * inter >= 4 * (a + b)


def sketch(hashes: np.ndarray) -> bytes:
    """A bitmap of the shingles; a power of two of bits, so that a longer one folds into a shorter."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    marks = np.zeros(bits, np.uint8)
    marks[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks).tobytes()


def folded(rows: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches as rows of so many 64-bit words."""
    out = np.empty((len(rows), words), np.uint64)
    for i, x in enumerate(rows):
        while len(x) > words:
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        out[i] = x
    return out


def may_be_similar(a: np.ndarray, a_size: int, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """For a sketch and rows of others of the same width: whether the sets can have a Jaccard similarity of 0.8.  A bit set in only one
    of two sketches stands for at least one shingle that the other set lacks."""
    most = np.minimum(a_size - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), b_size - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return 9 * most >= 4 * (a_size + b_size)


def simhash(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each text's set of shingles: a bit is 1 if set in over half their hashes."""
    out = np.zeros(len(size), np.uint64)
    begin = np.cumsum(size) - size
    ones = np.zeros((len(size), 64), np.int32)
    for lo in range(0, len(hashes), 1 << 14):
        # a block of hashes at a time, as each takes 64 bytes here
        hi = min(lo + (1 << 14), len(hashes))
        first = np.searchsorted(begin, lo, side="right") - 1
        some = first + np.flatnonzero(size[first : np.searchsorted(begin, hi, side="left")])
        some = some[(begin + size)[some] > lo]
        bits = np.unpackbits(hashes[lo:hi].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones[some] += np.add.reduceat(bits, np.maximum(begin[some], lo) - lo, axis=0, dtype=np.int32)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.packbits(2 * ones[some] > size[some, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def keyed(docs: DataFrame, text_col: str, *others: str) -> DataFrame:
    """The columns others, and item (a hash of the text's set of shingles), fp (the set's fingerprint), n (its size), sketch."""
    names = [f"c{i}" for i in range(len(others))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            hashes, size, key = sets_of(texts)
            marks = [sketch(x) for x in np.split(hashes, np.cumsum(size)[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(key), pa.array(simhash(hashes, size).view(np.int64)), pa.array(size), pa.array(marks, pa.binary())], names=[*names, "item", "fp", "n", "sketch"])

    picked = docs.select(*[F.col(x).alias(y) for x, y in zip(others, names, strict=True)], F.col(text_col).alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{fields}, item long, fp long, n long, sketch binary").toDF(*others, "item", "fp", "n", "sketch")


def _frequent(docs: DataFrame, text_col: str) -> np.ndarray:
    """The most frequent shingles, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "_text"):
            hashes, size, key = sets_of(texts)
            some = mix(key.view(np.uint64)) % np.uint64(SAMPLED) == 0
            g, n = np.unique(hashes[np.repeat(some, size)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["g", "n"])

    counts = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "g").limit(MOST).toArrow()
    return found.column("g").to_numpy().view(np.uint64)[::-1].copy()


def _entries(docs: DataFrame, text_col: str, spark: SparkSession) -> DataFrame:
    """(part, blob): of every text, its first shingles with its key and size."""
    last = _frequent(docs, text_col)
    by_hash = np.argsort(last)
    shared = spark.sparkContext.broadcast((last[by_hash], by_hash.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        for _, texts in pieces(batches, "_text"):
            hashes, size, key = sets_of(texts)
            if not len(hashes):
                continue
            order = hashes >> np.uint64(1)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                hit = frequent[at] == hashes
                order[hit] = (np.uint64(1) << np.uint64(63)) + rank[at[hit]]
            text = np.repeat(np.arange(len(size)), size)
            by = np.lexsort((hashes, order, text))
            place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
            first = by[place < np.repeat(size - (4 * size + 4) // 5 + 1, size)]
            out = np.empty(len(first), _ENTRY)
            out["g"], out["item"], out["n"] = hashes[first], key[text[first]], size[text[first]]
            part = mix(out["g"]) % np.uint64(DEALT)
            out = out[np.argsort(part, kind="stable")]
            values, at = np.unique(np.sort(part), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array([x.tobytes() for x in np.split(out, at[1:])], pa.binary())], names=["part", "blob"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "part long, blob binary").repartition(parts(spark), "part")


def _meetings(entries: DataFrame) -> DataFrame:
    """(x, y, items, sizes): neighbours among sets that share a shingle (x < y), and every group of three or more of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(blob)
        for part in list(held):
            e = np.frombuffer(b"".join(held.pop(part)), _ENTRY)
            e = e[np.lexsort((e["item"], e["n"], e["g"]))]
            # equal sets are one; a group ends where the shingle does or the next set is too large
            e = e[np.r_[True, (e["g"][1:] != e["g"][:-1]) | (e["item"][1:] != e["item"][:-1])]]
            joined = (e["g"][1:] == e["g"][:-1]) & (5 * e["n"][:-1].astype(np.int64) >= 4 * e["n"][1:])
            at = np.flatnonzero(joined)
            x, y = e["item"][at], e["item"][at + 1]
            pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            begin = np.flatnonzero(joined & ~np.r_[False, joined[:-1]])
            end = np.flatnonzero(joined & ~np.r_[joined[1:], False]) + 2
            lists, sizes, seen = [], [], set()
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                if b - a > 2 and (items := e["item"][a:b].tobytes()) not in seen:
                    seen.add(items)
                    lists.append(e["item"][a:b])
                    sizes.append(e["n"][a:b].astype(np.int64))
            none = pa.nulls(len(pair), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), none, none], names=["x", "y", "items", "sizes"])
            if lists:
                no = pa.nulls(len(lists), pa.int64())
                yield pa.RecordBatch.from_arrays([no, no, pa.array(lists, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))], names=["x", "y", "items", "sizes"])

    return entries.mapInArrow(run, "x long, y long, items array<long>, sizes array<long>")


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (x, y) that their sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            a_size, b_size = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            for i, (p, q) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                if 5 * min(a_size[i], b_size[i]) >= 4 * max(a_size[i], b_size[i]):
                    a, b = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    both = folded([a, b], min(len(a), len(b)))
                    keep[i] = may_be_similar(both[0], a_size[i], both[1:], b_size[i : i + 1])[0]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["x", "y"])

    left, right = sketches.toDF("x", "m", "p"), sketches.toDF("y", "n", "q")
    return pairs.join(left, "x").join(right, "y").select("x", "y", "m", "p", "n", "q").mapInArrow(run, "x long, y long")


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str, spark: SparkSession) -> DataFrame:
    """The pairs (x, y) whose sets are similar."""
    asked = pairs.select(F.col("x").alias("item")).unionAll(pairs.select("y")).distinct().checkpoint()
    few = asked.count() <= SENT
    shared = spark.sparkContext.broadcast(np.sort(asked.toArrow().column("item").to_numpy()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for _, texts in pieces(batches, "_text"):
            hashes, size, key = sets_of(texts)
            kept = np.arange(len(key)) if wanted is None else np.flatnonzero(np.isin(key, wanted))
            end = np.cumsum(size)
            # copies within the slice travel once
            kept = kept[np.unique(key[kept], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array([hashes[end[i] - size[i] : end[i]].tobytes() for i in kept.tolist()], pa.binary())], names=["item", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                good.append(5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, ok in zip(x, good, strict=True) if ok], pa.int64()), pa.array([v for v, ok in zip(y, good, strict=True) if ok], pa.int64())], names=["a", "b"])

    sets = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "item long, set binary")
    if not few:
        sets = sets.join(asked, "item", "left_semi")
    sets = sets.dropDuplicates(["item"])
    left, right = sets.toDF("x", "p"), sets.toDF("y", "q")
    return pairs.join(left, "x").join(right, "y").select("x", "y", "p", "q").mapInArrow(compare, "a long, b long")


def closest(n: np.ndarray, item: np.ndarray, root: np.ndarray, marks: list[np.ndarray], failed: list[list[int] | None], own: np.ndarray, me: int, most: int) -> set[tuple[int, int]]:
    """Of the sets in one list (by size), pairs of different components that may be similar and haven't failed: for each component the
    most that are closest by their sketches.  Two sets whose largest list is the same are left to that list."""
    upto = np.searchsorted(n, 5 * n // 4, side="right")
    width, first, rows = 0, 0, np.empty((0, 0), np.uint64)
    best: dict[int, list[tuple[int, int, int]]] = {}
    for i in range(len(n)):
        if len(marks[i]) != width:
            # sizes only grow, so this happens once for each doubling
            width, first = len(marks[i]), i
            rows = folded(marks[i:], width)
        j = np.arange(i + 1, upto[i])
        j = j[(root[j] != root[i]) & ((own[j] != own[i]) | (own[i] == me))]
        if failed[i]:
            j = j[~np.isin(item[j], failed[i])]
        j = j[may_be_similar(rows[i - first], n[i], rows[j - first], n[j])]
        if not len(j):
            continue
        apart = np.bitwise_count(rows[i - first] ^ rows[j - first]).sum(axis=1, dtype=np.int64)
        for k in np.lexsort((item[j], apart)).tolist():
            pair = int(apart[k]), min(int(item[i]), int(item[j[k]])), max(int(item[i]), int(item[j[k]]))
            for side in (int(root[i]), int(root[j[k]])):
                held = best.setdefault(side, [])
                if len(held) < most:
                    heapq.heappush(held, tuple(-x for x in pair))
                else:
                    heapq.heappushpop(held, tuple(-x for x in pair))
    return {(-x, -y) for held in best.values() for _, x, y in held}


def roots(docs: DataFrame, text_col: str, items: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(node, root) of every item (as of keyed) that is in one component with a smaller one.

    items: (item, n, sketch), distinct; others: pairs (x, y), x < y, to compare besides those that share a shingle.

    Neighbours in the lists of sets that share a shingle are compared first.  Then, in rounds, each component with its closest in every list
    that still has several, one at first and GROWTH times as many in every next round, until no pair is left that might be similar.  So a large group of
    copies costs about its size, and no pair is passed over."""
    spark = prepare(docs.sparkSession)
    met = _meetings(_entries(docs, text_col, spark)).checkpoint()
    release(spark)
    pairs = met.where("x is not null").select("x", "y")
    pairs = (pairs if others is None else pairs.unionAll(others.select("x", "y"))).distinct().checkpoint()
    near = _plausible(pairs, items).checkpoint()
    release(spark)
    links = _verified(near, docs, text_col, spark).checkpoint()
    release(spark)
    failed = pairs.join(links.toDF("x", "y"), ["x", "y"], "left_anti").checkpoint()
    del pairs, near
    release(spark)
    found = components(links)
    listed = met.where("items is not null").select("items", "sizes").distinct().withColumn("id", F.xxhash64("items", "sizes"))
    member = listed.select("id", F.explode(F.arrays_zip("items", "sizes")).alias("m")).select("id", F.col("m.items").alias("item"), F.col("m.sizes").alias("n"), F.col("m.items").alias("root"))
    member = member.withColumn("own", F.col("id"))
    most = 1
    while True:
        roots_ = found.toDF("_node", "_root")
        member = member.join(roots_, member.root == F.col("_node"), "left").select("id", "item", "n", F.coalesce("_root", "root").alias("root"), "own").checkpoint()
        open_ = member.groupBy("id").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("id")
        member = member.join(open_, "id", "left_semi").checkpoint()
        if most == 1:
            # a set's largest list; those closed before hold one component each and matter no more
            size = member.groupBy("id").agg(F.count(F.lit(1)).alias("_s"))
            largest = member.drop("own").join(size, "id").groupBy("item").agg(F.max_by("id", F.struct("_s", "id")).alias("own"))
            member = member.drop("own").join(largest, "item").select("id", "item", "n", "root", "own").checkpoint()
            del size, largest
        del open_, roots_
        release(spark)
        tried = failed.groupBy("x").agg(F.collect_list("y").alias("failed")).unionAll(failed.groupBy("y").agg(F.collect_list("x")))
        tried = tried.groupBy(F.col("x").alias("item")).agg(F.flatten(F.collect_list("failed")).alias("failed"))
        whole = member.join(items.select("item", "sketch"), "item").join(tried, "item", "left")
        apart = whole.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "item", "root", "own", "sketch", "failed"))).alias("m"))

        def cross(batches: Iterator[pa.RecordBatch], most: int = most) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for me, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    n, item, root, own = (np.asarray(m.values.field(k)) for k in range(4))
                    marks = [np.frombuffer(x.as_buffer(), np.uint64) for x in m.values.field(4)]
                    near = sorted(closest(n, item, root, marks, m.values.field(5).to_pylist(), own, me, most))
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in near], pa.int64()), pa.array([y for _, y in near], pa.int64())], names=["x", "y"])

        pairs = apart.select("id", "m").mapInArrow(cross, "x long, y long").distinct().checkpoint()
        del whole, apart, tried
        release(spark)
        if not pairs.limit(1).count():
            return found
        new = _verified(pairs, docs, text_col, spark).checkpoint()
        release(spark)
        failed = failed.unionAll(pairs.join(new.toDF("x", "y"), ["x", "y"], "left_anti")).checkpoint()
        if new.limit(1).count():
            found = _merged(found, new).checkpoint()
        most *= GROWTH


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, root) after further links: components of the components."""
    of = lambda df, c: df.join(found.toDF("_node", "_root"), F.col(c) == F.col("_node"), "left").withColumn(c, F.coalesce("_root", c)).drop("_node", "_root")
    above = components(of(of(links, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()).checkpoint()
    moved = found.join(above.toDF("_node", "_root"), F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))
    return moved.unionAll(above.select("node", "root"))
