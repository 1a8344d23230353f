"""Near-duplicate documents by 64-bit SimHash and meet-in-the-middle ball hashing.

Two fingerprints within four bits have a common point within two bits of each.
So every distinct fingerprint emits all its variants within two bits; those that
share a variant are linked, and any two that share one are within four bits.
A chain through the fingerprints of a variant therefore loses no component, and
a large group of near copies costs its size, not its pairs.

Variants are dealt out by their lowest bits: a variant differs from its
fingerprint there in at most two places, so a fingerprint travels once to each of
those 1 + b + b (b - 1) / 2 buckets and the bucket lists exactly its own variants,
instead of 2,081 rows travelling.  b grows with the number of fingerprints, so that
a bucket lists about as many variants at every size.  Equal fingerprints are
merged before any of this.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import resemble
from .components import components
from .runtime import in_turn, parts, prepare, release, salted_join
from .wordbuf import LOWER, Words, pieces

SEED, SHINGLE, RADIUS = 42, 4, 4


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    """One fingerprint (uint64) a text; zero for texts without words."""
    words = Words(texts, translate=LOWER)
    start, text = words.starts(SHINGLE)
    length = np.full(len(start), SHINGLE)
    count = np.diff(words.first)
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(few):
        start, text, length = np.concatenate([start, words.first[few]]), np.concatenate([text, few]), np.concatenate([length, count[few]])
        order = np.argsort(text, kind="stable")
        start, text, length = start[order], text[order], length[order]
    out = np.zeros(len(texts), np.uint64)
    if not len(start):
        return out
    data, digest = words.data, xxhash.xxh64_digest
    hashes = b"".join([digest(data[a:b], SEED) for a, b in zip(words.off[start].tolist(), (words.off[start + length] - 1).tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    ends = np.r_[at[1:], len(text)]
    for a, b in zip(at.tolist(), ends.tolist(), strict=True):
        ones = bits[a:b].sum(axis=0, dtype=np.int64)
        out[text[a]] = int.from_bytes(np.packbits(2 * ones > b - a).tobytes(), "big")
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(texts).view(np.int64))], names=["_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(run, f"_id {kind}, fp long")


class Ball:
    """Variants of 64-bit points within a number of flipped bits, by buckets of their lowest bits."""

    def __init__(self, radius: int, bits: int):
        self.radius, self.bits, self.low = radius, bits, np.uint64((1 << bits) - 1)
        self._masks: dict[tuple[int, int], np.ndarray] = {}
        #: what to flip among the lowest bits for each bucket a point travels to
        self.steps = self._weights(range(bits), radius)

    @staticmethod
    def _weights(places: range, most: int) -> np.ndarray:
        masks = [0]
        for k in range(1, most + 1):
            masks += [sum(1 << i for i in c) for c in itertools.combinations(places, k)]
        return np.array(masks, np.uint64)

    def masks(self, bits: int, left: int) -> np.ndarray:
        """Masks of at most left flips above the lowest bits."""
        if (bits, left) not in self._masks:
            self._masks[bits, left] = self._weights(range(bits, 64), left)
        return self._masks[bits, left]

    def buckets(self, points: np.ndarray) -> np.ndarray:
        """A row a point: the buckets its variants fall in."""
        return ((points & self.low)[:, None] ^ self.steps[None, :]).astype(np.int64)

    def variants(self, bucket: int, points: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(variants, their points' places) in this bucket, about most at once.  A larger bucket is halved by the next bit of the
        variants, as often as it takes, so every variant is listed once at any size."""
        b = np.uint64(bucket)
        used = _popcount((points ^ b) & self.low)
        at = np.flatnonzero(used <= self.radius)
        stack = [(self.bits, (points[at] & ~self.low) | b, at, self.radius - used[at])]
        while stack:
            bits, own, at, left = stack.pop()
            count = np.bincount(left, minlength=self.radius + 1)
            total = sum(int(n) * len(self.masks(bits, k)) for k, n in enumerate(count) if n)
            if total <= most or bits >= 60:
                parts = [(np.flatnonzero(left == k), self.masks(bits, k)) for k, n in enumerate(count) if n]
                if parts:
                    yield np.concatenate([(own[p][:, None] ^ m[None, :]).ravel() for p, m in parts]), np.concatenate([np.repeat(at[p], len(m)) for p, m in parts])
                continue
            bit = np.uint64(1 << bits)
            for side in (np.uint64(0), bit):
                off = (own & bit) != side
                keep = np.flatnonzero(left - off >= 0)
                stack.append((bits + 1, (own[keep] & ~bit) | side, at[keep], (left - off)[keep]))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class _Forest:
    """Union-find that keeps the smallest member as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up.setdefault(min(a, b), min(a, b))
            self.up[max(a, b)] = min(a, b)


#: Variants that a bucket lists; buckets are made so many.
MOST = 1 << 22
#: Variants that are listed at once; a bucket with more is halved until it has so few.
AT_ONCE = 1 << 20


def bits_for(count: int, most: int = MOST) -> int:
    """The bits a bucket is named by, for so many fingerprints."""
    bits = 4
    while count * 2081 > most << bits and bits < 24:
        bits += 1
    return bits


def links(distinct: DataFrame, spark: SparkSession, count: int, radius: int = RADIUS, chained: bool = True) -> DataFrame:
    """Links (a, b), a < b, that join all fingerprints (column fp) within radius bits of each other.

    count: distinct fingerprints, of which the number of buckets depends.  Chained, a task names a link's ends by its smallest
    member, which may be further away; else all links are of fingerprints that collide."""
    ball = Ball(radius // 2, bits_for(count))
    step = max(1 << 10, (1 << 21) // len(ball.steps))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(points), step):
                some = points[lo : lo + step]
                bucket = ball.buckets(some).ravel()
                order = np.argsort(bucket, kind="stable")
                values, at = np.unique(bucket[order], return_index=True)
                own = some[order // len(ball.steps)]
                ends = np.r_[at, len(own)]
                for k in range(0, len(values), 1024):
                    part = ends[k : k + 1025]
                    blobs = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer(((part - part[0]) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own[part[0] : part[-1]]))])
                    yield pa.RecordBatch.from_arrays([pa.array(values[k : k + len(part) - 1]), blobs], names=["bucket", "points"])

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for bucket, blobs in in_turn(batches):
            points = np.frombuffer(b"".join(blobs), np.uint64)
            for a, b in bucket_links(ball, bucket, points, radius):
                if not chained:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    continue
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(x, y)
        ends = sorted(x for x in forest.up if forest.root(x) != x)
        for lo in range(0, len(ends), 1 << 16):
            some = ends[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([forest.root(x) for x in some], pa.int64()), pa.array(some, pa.int64())], names=["a", "b"])

    dealt = distinct.select("fp").mapInArrow(emit, "bucket long, points binary").repartition(parts(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(collide, "a long, b long").distinct()


def bucket_links(ball: Ball, bucket: int, points: np.ndarray, radius: int, most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links (a, b signed, a < b) of points that share a variant in this bucket."""
    for v, at in ball.variants(bucket, points, most):
        order = np.argsort(v)
        same = np.flatnonzero(v[order[1:]] == v[order[:-1]])
        x, y = points[at[order[same]]], points[at[order[same + 1]]]
        good = (x != y) & (_popcount(x ^ y) <= radius)
        x, y = x[good].view(np.int64), y[good].view(np.int64)
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        yield pair[:, 0], pair[:, 1]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable over links, itself included.

    Null and empty texts have fingerprint zero and are linked like others.  Rows
    that repeat, also under one id, each get a row.  Null ids get a component but
    never name one (unless all its ids are null).  An empty table gives no rows."""
    spark = prepare(docs.sparkSession)
    every = fingerprints(docs, id_col, text_col).checkpoint()
    distinct = every.groupBy("fp").agg(F.min("_id").alias("least")).checkpoint()
    roots = components(links(distinct, spark, distinct.count(), radius))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")).checkpoint()
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = salted_join(named, least, "root", by=F.col("fp")).select(F.col("fp").alias("_fp"), "component_id")
    return salted_join(every.withColumnRenamed("fp", "_fp"), by_fp, "_fp", by=F.monotonically_increasing_id()).select(F.col("_id").alias(id_col), F.col("_fp").alias("fp"), "component_id")


def collisions(items: DataFrame, spark: SparkSession, radius: int = RADIUS) -> DataFrame:
    """Pairs (x, y), x < y, of items (columns item, fp; distinct) that chain all whose fingerprints are equal or within radius bits."""
    points = items.groupBy("fp").agg(F.min("item").alias("first"), F.count(F.lit(1)).alias("n")).checkpoint()
    equal = salted_join(items.select("item", "fp"), points.where("n > 1").select("fp", "first"), "fp", by=F.col("item")).where("item != first").select(F.col("first").alias("p"), F.col("item").alias("q"))
    near = links(points, spark, points.count(), radius, chained=False).checkpoint()
    release(spark)
    named = points.select("fp", "first")
    near = near.join(named.toDF("a", "p"), "a").join(named.toDF("b", "q"), "b").select("p", "q")
    return equal.unionAll(near).select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each group left: of texts whose five-word shingles have a Jaccard similarity of 0.8, or that
    are joined by others that have.  The row of the smallest id stays, null ids last, equal ones by a hash of the row.

    Fingerprints of the sets of shingles that collide under ball hashing are candidates; each is verified on the whole sets.  Four of 64 bits
    is less than such sets may differ in, so sets that share one of their rarest shingles are candidates too (resemble.py), and none is missed.
    Texts without words are one group.  Rows are told apart by id and a hash of all columns, so rows of one id but other texts are
    judged each for itself, and so are rows without id.  An empty table gives no rows."""
    spark = prepare(docs.sparkSession)
    names = [f"d{i}" for i in range(len(docs.columns))]
    id_name, text_name = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    own = docs.toDF(*names).withColumn("_h", F.xxhash64(*names))
    rows = resemble.keyed(own, text_name, id_name, "_h").checkpoint()
    items = rows.groupBy("item").agg(*[F.min(c).alias(c) for c in ("fp", "n", "sketch")]).checkpoint()
    found = resemble.roots(own, text_name, items.select("item", "n", "sketch"), collisions(items.select("item", "fp"), spark))
    place = F.struct(F.col(id_name).isNull().alias("no"), F.col(id_name).alias("id"), F.col("_h").alias("h"))
    placed = salted_join(rows.select("item", place.alias("_place")), found.withColumnRenamed("node", "item"), "item", by=F.col("_place.h"), how="left").select(F.coalesce("root", "item").alias("_root"), "_place").checkpoint()
    first = placed.groupBy("_root").agg(F.min("_place").alias("_first"))
    gone = salted_join(placed, first, "_root", by=F.col("_place.h")).where(~F.col("_place").eqNullSafe(F.col("_first"))).select(F.col("_place.id").alias("_gone"), F.col("_place.h").alias("_gone_h")).distinct()
    left = own.join(gone, F.col(id_name).eqNullSafe(F.col("_gone")) & (F.col("_h") == F.col("_gone_h")), "left_anti")
    if rows.groupBy(id_name, "_h").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates([id_name, "_h"])
    return left.select(*names).toDF(*docs.columns)


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
