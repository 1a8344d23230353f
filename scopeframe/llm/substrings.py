"""Exact removal of repeated word windows, by super-k-mer partitioning.

A window's minimiser is the smallest hash among its four-word grams.
Consecutive windows with the same minimiser value form a super-k-mer, which
travels as one packed string to the minimiser's bucket.  Equal windows have equal
minimisers, so a bucket sees all copies of its windows; it sorts their hashes and
compares the words themselves where hashes agree.

Against hot keys: grams that make up more than SHARE of all grams are ordered
last (a first pass finds these; there can be at most 4 / (3 SHARE) of them), so a
common line is no common minimiser; and a super-k-mer found twice in one slice of
the input is settled there and sent on once.  Results are keyed by a digest of the
text, since equal texts lose the same words; a text with very many copies meets them in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import parts, prepare, release, salted_join
from .wordbuf import Words, mix, pieces

WINDOW, GRAM = 35, 4
#: A text with as many words as a window, found in one pass.
LONG = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{WINDOW - 1}}}[^\x20\x09-\x0D]"
#: A gram is hot if it makes up more than this share of all grams.
SHARE = 1 / 4000
#: Bytes of packed strings a task holds before it sends them on.
HELD_BYTES = 20 << 20
#: How hard they are squeezed: level 5 takes a tenth less than 1, for 17 CPU seconds a GB.
LEVEL = 5
KEY_BYTES = 12
#: Buckets for each shuffle partition; one bucket at a time is unpacked.
BUCKETS = 16


def key_of(text: bytes | None) -> bytes:
    return hashlib.md5(text or b"", usedforsecurity=False).digest()[:KEY_BYTES]


def hot_grams(docs: DataFrame, share: float = SHARE) -> np.ndarray:
    """Sorted hashes of the grams over the share; column _text.

    A slice reports the grams over a quarter of the share in it.  So the reported
    counts of a gram over the share come to three quarters of it at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, texts in pieces(batches, "_text"):
            words = Words(texts)
            start, _ = words.starts(GRAM)
            if len(start):
                values, count = np.unique(words.runs(GRAM, start), return_counts=True)
                total += len(start)
                much = count > len(start) * share / 4
                yield pa.RecordBatch.from_arrays([pa.array(values[much].view(np.int64)), pa.array(count[much])], names=["gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["gram", "n"])

    counts = docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).checkpoint()
    total = counts.where("gram is null").agg(F.sum("n")).first()[0] or 0
    rows = counts.where("gram is not null").where(F.col("n") > 0.75 * share * total).select("gram").collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


class Minimisers:
    def __init__(self, hot: np.ndarray):
        self.hot = hot
        self.near = np.zeros(1 << 16, bool)
        self.near[(hot >> np.uint64(48)).astype(np.int64)] = True

    def super_kmers(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of windows, text and minimiser of every super-k-mer."""
        start, text = words.starts(WINDOW)
        if not len(start):
            return start, start, text, np.zeros(0, np.uint64)
        rank = words.runs(GRAM, np.arange(len(words) - GRAM + 1))
        near = np.flatnonzero(self.near[(rank >> np.uint64(48)).astype(np.int64)])
        late = near[np.isin(rank[near], self.hot)]
        rank >>= np.uint64(1)
        rank[late] |= np.uint64(1 << 63)
        grams, have = WINDOW - GRAM + 1, 1
        while have < grams:
            step = min(have, grams - have)
            rank = np.minimum(rank[:-step], rank[step:])
            have += step
        least = rank[start]
        first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
        return start[first], np.diff(np.r_[first, len(start)]), text[first], least[first]


def covered(starts: np.ndarray) -> np.ndarray:
    """Pairs (from, to) of the words that windows at these sorted places cover."""
    cut = np.flatnonzero(np.diff(starts) > WINDOW)
    return np.stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + WINDOW], axis=1).astype(np.int32)


class _Spans:
    """Repeated spans by key, given out as (bucket, key, spans)."""

    def __init__(self, buckets: int):
        self.by_key: dict[bytes, list[np.ndarray]] = {}
        self.buckets, self.n = buckets, 0

    def add(self, key: bytes, spans: np.ndarray) -> None:
        self.by_key.setdefault(key, []).append(spans)
        self.n += len(spans)

    def out(self) -> Iterator[pa.RecordBatch]:
        items = sorted(self.by_key.items())
        self.by_key, self.n = {}, 0
        for lo in range(0, len(items), 1 << 14):
            some = items[lo : lo + (1 << 14)]
            keys, spans = [k for k, _ in some], [np.unique(np.concatenate(v), axis=0).tobytes() for _, v in some]
            bucket = [-1 - int.from_bytes(k[:6], "big") % self.buckets for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(keys, pa.binary()), pa.array(spans, pa.binary())], names=["bucket", "head", "body"])


def pack(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, head, body): super-k-mers packed by bucket (0 and up), or a key and its spans settled already (below 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minimisers, squeeze = Minimisers(hot), zstandard.ZstdCompressor(level=LEVEL)
        held: dict[int, tuple[list[bytes], list[bytes], list[tuple[int, int]]]] = {}
        size, spans = 0, _Spans(buckets)

        def flush() -> Iterator[pa.RecordBatch]:
            names, heads, bodies = [], [], []
            for bucket, (strings, keys, numbers) in held.items():
                names.append(bucket)
                heads.append(np.array(numbers, np.int32).tobytes() + b"".join(keys))
                bodies.append(squeeze.compress(b"\n".join(strings)))
            held.clear()
            for lo in range(0, len(names), 512):
                at = slice(lo, lo + 512)
                yield pa.RecordBatch.from_arrays([pa.array(names[at], pa.int64()), pa.array(heads[at], pa.binary()), pa.array(bodies[at], pa.binary())], names=["bucket", "head", "body"])
            yield from spans.out()

        for _, texts in pieces(batches, "_text"):
            words = Words(texts)
            start, count, text, least = minimisers.super_kmers(words)
            if not len(start):
                continue
            keys = [key_of(t) for t in texts]
            bucket = (mix(least) % np.uint64(buckets)).tolist()
            begin, end = words.off[start].tolist(), (words.off[start + count + WINDOW - 1] - 1).tolist()
            local = (start - words.first[text]).tolist()
            data, seen = words.data, {}
            for i, (a, b) in enumerate(zip(begin, end, strict=True)):
                seen.setdefault(data[a:b], []).append(i)
            count, text = count.tolist(), text.tolist()
            for string, at in seen.items():
                i = at[0]
                if len(at) > 1:
                    for j in at:
                        spans.add(keys[text[j]], np.array([[local[j], local[j] + count[j] + WINDOW - 1]], np.int32))
                strings, names, numbers = held.setdefault(bucket[i], ([], [], []))
                strings.append(string)
                names.append(keys[text[i]])
                numbers.append((local[i], len(at)))
                size += len(string) + 80
            if size + 80 * spans.n > HELD_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return docs.mapInArrow(run, "bucket long, head binary, body binary")


def repeated(strings: list[bytes], twice: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of the super-k-mers of a bucket, and the first word and string of each window that occurs more than once."""
    words = Words(strings, b"\n ")
    start, string = words.starts(WINDOW)
    hashes = words.runs(WINDOW, start)
    again = twice[string]
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    same = sorted_[1:] == sorted_[:-1]
    group = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    members, value = order[group], sorted_[group]
    head = np.r_[True, value[1:] != value[:-1]] if len(group) else np.zeros(0, bool)
    begin, end, data = words.off[start[members]].tolist(), (words.off[start[members] + WINDOW] - 1).tolist(), words.data
    texts: dict[bytes, list[int]] = {}
    found = []
    for k, (new, a, b) in enumerate(zip(head.tolist(), begin, end, strict=True)):
        if new:
            found += [v for v in texts.values() if len(v) > 1]
            texts = {}
        texts.setdefault(data[a:b], []).append(k)
    found += [v for v in texts.values() if len(v) > 1]
    again[members[[k for v in found for k in v]] if found else np.zeros(0, np.int64)] = True
    return words, start[again], string[again]


def _settle(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket is held at a time."""
    spans = _Spans(buckets)
    unsqueeze = zstandard.ZstdDecompressor()

    def settle(held: list[tuple[bytes, bytes]]) -> None:
        strings: list[bytes] = []
        places, twice, keys = [], [], []
        for head, body in held:
            own = unsqueeze.decompress(body).split(b"\n")
            numbers = np.frombuffer(head[: 8 * len(own)], np.int32).reshape(-1, 2)
            strings += own
            places.append(numbers[:, 0])
            twice.append(numbers[:, 1] > 1)
            keys += [head[k : k + KEY_BYTES] for k in range(8 * len(own), len(head), KEY_BYTES)]
        place = np.concatenate(places)
        words, start, string = repeated(strings, np.concatenate(twice))
        if not len(string):
            return
        at = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
        for lo, hi in zip(at, [*at[1:], len(string)], strict=True):
            s = string[lo]
            spans.add(keys[s], covered(start[lo:hi] - words.first[s] + place[s]))

    now, held = None, []
    for batch in batches:
        for bucket, head, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and bucket != now:
                settle(held)
                held = []
            now = bucket
            if bucket < 0:
                spans.add(head, np.frombuffer(body, np.int32).reshape(-1, 2))
            else:
                held.append((head, body))
            if spans.n > 1 << 20:
                yield from spans.out()
    if held:
        settle(held)
    yield from spans.out()


def repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_key, _spans): for the digest of a text, packed spans of words that a repeated window covers."""
    spark = prepare(docs.sparkSession)
    picked = docs.select(F.col(text_col).alias("_text"))
    buckets = BUCKETS * parts(spark)
    dealt = pack(picked, hot_grams(picked), buckets).repartition(parts(spark), "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _settle(batches, buckets)

    return dealt.mapInArrow(run, "bucket long, _key binary, spans binary").groupBy("_key").agg(F.collect_set("spans").alias("_spans"))


def without(words: Words, text: int, spans: list[bytes] | None) -> tuple[int, int, bytes]:
    """Number of words, number removed, what is left joined by spaces."""
    a, b = int(words.first[text]), int(words.first[text + 1])
    off = words.off
    if not spans:
        return b - a, 0, words.data[off[a] : max(off[a], off[b] - 1)]
    change = np.zeros(b - a + 1, np.int64)
    for lo, hi in np.concatenate([np.frombuffer(s, np.int32).reshape(-1, 2) for s in spans]).tolist():
        change[lo] += 1
        change[hi] -= 1
    keep = np.cumsum(change)[:-1] == 0
    edge = np.flatnonzero(np.diff(np.r_[False, keep, False].astype(np.int8)))
    left = b" ".join([words.data[off[a + x] : off[a + y] - 1] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
    return b - a, int((~keep).sum()), left


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): each row's text without the words that a repeated window covers.

    Null and empty texts have no words.  Rows that repeat repeat each other's
    windows, so they lose all words that a window covers."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    # texts with fewer words than a window lose none, so they go nowhere
    whole = F.coalesce(F.col(text_col).rlike(LONG), F.lit(False))
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), whole.alias("_long"))
    # written, so that the packed strings' files can go before texts travel
    spans = repeated_spans(docs, text_col).checkpoint()
    release(docs.sparkSession)
    keyed = picked.where("_long").withColumn("_key", F.substring(F.unhex(F.md5("_text")), 1, KEY_BYTES))
    met = salted_join(keyed, spans, "_key", by=F.monotonically_increasing_id(), how="left").select("_id", "_text", "_spans")
    joined = met.unionByName(picked.where("not _long").select("_id", "_text").withColumn("_spans", F.lit(None).cast("array<binary>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            words, spans = Words(texts), batch.column(2).to_pylist()
            rows = [without(words, i, spans[i]) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"{id_col} {kind}, n_words long, n_removed long, kept string")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
