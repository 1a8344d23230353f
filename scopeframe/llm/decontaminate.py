"""Benchmark items inside documents: size-partitioned MinHash containment search.

A document holds an item if it has at least 0.8 of the item's distinct
five-word shingles.  Such a document lacks at most n - ceil(0.8 n) of them, so
it has at least one of the item's n - ceil(0.8 n) + 1 smallest hash values:
these are the item's MinHash signature, and looking them up finds every match.
Items are partitioned by size, and in each partition only a document's hash
values up to the partition's largest signature value are looked up: the cost of
a long document doesn't depend on how short the items are.  Candidates are
verified by the shingles' own bytes.

Words are runs of letters, digits and non-ASCII characters of the lower-cased
text.  An item of fewer than five words is one shingle, of all its words; one
without words is in no document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .runtime import prepare
from .wordbuf import Words, as_bytes, pieces

SHINGLE, CONTAINED = 5, 0.8
#: Bytes of item text held in memory at once; more items are searched for in blocks of about this size.
BLOCK_BYTES = 32 << 20
BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())


def lowered(texts: list[bytes | None]) -> list[bytes]:
    return as_bytes(pc.utf8_lower(pa.array([t or b"" for t in texts], pa.binary()).cast(pa.string())))


class Items:
    """The signatures and shingles of a block of items."""

    def __init__(self, texts: list[bytes | None], contained: float = CONTAINED):
        words = Words(lowered(texts), BREAKS)
        count = np.diff(words.first)
        self.shingles: list[frozenset[bytes]] = []
        self.size: list[int] = []
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, n in enumerate(count.tolist()):
            size = min(n, SHINGLE)
            self.size.append(size)
            if not n:
                self.shingles.append(frozenset())
                continue
            start = np.arange(words.first[i], words.first[i + 1] - size + 1)
            by = {words.data[words.off[s] : words.off[s + size] - 1]: h for s, h in zip(start.tolist(), words.runs(size, start).tolist(), strict=True)}
            self.shingles.append(frozenset(by))
            missing = len(by) - int(np.ceil(contained * len(by) - 1e-9))
            for h in sorted(by.values())[: missing + 1]:
                found.setdefault((size, len(by).bit_length()), []).append((h, i))
        #: shingle size -> (table of the hashes' first bits, partitions (largest, hashes, items))
        self.by_size: dict[int, tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]] = {}
        for (size, _), pairs in sorted(found.items()):
            hashes = np.array([h for h, _ in sorted(pairs)], np.uint64)
            seen, parts = self.by_size.setdefault(size, (np.zeros(1 << 20, bool), []))
            seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
            parts.append((hashes[-1], hashes, np.array([i for _, i in sorted(pairs)])))

    def find(self, texts: list[bytes | None], contained: float = CONTAINED) -> Iterator[tuple[int, int, int]]:
        """(text, item, shingles shared) of every match."""
        words = Words(lowered(texts), BREAKS)
        candidates: set[tuple[int, int]] = set()
        for size, (seen, parts) in self.by_size.items():
            start, text = words.starts(size)
            hashes = words.runs(size, start)
            near = np.flatnonzero(seen[(hashes >> np.uint64(44)).astype(np.int64)])
            hashes, text = hashes[near], text[near]
            for largest, signature, items in parts:
                sketch = np.flatnonzero(hashes <= largest)
                lo, hi = np.searchsorted(signature, hashes[sketch], "left"), np.searchsorted(signature, hashes[sketch], "right")
                for k in np.flatnonzero(hi > lo).tolist():
                    candidates.update((int(text[sketch[k]]), int(i)) for i in items[lo[k] : hi[k]])
        held: tuple[int, int] = (-1, 0)
        have: set[bytes] = set()
        for text, item in sorted(candidates, key=lambda x: (x[0], self.size[x[1]], x[1])):
            size = self.size[item]
            if held != (text, size):
                held, off = (text, size), words.off[words.first[text] : words.first[text + 1] + 1].tolist()
                have = {words.data[a : b - 1] for a, b in zip(off, off[size:], strict=False)}
            shared = len(self.shingles[item] & have)
            if shared >= contained * len(self.shingles[item]) - 1e-9:
                yield text, item, shared


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, Items]]:
    """The items' ids and their index, at most about block_bytes of text at a time."""
    picked = items.select(F.col(id_col).alias("_item"), F.col(text_col).alias("_text"))
    total = picked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    count = -(-total // block_bytes) or 1
    for k in range(count):
        rows = picked.where(F.pmod(F.xxhash64("_text"), F.lit(count)) == k).distinct().collect()
        yield [r._item for r in rows], Items([r._text.encode() if r._text is not None else None for r in rows])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, n_shared, n_item, containment): every document with every item it holds.

    Rows that repeat give rows that repeat; items that repeat are one.  Null and
    empty texts hold nothing and are held by nothing."""
    spark = prepare(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_col].dataType)
    found = []
    for names, index in blocks(items, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast((names, index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, index = shared.value
            for batch, texts in pieces(batches, "_text"):
                hits = list(index.find(texts))
                if hits:
                    rows = [hits[i][0] for i in range(len(hits))]
                    n = [len(index.shingles[i]) for _, i, _ in hits]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array([names[i] for _, i, _ in hits], item_type), pa.array([s for *_, s in hits], pa.int64()), pa.array(n, pa.int64()), pa.array([s / m for (*_, s), m in zip(hits, n, strict=True)], pa.float64())],
                        names=[id_col, item_col, "n_shared", "n_item", "containment"],
                    )

        found.append(picked.mapInArrow(run, f"{id_col} {kinds[0]}, {item_col} {kinds[1]}, n_shared long, n_item long, containment double"))
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item; whole rows pass through, and nothing is shuffled.

    Null and empty texts hold nothing and stay; rows that repeat stay or go together; without items all stay.  An empty table gives no rows."""
    spark = prepare(docs.sparkSession)
    place = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    for _, index in blocks(items, items.columns[0], item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches, f"c{place}"):
                keep = np.ones(len(texts), bool)
                keep[[text for text, *_ in shared.value.find(texts)]] = False
                yield batch.filter(pa.array(keep))

        schema = docs.schema
        renamed = docs.toDF(*names)
        docs = renamed.mapInArrow(run, renamed.schema).toDF(*schema.names)
    return docs


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment."""
    return search(docs, benchmark)
