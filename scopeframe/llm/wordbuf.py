"""Words of many texts as flat numpy arrays.

A batch of texts becomes one byte buffer in which every word is followed by
one space, plus the offsets of words and documents in it.  Hashes of any run
of words come from one prefix sum, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that the order of hashes is close to random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """data: the words, each followed by a space; word i is data[off[i]:off[i + 1] - 1].
    Words of text d: first[d] to first[d + 1]."""

    def __init__(self, texts: list[bytes | None], spaces: bytes = SPACES, translate: bytes | None = None):
        raw = b" ".join([t or b"" for t in texts]) + b" "
        if translate is not None:
            raw = raw.translate(translate)
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=starts[1:])
        source = np.frombuffer(raw, np.uint8)
        table = np.zeros(256, bool)
        table[list(spaces)] = True
        space = table[source]
        end = space.copy()
        end[0] = False
        end[1:] &= ~space[:-1]
        kept = source[end | ~space]
        kept_end = end[end | ~space]
        kept = kept.copy()
        kept[kept_end] = 32
        self.bytes = kept
        self.data = kept.tobytes()
        self.off = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(kept_end) + 1])
        self.first = np.searchsorted(np.flatnonzero(end), starts, side="left")
        self.first[0], self.first[-1] = 0, len(self.off) - 1
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.off) - 1

    def runs(self, n: int, start: np.ndarray) -> np.ndarray:
        """Hashes of the n words from each word of start on (all must exist)."""
        if self._sums is None:
            power, _ = powers(len(self.bytes))
            sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
            self._sums = sums
        _, inverse = powers(len(self.bytes) + 1)
        at = self.off[start]
        return mix((self._sums[self.off[start + n] - 1] - self._sums[at]) * inverse[at])

    def starts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every run of n words inside one text: its first word and its text."""
        count = np.maximum(np.diff(self.first) - (n - 1), 0)
        text = np.repeat(np.arange(len(count)), count)
        shift = np.cumsum(count) - count
        return np.arange(len(text)) - shift[text] + self.first[:-1][text], text


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    if pa.types.is_null(column.type):
        return [None] * len(column)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], name: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about limit bytes of text at most (a longer text comes alone), and their texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        sizes = [0] * len(column) if pa.types.is_null(column.type) else pc.fill_null(pc.binary_length(column), 0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            size += 64
            if held and held + size > limit:
                yield batch.slice(begin, i - begin), as_bytes(column.slice(begin, i - begin))
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin), as_bytes(column.slice(begin))
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers are kept for later tasks, beside others'."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
