"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi.

The automaton holds all pieces, as UTF-8 bytes.  In one pass over a word it gives, at
each end, the pieces that end there (longest first, by its output links), and the
best score up to that end is relaxed over them.  Many words take each step at
once, as numpy arrays; very long ones alone.  Each character is also an edge of its own,
with the score of an unknown: those that no piece covers are encoded as byte pieces.

Spaces become U+2581, one is put in front.  No piece may hold a U+2581 after
another character (checked), so words are independent: the best encoding of a
text is that of its words, and each distinct word of a slice is encoded once.  A
U+2581 in the text itself is encoded as bytes, so decoding gives back the text.
"""

from __future__ import annotations

import array
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .wordbuf import mix, pieces, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of text encoded at once.
SLICE_BYTES = 1 << 19
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id."""
    out = []
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif k == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


class Automaton:
    """Aho-Corasick over byte strings, as tables: moves[width * state + column[byte]], and for each state the
    longest pattern that ends there and, for each pattern, the next shorter one (its output link)."""

    def __init__(self, patterns: list[tuple[bytes, int, float]], byte_ids: list[int], unknown: float):
        children: list[dict[int, int]] = [{}]
        of_state: dict[int, int] = {}
        for k, (pattern, _, _) in enumerate(patterns):
            at = 0
            for byte in pattern:
                to = children[at].get(byte)
                if to is None:
                    to = children[at][byte] = len(children)
                    children.append({})
                at = to
            of_state[at] = k + 1
        used = sorted({b for p, _, _ in patterns for b in p})
        #: bytes that no pattern has are one column
        self.column = np.full(256, len(used), np.int64)
        self.column[used] = np.arange(len(used))
        self.width = len(used) + 1
        column = self.column.tolist()
        self.moves = np.zeros((len(children), self.width), np.uint16 if len(children) <= 1 << 16 else np.int32)
        self.longest = np.zeros(len(children), np.int32)
        #: by pattern number; number 0 is none
        self.link = np.zeros(len(patterns) + 1, np.int32)
        self.length = np.array([0] + [len(p) for p, _, _ in patterns], np.int64)
        self.ident = np.array([0] + [i for _, i, _ in patterns], np.uint16)
        self.score = np.array([0.0] + [s for _, _, s in patterns])
        self.byte_ids, self.unknown = np.array(byte_ids, np.uint16), unknown
        fails, row = [0] * len(children), [0]
        while row:
            below = []
            for state in row:
                fail = fails[state]
                if state:
                    self.moves[state] = self.moves[fail]
                    self.longest[state] = self.longest[fail]
                    if own := of_state.get(state, 0):
                        self.link[own] = self.longest[fail]
                        self.longest[state] = own
                for byte, to in children[state].items():
                    fails[to] = self.moves[fail, column[byte]] if state else 0
                    self.moves[state, column[byte]] = to
                    below.append(to)
            row = below
        self.moves = self.moves.ravel()

    def best_paths(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: a row a word, zero-padded, longest first.  (ids, right-aligned; their number).

        Every character is also an edge of its own with the score of an unknown, written as its bytes; pieces win over it."""
        n, width = words.shape
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        scores, back = best.ravel(), np.full((width + 1, n), -1, np.int32)
        state, lead = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for end in range(1, width + 1):
            k = int(np.searchsorted(-lengths, -end, side="right"))  # words that reach this end
            state[:k] = self.moves[state[:k] * self.width + self.column[words[:k, end - 1]]]
            whole = np.flatnonzero((words[:k, end] & 0xC0) != 0x80) if end < width else np.arange(k)
            row, from_ = best[end], back[end]
            row[whole] = scores[lead[whole] * n + whole] + self.unknown
            lead[whole] = end
            pattern = self.longest[state[:k]]
            at = np.flatnonzero(pattern)
            pattern = pattern[at]
            while len(at):
                total = scores[(end - self.length[pattern]) * n + at] + self.score[pattern]
                better = np.flatnonzero(total > row[at])
                to = at[better]
                row[to] = total[better]
                from_[to] = pattern[better]
                pattern = self.link[pattern]
                more = np.flatnonzero(pattern)
                at, pattern = at[more], pattern[more]
        ids, count, left = np.zeros((n, width), np.uint16), np.zeros(n, np.int64), lengths.copy()
        at, step = np.flatnonzero(lengths), width
        while len(at):
            step -= 1
            pattern = back[left[at], at]
            # inside an unknown character every place leads one byte back
            ids[at, step] = np.where(pattern < 0, self.byte_ids[words[at, left[at] - 1]], self.ident[pattern])
            count[at] += 1
            left[at] -= np.where(pattern < 0, 1, self.length[pattern])
            at = at[left[at] > 0]
        return ids, count

    @functools.cached_property
    def lists(self) -> tuple[list, ...]:
        return tuple(x.tolist() for x in (self.longest, self.link, self.length, self.ident, self.score, self.byte_ids))

    def best_path(self, word: bytes) -> np.ndarray:
        """The same for one word, step by step, in memory by its length: for words too long to lie beside others."""
        longest, link, length, ident, score, byte_ids = self.lists
        moves, n, width = self.moves, len(word), self.width
        column = self.column.tolist()
        best, back = array.array("d", [0.0]) * (n + 1), array.array("i", [-1]) * (n + 1)
        state = lead = 0
        for end in range(1, n + 1):
            state = int(moves[state * width + column[word[end - 1]]])
            if end < n and word[end] & 0xC0 == 0x80:
                continue
            top, by = best[lead] + self.unknown, -1
            pattern = longest[state]
            while pattern:
                total = best[end - length[pattern]] + score[pattern]
                if total > top:
                    top, by = total, pattern
                pattern = link[pattern]
            best[end], back[end], lead = top, by, end
        out, at = [], n
        while at:
            by = back[at]
            out.append(byte_ids[word[at - 1]] if by < 0 else ident[by])
            at -= 1 if by < 0 else length[by]
        return np.array(out[::-1], np.uint16)


@dataclass
class Vocabulary:
    automaton: Automaton
    scores: dict[str, tuple[int, float]]
    longest: int
    decoded: list[bytes]
    byte_ids: list[int]
    unknown: float
    #: ASCII bytes outside all pieces: they stand alone
    alone: np.ndarray


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    decoded, byte_ids, scores = [], [-1] * 256, {}
    for i, (piece, score, kind) in enumerate(read_model(model)):
        if kind == BYTE:
            byte_ids[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
            continue
        decoded.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
        if kind in (NORMAL, USER):
            if SPACE in piece.lstrip(SPACE) or " " in piece:
                raise ValueError(f"piece {i} spans words")
            scores[piece.replace(SPACE, " ")] = (i, score)
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte pieces")
    if len(decoded) > 1 << 16:
        raise ValueError("ids take more than 16 bits")
    alphabet = set("".join(scores))
    if any(c not in scores for c in alphabet):
        raise ValueError("a character occurs in pieces but is none")
    least = min((s for _, s in scores.values()), default=0.0)
    automaton = Automaton([(p.encode(), i, s) for p, (i, s) in scores.items()], byte_ids, least - UNKNOWN_PENALTY)
    alone = np.array([b < 128 and chr(b) not in alphabet for b in range(256)])
    return Vocabulary(automaton, scores, max(map(len, scores), default=0), decoded, byte_ids, least - UNKNOWN_PENALTY, alone)


def viterbi(v: Vocabulary, word: str) -> tuple[list[int], float]:
    """Ids of the best encoding of one string and its score, without the automaton: a plain form to hold it against.  Of equal scores the
    longest last piece wins."""
    best, back = [0.0], [(0, -1)]
    for end in range(1, len(word) + 1):
        best.append(best[end - 1] + v.unknown)
        back.append((end - 1, -1))
        for start in range(max(0, end - v.longest), end):
            found = v.scores.get(word[start:end])
            if found and best[start] + found[1] > best[end]:
                best[end], back[end] = best[start] + found[1], (start, found[0])
    ids: list[int] = []
    at = len(word)
    while at:
        start, ident = back[at]
        ids += [ident] if ident >= 0 else [v.byte_ids[b] for b in reversed(word[start:at].encode())]
        at = start
    return ids[::-1], best[-1]


#: Bytes of the longest word that lies beside others in arrays; longer ones take the same steps one by one.
WIDTH = 128


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from each place of a on are those from the place of b on."""
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(at.astype(np.int32), length)
    same = data[np.repeat(a.astype(np.int32), length) + place] == data[np.repeat(b.astype(np.int32), length) + place]
    return np.logical_and.reduceat(same, at)


def encode(v: Vocabulary, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the place of each text's first id (and the end).

    Equal words are encoded once: those of equal hashes whose bytes agree."""
    raw = b"".join([b" " + t for t in texts if t])
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
    begins = np.cumsum(sizes) - sizes
    space, alone = data == 32, v.alone[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut |= alone
    cut[1:] |= alone[:-1]
    cut[begins[sizes > 0]] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.r_[start, len(data)])
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    hashes = mix((sums[start + length] - sums[start]) * inverse[start]) + mix(length.astype(np.uint64))
    _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
    same = same.ravel()
    unlike = length[first][same] != length
    unlike[~unlike] = ~equal(data, start[~unlike], start[first][same[~unlike]], length[~unlike])
    if unlike.any():
        # words that only share a hash with another get numbers of their own
        place = np.flatnonzero(unlike)
        own: dict[bytes, int] = {}
        for k in place.tolist():
            same[k] = len(first) + own.setdefault(raw[start[k] : start[k] + length[k]], len(own))
        first = np.r_[first, place[np.unique(same[place], return_index=True)[1]]]

    words, size = start[first], length[first]
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words, size = words[order], size[order]
    slow = int(np.searchsorted(-size, -WIDTH, side="left"))
    ids: list[np.ndarray] = []
    count = np.zeros(len(size), np.int64)
    for k in range(slow):
        ids.append(v.automaton.best_path(raw[words[k] : words[k] + size[k]]))
        count[k] = len(ids[-1])
    for lo in range(slow, len(size), 1 << 14):
        hi = min(lo + (1 << 14), len(size))
        width = int(size[lo])
        at = words[lo:hi, None] + np.arange(width)
        found, count[lo:hi] = v.automaton.best_paths(np.where(np.arange(width) < size[lo:hi, None], data[np.minimum(at, len(data) - 1)], 0), size[lo:hi])
        ids.append(found[np.arange(width) >= width - count[lo:hi, None]])
    packed, at = np.concatenate(ids), np.cumsum(count) - count
    word = rank[same]
    many = count[word]
    stop = np.cumsum(many)
    out = packed[np.repeat(at[word] - (stop - many), many) + np.arange(stop[-1])]
    text_stop = np.searchsorted(start, begins + sizes, side="left")
    return out, np.r_[0, np.r_[0, stop][text_stop]]


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    table = v.decoded
    return b"".join([table[i] for i in ids.tolist()])[1:]


def read_bytes(path: str) -> bytes:
    """A model is a small file of the driver's image; its bytes go to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, round_trip: bool = True) -> DataFrame:
    """(id, ids, n_chars, n_pieces, ids_sha256, decoded_sha256, decoded_ok).

    Null and empty texts have no ids.  Each row is encoded whole; ids_sha256 is of
    the ids as little-endian 16-bit integers, decoded_sha256 of what they decode to."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_bytes(model))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "ids", "n_chars", "n_pieces", "ids_sha256", "decoded_sha256", "decoded_ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch, texts in pieces(batches, "_text", SLICE_BYTES):
            ids, at = encode(v, texts)
            split = np.split(ids, at[1:-1])
            back = [decode(v, x) if len(x) else b"" for x in split]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.array([len(t.decode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in split]),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                    pa.array([b == (t or b"") for b, t in zip(back, texts, strict=True)], pa.bool_()),
                ],
                names=names,
            )

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, decoded_ok boolean")


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_sha256, decoded_sha256, decoded_ok."""
    return tokenize(docs).drop("ids")


