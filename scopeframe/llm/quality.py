"""Quality score of whole texts by a byte-level convolutional network, in numpy.

FILTERS learned filters of WIDTH bytes run over each text.  Positions form chunks
of CHUNK bytes; a filter looks WIDTH - 1 bytes into the next chunk, so chunks
overlap and nothing falls between.  Each filter is max-pooled over a chunk; a
document has, for each filter, the mean and the largest of its chunks, which a
logistic layer combines into one probability.

The network is fitted on the driver on a bounded sample: SAMPLE_ROWS labelled rows
at most, those with the smallest hashes of their id, with their whole texts (of SAMPLE_BYTES
at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .wordbuf import pieces

FILTERS, WIDTH, CHUNK = 8, 6, 256
SAMPLE_ROWS, EPOCHS = 1500, 12
#: The sample goes to the driver, so longer texts aren't in it.
SAMPLE_BYTES = 1 << 16
CUT = 0.3


class Network:
    """weights: (WIDTH, 256, FILTERS), one row of each filter's weights for every byte at every offset."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.weights = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.out = r.normal(0, 0.3, 2 * FILTERS)
        self.bias = 0.0

    def freeze(self) -> Network:
        """Tables for pairs of bytes, which take half the lookups."""
        self.pairs = [(self.weights[k][:, None, :] + self.weights[k + 1][None, :, :]).reshape(1 << 16, FILTERS) for k in range(0, WIDTH, 2)]
        return self

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Of every filter at every position of data, which has WIDTH - 1 more bytes."""
        n = len(data) - WIDTH + 1
        pair = data[:-1].astype(np.int32) << 8 | data[1:]
        z = self.pairs[0].take(pair[:n], axis=0)
        for k in range(1, WIDTH // 2):
            z += self.pairs[k].take(pair[2 * k : 2 * k + n], axis=0)
        return z

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """A probability for each text; texts are whole, and an empty one has no chunk (all its features are zero)."""
        gap = bytes(WIDTH - 1)
        feature = np.zeros((len(texts), 2 * FILTERS))
        some = [i for i, t in enumerate(texts) if t]
        if some:
            # a text's last positions look into the gap behind it
            data = np.frombuffer(gap.join([texts[i] for i in some]) + gap, np.uint8)
            size = np.array([len(texts[i]) for i in some])
            begin = np.cumsum(size + len(gap)) - size - len(gap)
            chunks = -(-size // CHUNK)
            doc = np.repeat(np.arange(len(some)), chunks)
            at = begin[doc] + CHUNK * (np.arange(len(doc)) - (np.cumsum(chunks) - chunks)[doc])
            # cut at the ends of texts too, and leave the gaps' own positions out
            cuts = np.sort(np.r_[at, (begin + size)[:-1]])
            z = self.responses(data)
            pooled = np.maximum(np.maximum.reduceat(z, cuts, axis=0), 0)[np.searchsorted(cuts, at)]
            first = np.cumsum(chunks) - chunks
            feature[some, :FILTERS] = np.add.reduceat(pooled.astype(np.float64), first, axis=0) / chunks[:, None]
            feature[some, FILTERS:] = np.maximum.reduceat(pooled, first, axis=0)
        return 1 / (1 + np.exp(-np.clip(feature @ self.out + self.bias, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the cross entropy; the gradient of a maximum goes to its position only."""
    net = Network(seed)
    if not len(texts) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        net.weights[:] = 0
        net.bias = float(np.log(share / (1 - share)))
        return net.freeze()
    net.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    params = [net.weights, net.out, np.array([net.bias])]
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in params]
    r = np.random.default_rng(seed)
    step, batch = 0, 32
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), batch):
            net.freeze()
            grads = [np.zeros(p.shape) for p in params]
            some = order[lo : lo + batch]
            for i in some:
                data = np.frombuffer(texts[i] + bytes(WIDTH - 1), np.uint8)
                n = len(texts[i])
                if not n:
                    continue
                z = net.responses(data)
                cuts = np.arange(0, n, CHUNK)
                where = np.empty((len(cuts), FILTERS), np.int64)
                for c, a in enumerate(cuts):
                    where[c] = a + z[a : min(a + CHUNK, n)].argmax(axis=0)
                top = np.take_along_axis(z, where, axis=0)
                pooled = np.maximum(top, 0)
                best = pooled.argmax(axis=0)
                feature = np.r_[pooled.mean(axis=0), pooled[best, np.arange(FILTERS)]]
                error = 1 / (1 + np.exp(-np.clip(feature @ params[1] + params[2][0], -30, 30))) - labels[i]
                grads[1] += error * feature
                grads[2] += error
                back = np.repeat(error * params[1][None, :FILTERS] / len(cuts), len(cuts), axis=0)
                back[best, np.arange(FILTERS)] += error * params[1][FILTERS:]
                back *= top > 0
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (data[where + k], np.arange(FILTERS)[None, :]), back)
            step += 1
            rate = 0.02 * (1 - epoch / epochs)
            for p, g, (m, s) in zip(params, grads, moments, strict=True):
                g = g / len(some) + 1e-4 * p
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(p.dtype)
            net.bias = float(params[2][0])
    return net.freeze()


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most rows labelled documents outside the held-out fold, those with texts over most_bytes left out.  Of
    labels and texts that share an id, the least are taken."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0))
    chosen = chosen.groupBy(F.col("doc_id").alias("_l")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("_l"), "_l").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).where(F.octet_length("t") <= most_bytes).join(F.broadcast(chosen), F.col("doc_id") == F.col("_l"))
    got = sorted(tuple(r) for r in found.groupBy("_l", "quality").agg(F.min("t")).collect())
    return [t.encode() for *_, t in got], np.array([float(q) for _, q, _ in got])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row.  Null and empty texts get the score of an empty text; equal texts equal scores."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text", 1 << 19):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(texts))], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} {kind}, score double")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    scored = score(docs, fit(*sample(docs, labels)))
    return scored.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
