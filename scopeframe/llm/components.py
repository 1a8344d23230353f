"""Connected components of a table of links, by alternating star operations.

Each round replaces links by links to smaller neighbours.  Minima are grouped
aggregates with map-side combining and are joined back, so no neighbourhood is
ever gathered in one task, however large it is.

A round has eight stages, each with a task for every partition.  As soon as no more
than FEW links are left, one task ends the work, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import release

#: So many links, 16 bytes each, one task takes; more go through rounds.
FEW = 1 << 20


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of these links, sorted, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # the larger root of each link goes below the smallest that it is linked with, then paths are cut to their ends
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := root[root], root):
            root = above
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _at_once(links: DataFrame) -> DataFrame:
    """(node, root) of checkpointed links, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
        if not held:
            return
        node, root = smallest(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        below = node != root
        node, root = node[below], root[below]
        for lo in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + (1 << 16)]), pa.array(root[lo : lo + (1 << 16)])], names=["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long").checkpoint()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
    return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a < b, distinct.  Returns one row (node, root) for every node but the
    roots themselves; root is the smallest node that links reach."""
    now = links.select("a", "b").checkpoint()
    before = None
    for _ in range(most_rounds):
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        if after[0] <= FEW:
            return _at_once(now)
        before = after
        now = _small_star(_large_star(now)).checkpoint()
        # a round has seven exchanges, each with files for every partition however few the links are
        release(links.sparkSession)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
