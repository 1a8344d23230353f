"""What the operators need from the session: worker imports, checkpoints, tables."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: A key of fewer rows is never dealt over several tasks.
LEAST_HOT = 100


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, names a checkpoint folder and makes Arrow batches smaller.

    spark.checkpoint.dir is used where it is set; a temporary folder serves
    local sessions only.  A batch of texts is held several times over, in the executor and in its Python workers, so
    the limit of its bytes goes from Spark's default to ARROW_BYTES, unless the session has its own.
    """
    context = spark.sparkContext
    if spark.conf.get(_ARROW) == "67108864b":
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    path = context.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="scopeframe-checkpoints-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that are no longer referred to, such as those before a checkpoint.  It does so when the driver
    collects garbage, which a driver with little to do does only each half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[bytes]]]:
    """(key, blobs) of rows (key, blob) that come sorted by key; only one key's blobs are held."""
    now, held = None, []
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(blob)
    if held:
        yield now, held


def salted_join(left: DataFrame, right: DataFrame, on: str, by: Column, how: str = "inner", salts: int | None = None) -> DataFrame:
    """left joined with right, whose rows are distinct in on (at most one a key), on the column of this name.

    Null keys match nothing and are dealt over all tasks.  A key with over a quarter of a partition's share of left's rows is dealt over salts (the session's shuffle
    partitions, unless given) tasks by a hash of by; there are at most four times as many such keys as partitions, so they are sent to all."""
    n = parts(left.sparkSession)
    counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in counts.where((F.col("_n") * 4 * n > total) & (F.col("_n") > LEAST_HOT)).select(on).collect()]
    if not hot:
        return left.join(right, on, how)
    hot = [k for k in hot if k is not None]
    keys = left.sparkSession.createDataFrame([(k,) for k in hot], left.select(F.col(on).alias("_hot")).schema)
    is_hot = F.col("_hot").isNotNull()
    salts = salts or n
    spread = left.join(F.broadcast(keys), F.col(on) == F.col("_hot"), "left").withColumn("_salt", F.when(is_hot | F.col(on).isNull(), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copied = right.join(F.broadcast(keys), F.col(on) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return spread.join(copied, [on, "_salt"], how).drop("_salt")
