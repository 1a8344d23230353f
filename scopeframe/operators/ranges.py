"""Operators on token ranges: budget, merging, clipping, overlay.  All are windows and joins on a document's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Adds kept (the first most rows of a key) and omitted (how many others)."""
    w = Window.partitionBy(key)
    return df.withColumn("kept", F.row_number().over(w.orderBy(order)) <= most).withColumn("omitted", F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0)))


def merge_runs(df: DataFrame, key: str, scope: str = "scope") -> DataFrame:
    """(key, start, length, scope, runs): touching runs with the same scope as one; columns start and length."""
    w = Window.partitionBy(key).orderBy("start", "length")
    before_end, before = F.lag(F.col("start") + F.col("length")).over(w), F.lag(scope).over(w)
    new = F.when((before_end == F.col("start")) & before.eqNullSafe(F.col(scope)), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.first(scope).alias("scope"), F.count(F.lit(1)).alias("runs")).drop("_island")


def clip(df: DataFrame, start: Column, length: Column) -> DataFrame:
    """The part of each run inside the range, counted from the range's start; runs outside go."""
    a, b = F.greatest(F.col("start"), start), F.least(F.col("start") + F.col("length"), start + length)
    return df.where((F.col("start") < start + length) & (F.col("start") + F.col("length") > start)).withColumn("_a", a).withColumn("_b", b).where("_b > _a").withColumn("start", F.col("_a") - start).withColumn("length", F.col("_b") - F.col("_a")).drop("_a", "_b")


def overlay(runs: DataFrame, mappings: DataFrame, key: str) -> DataFrame:
    """Runs moved by mappings (key, src_start, dst_start, size): each part inside a mapping's source, at its destination."""
    m = mappings.withColumnRenamed(key, "_key")
    joined = runs.join(m, (F.col(key) == F.col("_key")) & (F.col("start") < F.col("src_start") + F.col("size")) & (F.col("start") + F.col("length") > F.col("src_start")))
    a, b = F.greatest("start", "src_start"), F.least(F.col("start") + F.col("length"), F.col("src_start") + F.col("size"))
    return joined.withColumn("_a", a).withColumn("_b", b).where("_b > _a").withColumn("length", F.col("_b") - F.col("_a")).withColumn("start", F.col("_a") - F.col("src_start") + F.col("dst_start")).drop("_a", "_b", "_key", "src_start", "dst_start", "size")
