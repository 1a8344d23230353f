"""Documents to token ids in five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in spark.checkpoint.dir's folder and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scopeframe.llm import decontaminate, langid, piece, secrets, simhash
from scopeframe.llm.runtime import prepare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (operator 9).  Null, empty and wordless texts go, and those in no language that is labelled; a null
    source counts as none; rows that repeat stay or go together."""
    prepare(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (operator 2).  Texts without words are one group; rows without
    an id and rows that share one are judged by their texts; of rows that repeat one stays."""
    prepare(spark)
    return simhash.near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 10).  Null and empty texts hold none; rows that repeat stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew (operator 8).  Null and empty texts stay as they are."""
    prepare(spark)
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of ids and of what they decode to (operator 7).  Null and empty texts have no ids; each row gives a row."""
    return piece.tokenize(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret_spans), ("tokens", tokens)]

#: The stages fit models and walk graphs, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
