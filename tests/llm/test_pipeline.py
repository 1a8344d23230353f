"""The pipeline's stages on a small frame and its queries on the smallest tables."""

import hashlib
import os
import re

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_run(spark):
    """The rows of the run: those whose language is told, the first of each group at a Jaccard similarity of 0.8 by brute force, without a
    benchmark item, decoded to the redacted text."""
    import corpus_pipeline
    from scopeframe.llm import decontaminate, langid, secrets
    from scopeframe.llm.runtime import table

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    docs = table(spark, FOLDER, "documents")
    kept = {r.doc_id: shingles(r.text) for r in langid.keep_identified(docs).collect()}
    up = {i: i for i in kept}

    def root(x):
        return x if up[x] == x else root(up[x])

    for i, a in kept.items():
        for k, b in kept.items():
            if k < i and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = root(i), root(k)
                up[max(x, y)] = min(x, y)
    leaked = {r.doc_id for r in decontaminate.op10(docs, table(spark, FOLDER, "benchmark")).collect()}
    assert set(out) == {i for i in kept if up[i] == i} - leaked
    texts = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert all(r.decoded_ok and r.decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest() for i, r in out.items())


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    """Null ids, texts and sources, rows that repeat, columns with clashing names; an empty table."""
    import corpus_pipeline
    from scopeframe.llm.runtime import prepare, table

    prepare(spark)
    base = table(spark, FOLDER, "documents")
    some = base.limit(3).collect()
    rows = [*some, some[0], (None, some[1].text, None, None, None), (None, None, "en", "s", 0), (7777, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, base.schema)
    odd = docs.selectExpr("*", "1 as _host", "2 as item", "3 as _h", "4 as _text", "5 as a", "6 as _spans")
    for frame in (odd, odd.where("false")):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, FOLDER)
            assert now.columns == frame.columns, name
            assert now.count() <= frame.count()
        last = corpus_pipeline.STAGES[-1][1](spark, now, FOLDER)
        assert last.count() == now.count()


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from scopeframe.llm import queries

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, FOLDER)
        got = sorted(map(tuple, df.collect()))
        assert got == sorted(c.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()), name
