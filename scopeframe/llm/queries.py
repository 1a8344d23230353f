"""The queries of this folder's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, matroska, pii, piece, quality, secrets, simhash, substrings
from .runtime import table


def op1_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op1(table(spark, sf_dir, "conversations"))


def op2_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2(table(spark, sf_dir, "documents"))


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op4(table(spark, sf_dir, "documents"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.op5(table(spark, sf_dir, "documents"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.op7(table(spark, sf_dir, "documents"))


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op8(table(spark, sf_dir, "documents"))


def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op9(table(spark, sf_dir, "documents"))


def language_fusion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's operator over web pages, which declare a language and have an address."""
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5's files hold, read back: the columns that SQL can tell."""
    return matroska.op5(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's base kinds, counted."""
    return secrets.op8(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_prefix_target_chat, op2_simhash_ball, op3_quality_cnn, op4_superkmer_dedup, op5_matroska, op6_surrogates, op7_sentencepiece, op8_entropy_secrets, op9_language_fusion, op10_minhash_containment, language_fusion_pages, media_payloads, secret_counts)
}

OP4_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as k from (select r, w, unnest(range(1, len(w) - 33)) as i from d)),
again as (select r, i from windows where k in (select k from windows group by k having count(*) > 1)),
gone as (select distinct r, unnest(range(i, i + 35)) as j from again),
words as (select r, unnest(range(1, len(w) + 1)) as j, unnest(w) as word from d),
kept as (select r, string_agg(word, ' ' order by j) as t, count(*) as n from words anti join gone using (r, j) group by r)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (r)
"""

OP10_SQL = r"""
with dw as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
bw as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
ds as (select distinct r, doc_id, array_to_string(w[i:i + 4], ' ') as s from (select *, unnest(range(1, len(w) - 3)) as i from dw)),
bs as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as s from (select *, unnest(range(1, len(w) - 3)) as i from bw)),
size as (select item_id, count(*) as n_item from bs group by item_id),
pair as (select r, doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by all)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment from pair join size using (item_id) where n_shared >= 0.8 * n_item - 1e-9
"""

PAYLOAD_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, octet_length(b) as n, greatest(64, (octet_length(b) + 63) // 64 * 64) as m, b from d)
select doc_id, n as n_bytes, m as payload_bytes, sha256(b || repeat('\\x00'::blob, m - n)) as payload_sha256 from p
"""

COUNT_SQL = r"""
select doc_id, len([x for x in regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) if length(x) >= 6]) as n_assign,
  len([x for x in regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') if length(x) >= 20]) as n_access, len([x for x in regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') if length(x) >= 24]) as n_hex from documents
"""

SQL: dict[str, str] = {"media_payloads": PAYLOAD_SQL, "secret_counts": COUNT_SQL, "op1_prefix_target_chat": chat.OP1_SQL, "op4_superkmer_dedup": OP4_SQL, "op10_minhash_containment": OP10_SQL}
