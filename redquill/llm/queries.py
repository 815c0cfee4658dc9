"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exactdedup, fingerprints, mixing, neardup, packing, quality, tokenfile, toxicity, urlrules, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def last_byte_changed(page_id: int | None, payload: bytes) -> bytes:
    """The known fault of a replica: the last byte of some pages is another."""
    return payload[:-1] + b"~" if page_id is not None and page_id % 997 == 13 and payload.endswith(b">") else payload


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written, copied with faults, and both read back."""
    files = warc.write_warc(table(spark, sf_dir, "pages"))
    replica = warc.copy_warc(files, change=last_byte_changed)
    return warc.audit(warc.read_warc(files), warc.read_warc(replica)).select("page_id", "shard", "pos", "offset", "length", "digest", "status")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "links", "kept")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_token_files(tokenfile.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1))


def op10_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_packing, op3_quality, op4_mixing, op5_fingerprints, op6_warc, op7_neardup, op8_urls, op9_tokens, op10_exactdedup)
}

ORACLES: dict[str, str] = {
    "op6_warc": r"""
WITH r AS (SELECT page_id, html, coalesce(CAST(floor(page_id / 512.0) AS BIGINT), -4611686018427387904) AS shard,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Date: 2020-01-01T00:00:00Z' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g') || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages),
d AS (SELECT page_id, shard, sha256(rec) AS digest, strlen(rec) AS length, CASE WHEN page_id % 997 = 13 AND html LIKE '%>' THEN 'changed' ELSE 'ok' END AS status FROM r)
SELECT page_id, shard, row_number() OVER (PARTITION BY shard ORDER BY page_id, digest) - 1 AS pos,
  CAST(sum(length) OVER (PARTITION BY shard ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset", length, digest, status FROM d
""",
    "op10_exactdedup": exactdedup.SQL,
}
