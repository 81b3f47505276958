"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, extraction, line_dedup, mixing, ogg, packing, quality, token_store, url_filters, warc
from .common import table


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.FEATURES, "base_failed", "kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def feed_of_hosts(pages: DataFrame) -> DataFrame:
    """A stand-in for a dated list feed: entries that follow from the MD5 of each host of pages."""
    host = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    h = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    host = host.withColumn("h", h)
    subject, category = F.concat(F.lit("host:"), "host"), F.when(F.col("h") % 4 == 0, "malware").otherwise("phishing")
    added = host.where("h % 2 = 0").select(subject.alias("subject"), category.alias("category"), day(F.col("h") % 200).alias("day"), F.lit(True).alias("added"))
    taken = host.where("h % 6 = 0").select(subject.alias("subject"), category.alias("category"), day(F.col("h") % 200 + 60).alias("day"), F.lit(False).alias("added"))
    folder = host.where("h % 5 = 1").select(F.concat(F.lit("prefix:"), "host", F.lit("/en/")).alias("subject"), F.lit("tracker").alias("category"), day(F.col("h") % 100 + 50).alias("day"), F.lit(True).alias("added"))
    parent = host.select(F.concat(F.lit("domain:"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).alias("subject")).distinct()
    spam = [parent.select("subject", F.lit("spam").alias("category"), day(F.lit(n)).alias("day"), F.lit(on).alias("added")) for n, on in ((100, True), (120, False), (300, True))]
    out = added.unionByName(taken).unionByName(folder)
    for x in spam:
        out = out.unionByName(x)
    return out


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time: the query takes 1 January 2024 and page_id modulo 360 days."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 360).cast("int")))
    out = url_filters.judge_captures(captures, feed_of_hosts(pages))
    return out.select("page_id", F.array_join("hits", "|").alias("hits"), "kept")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 360)::INTEGER AS day,
         regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', '')), ':[0-9]*$', ''), '\.$', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::INTEGER AS h FROM p WHERE host <> ''),
feed AS (
  SELECT 'host:' || host AS subject, CASE WHEN h % 4 = 0 THEN 'malware' ELSE 'phishing' END AS category, DATE '2024-01-01' + h % 200 AS since,
         CASE WHEN h % 6 = 0 THEN DATE '2024-01-01' + (h % 200 + 60) END AS until FROM hosts WHERE h % 2 = 0
  UNION ALL SELECT 'prefix:' || host || '/en/', 'tracker', DATE '2024-01-01' + (h % 100 + 50), NULL FROM hosts WHERE h % 5 = 1
  UNION ALL SELECT DISTINCT 'domain:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'spam', DATE '2024-01-01' + s, DATE '2024-01-01' + u
  FROM hosts, (VALUES (100, 120), (300, NULL)) v(s, u)),
hit AS (
  SELECT DISTINCT page_id, category || '=' || subject AS hit FROM p JOIN feed
  ON since <= day AND (until IS NULL OR day < until) AND (
     subject = 'host:' || host
     OR (starts_with(subject, 'domain:') AND ends_with('.' || host, '.' || substr(subject, 8)))
     OR (starts_with(subject, 'prefix:') AND starts_with(host || path, substr(subject, 8))))
  WHERE host <> '')
SELECT p.page_id, coalesce(string_agg(hit, '|' ORDER BY hit), '') AS hits, count(hit) = 0 AS kept
FROM p LEFT JOIN hit USING (page_id) GROUP BY p.page_id
"""


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.measure(ogg.store_media(table(spark, sf_dir, "documents")))


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files lie; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digest(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_url_filters": op4_url_filters,
    "op5_ogg": op5_ogg,
    "op6_extraction": op6_extraction,
    "op7_token_store": op7_token_store,
    "op8_packing": op8_packing,
    "op9_bagminhash": op9_bagminhash,
    "op10_quality_cascade": op10_quality_cascade,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.oracle(),
    "op2_mixing": mixing.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_url_filters": OP4_SQL,
    "op10_quality_cascade": quality.ORACLE,
}
