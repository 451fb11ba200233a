"""The thin queries over the operators, under the names the entry module registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, licenses, lm, media, mixing, neardup, packing, quality, tokens, warc
from .common import scratch_path, table


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_texts(table(spark, sf_dir, "documents"))
    return media.page_digests(media.decode_pages(stored, n_bytes_col="n_bytes")).drop("error")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"), scratch_path(spark, "archive"))
    store = warc.build_store(spark, path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    return store.records().select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_pack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_tiff_media,
        op2_warc_archive,
        op3_projection_forest,
        op4_pack_histogram,
        op5_lattice_likelihood,
        op6_token_counts,
        op7_sainte_lague_mix,
        op8_co_training,
        op9_simhash_segments,
        op10_license_scan,
    )
}

ORACLE_SQL = {
    "op2_warc_archive": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), first AS (
            SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > least THEN least END AS refers_to
        FROM p LEFT JOIN first USING (payload_digest)""",
}
