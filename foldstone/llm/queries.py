"""The queries of this subpackage and their SQL, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm import bpe, licenses, line_chunks, multiset, near_dup, packing, quality, ring, secrets, toxicity
from foldstone.session import table

#: Vocabulary files by name; None takes those of the installed ``public_tokenizers``.
TOKENIZERS: str | None = None


def vocabulary(name: str) -> tuple[str, str]:
    """(path, pattern) of a vocabulary file."""
    import public_tokenizers

    return (f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)), public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir), base_phrases=licenses.BASE_PHRASES)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_report(_documents(spark, sf_dir))


def op4_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprint_documents(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), *vocabulary("byte_bpe_50k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), *vocabulary("byte_bpe_50k.tiktoken"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_documents(_documents(spark, sf_dir))


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ring.assign(_documents(spark, sf_dir), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_line_dedup, op4_multiset_fingerprint, op5_best_fit_packing, op6_byte_bpe, op7_near_dedup, op8_quality_rules, op9_ring_shards, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op2_secret_scan": secrets.oracle(), "op7_near_dedup": near_dup.oracle()}
