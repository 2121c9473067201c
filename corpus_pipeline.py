"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Quality rules drop documents, line dedup removes repeated chunks and passages (and documents of which nothing stays),
near-dedup keeps one document of each group, the secret scan masks what it finds, and packing returns the pieces of token
sequences.

Defined cases: null, empty and white texts go in the first stage; very long texts pass every stage whole; repeated rows lose
their chunks alike and near-dedup keeps one of them; of rows of one id with different texts each is judged by its text, and
rows without id stay unless their text repeats; a table without rows gives none; further columns, whatever their names, pass
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm import line_chunks, near_dup, packing, quality, secrets
from foldstone.llm.queries import vocabulary
from foldstone.session import materialize, release, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_chunks.remove_repeats(docs, passages=True).where(F.length("text") > 0)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, *vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: Rolling hashes, MinHash samples, compression and tokenizers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's rows are written to the shared folder and read again, and go once the
    next one's are written. The last stage writes what it needs before it returns."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
