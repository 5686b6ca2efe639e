"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, byte-level BPE.

Each stage takes all documents that its predecessor kept, returns the columns of documents (the last one
adds ids and digests), and is written to the shared folder before the next one reads it. No SQL
can express the models of its stages; tests compare it with brute-force versions.

Edge cases: null and empty texts and texts without letters go in the first stage, and so do texts whose words' languages are
unsure; without any labelled document none goes. Of repeated rows with one doc_id the one whose text sorts first stays; rows
without doc_id all stay, as they can't be told apart. Ties are settled by the smaller doc_id. Very long texts pass
whole. A null n_chars stays null unless the text was changed. Extra columns stay, but for those that the last stage adds (ids, n_tokens,
ids_sha256, decoded_sha256), which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, decontaminate, langid, neardup, secrets
from cairn.llm.common import shared_dir, small_batches, stored, table

ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose words' languages are less sure than a half on average."""
    small_batches(spark)
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    small_batches(spark)
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    small_batches(spark)
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and digests of ids and decoded bytes."""
    small_batches(spark, size="4m")  # distinct pieces of larger batches cost less
    return bpe.digests(docs, keep=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("secrets", without_secrets), ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{where}/{k}-{name}")
    return docs
