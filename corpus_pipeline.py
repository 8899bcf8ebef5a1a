"""A training-data pipeline over documents: language, near-duplicates, benchmark passages, secrets, mixing.

Each stage gets all rows that the one before it kept, as a table reread from Parquet. All but the last return the columns of
documents; the last adds `rate` (expected copies) and `copies` (a draw with that mean, by a hash of the row).
"""
from pyspark.sql import DataFrame, SparkSession

from voxelflux.llm import decontaminate, jaccard, language, mixing, secrets
from voxelflux.llm.textops import held_out, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go (no letter, or a score under the calibrated threshold)."""
    return language.accepted(docs, language.fit(docs.where(~held_out("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles stays."""
    return jaccard.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get rates that bring the domains to their targets, and copies drawn with these means; a document without a copy goes."""
    return mixing.drawn(docs, table(spark, sf_dir, "labels"))


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("benchmark decontamination", decontamination),
          ("secret scans", secret_scan), ("mixing sources", source_mixing)]
#: No stage but the patterns of the secret scan can be said in SQL; tests hold run() against its parts and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
