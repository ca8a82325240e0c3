"""A training corpus from ``documents``: quality, near duplicates, secrets, mix, packing. Each stage works on what the one before kept.

All but the last return the columns of documents; further columns pass through them, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayfield.llm import mixing, near_copies, packing, quality, secret_scan
from dayfield.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior is 1/2 or more. Null, empty and very long texts are judged like any other; repeated rows stay;
    without labels of both classes every document stays; an empty table gives no rows."""
    return quality.kept_documents(docs, sf_dir)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of pairs with five-word Jaccard 0.8 or more. Texts without words, null ones
    included, are one component; repeated rows are one document; rows with a null id stay, one for each different text; very long texts are
    read whole; an empty table gives no rows."""
    return near_copies.deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by marks. Null texts stay null; texts of any length are read whole; repeated rows stay; an
    empty table gives no rows."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words, null ones included, are not taken; null sources are one source;
    repeated rows are taken each; an empty table gives no rows."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024. A null text is empty: one piece with the end id; repeated rows are
    documents of their own; only doc_id and text are read; an empty table gives no rows."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("entropy_mix", mixing_stage),
    ("bin_slack_packing", packing_stage),
]

#: Model fits, hashes and tokenizers are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
