"""A corpus pipeline over the documents table: toxic documents, copies, near copies and documents with benchmark passages
go, and what stays is encoded. Each stage works on all that the stage before it kept. Ids are integers, or null; other columns may have
any names; empty tables pass through every stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetledger.llm import byte_bpe, common, decontaminate, exact_dedup, simhash, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents among its input."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space aside, null like empty) the one with the smallest doc_id stays; of such without
    any id, one row. Rows that repeat both id and text are one document and all stay or all go."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link them, directly or over others, the one with the smallest doc_id stays; of a group without
    any id, one row. Texts without words have one fingerprint, and link like others."""
    return simhash.drop_near_copies(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any ten words in a row of a benchmark item, or all of a shorter one, go. Null texts have no words and stay."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, out=byte_bpe.DIGESTS)


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", contaminated),
    ("byte-level BPE", encoded),
]

#: A trained classifier and public tokenizer ranks are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage-{k}")
    return docs
