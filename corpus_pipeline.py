"""A training-data pipeline of five operators, each stage written as Parquet and read again by the next.

Every stage works on all the rows that its predecessor kept, and all but the last return the columns of
documents. The stages' docstrings say what they do with rows; nulls, empty texts, ties and repeated rows are as
the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import bpe, exact_dedup, order_minhash, packing, phrase_dedup, toxicity
from strandflow.llm.common import prepare, settle, table
from strandflow.llm.queries import ENGLISH


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled rows that are not held out, rejects go."""
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the row with the largest doc_id stays."""
    prepare(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least doc_id stays."""
    prepare(spark)
    return order_minhash.keep_one(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under recurring windows go; a document that has none keeps its text as it is, one that loses all words stays, empty."""
    prepare(spark)
    return phrase_dedup.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    prepare(spark)
    return packing.pack(packing.pieces(docs, bpe.tokenizer_file(ENGLISH)))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicates", drop_near_copies),
    ("substring dedup", remove_passages),
    ("packing", pack),
]

#: SQL can express neither the trained network nor best-fit; tests compare with a restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
