"""A training corpus from raw documents: STAGES in order, each on all that the one before kept.

1. toxicity: documents graded toxic by the ordinal model leave;
2. near_duplicates: of each SimHash class the document of smallest doc_id stays;
3. secrets: secrets in the texts are replaced by a mark;
4. packing: the texts, as token ids, are packed into sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termlab.llm import packing, secret_scan, simhash, toxicity
from termlab.llm.common import read_documents
from termlab.sources.tables import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those graded above 0.  The model is fitted on the labelled ones among them."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints at most 2 bits apart, on shingles of 3 words."""
    return simhash.keep_one(docs, width=3, distance=2)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` counted anew."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack(docs, end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Trained models, fingerprints and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each result written and read again: pieces with their sequence and place.

    Null texts are empty ones to every stage and end as a piece of the end id alone.  Rows with a null doc_id go through like
    others; of rows that repeat doc_id and text, and of each class of near copies, one stays.  Columns of the documents
    beside doc_id and text pass the first three stages.  An empty table gives no rows.
    """
    docs = read_documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
