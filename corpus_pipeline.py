"""A corpus pipeline of five stages; each takes the documents that the one before left, and all but the last return their columns.

Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table: a null text counts
as an empty one and stays null where it is kept, a null id or source is a value like any other, and no rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import bpe, jaccard, mixing, pii, quality_rules
from cuelake.llm.common import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go, null and empty texts among them; repeated rows are judged alike."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: Jaccard similarity 0.8 or more over five-word shingles.

    SimHash anchors link what differs in three bits, MinHash bands what else may be so alike; every link is verified.
    Of repeated rows one stays; rows that share an id and hold unrelated texts all do.
    """
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts; n_chars follows. Repeated rows stay repeated."""
    return pii.sanitise(docs, length_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents come as often as their rate says, some not at all."""
    return mixing.expand(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens and what they decode to, as digests."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express near-duplicate components, entropy balancing or BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
