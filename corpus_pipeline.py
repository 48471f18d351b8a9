"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, exact_dedup, mixing, simhash, toxicity
from tideline.llm.common import MADE, discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the classifier is fitted on labelled documents outside the held-out ids.

    Null ids and repeated rows are scored like any other; null and empty texts stay.
    """
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.with_score(docs, model).where(F.col("__toxicity") < 0.3).drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest id stays.

    Null texts are empty ones. Of rows that repeat that id, or if all ids are null, one stays.
    """
    return exact_dedup.keep_one(docs, ties=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal fingerprints, the one with the smallest id stays.

    Of several texts of that id, or if all ids are null, one stays.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by calibrated probabilities that keep 0.9 of the tokens.

    Null labels are a source and a language of their own; null ids share one draw; texts without words stay.
    """
    return mixing.sample(docs, token_yield=0.9)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, a row for each document."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The classifier, the fingerprints and the tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage wrote is removed when the next one's result is written."""
    docs, begin = table(spark, sf_dir, "documents"), len(MADE)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard(spark, begin, MADE[-1])
    return STAGES[-1][1](spark, docs, sf_dir)
