"""Cleaning of a corpus in stages; each works on all that the stage before kept.

Documents that the toxicity model rejects go; of each group of near copies one stays; passages
that repeat are cut out of all places but the first; documents with passages of the benchmark
go; the rest is encoded, decoded and returned with its ids.

SQL can't express the stages (they train a model, and use hashes and a vocabulary that DuckDB
has not), so the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanloom.llm import debruijn, decontam, golay, noisy_or, piece_codec
from loanloom.llm.common import table
from loanloom.llm.queries import PIECE_MODEL, TOXIC, training_labels
from loanloom.sources.store import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = noisy_or.fit(docs, training_labels(spark, sf_dir))
    return noisy_or.without_toxic(docs, model, TOXIC)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return golay.representatives(docs, shingle=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(docs, 20)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(docs, PIECE_MODEL, ("n_tokens", "ids_sha256", "decoded_sha256", "ids"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
