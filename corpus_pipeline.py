"""A training corpus out of raw documents: each stage's decisions take effect on the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_dup, outliers, packing, secrets, toxicity
from tidemark.llm.common import drop, read, save


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return outliers.accepted(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.placements(docs)


#: Documents that toxicity or the quality rules reject go, one document of each near-duplicate group stays, secrets are
#: replaced by a mark, and the last stage gives each token piece its place in a sequence.
STAGES = [
    ("toxicity", _toxicity),
    ("quality rules", _quality),
    ("MinHash near-dedup", _near_duplicates),
    ("secret scans", _secrets),
    ("best-fit packing", _packing),
]

#: Nearest neighbours, inferred grammars and tokenizers are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
