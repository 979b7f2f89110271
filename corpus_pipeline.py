"""From raw documents to a training mix: quality rules, near duplicates, benchmark passages, personal data, source weights.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept. All but the last return the columns of
documents: the first three drop rows, the fourth replaces personal data in the text. The last returns, for each row, how
many of its words the mix takes. Nulls, empty tables, repeated rows and further columns are as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import bagminhash, decontaminate, mixing, pii, quality
from rankloom.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.filtered(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filtered(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", good_quality),
    ("near duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]

#: The first stage's verdict is fitted by iteration, and the second's classes come from iterated links; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = before = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), instead_of=before)
    return STAGES[-1][1](spark, docs, sf_dir)
