"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, folder of the tables). All but the last return rows of ``docs`` with their columns
as they are, so a stage's decision is that a row is no longer there.
"""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

import sprintloom  # noqa: E402
from sprintloom.llm import decontamination, exact_dedup, language_id, packing, simhash  # noqa: E402
from sprintloom.llm.common import table  # noqa: E402
from sprintloom.session import written  # noqa: E402

cloudpickle.register_pickle_by_value(sprintloom)

# What earlier stages took of an executor's memory is not all given back, so packing remembers fewer pieces than alone.
REMEMBERED = 400_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: fingerprints of three-word shingles that differ in two bits or fewer."""
    return simhash.drop_near_duplicates(docs, words=3, radius=2)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 1024 tokens."""
    return packing.pack(docs, with_ids=False, remembered=REMEMBERED)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", benchmark_free),
    ("packing", sequences),
]

# Character n-gram models, shingle hashes and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
