"""The corpus pipeline: documents to packed token sequences in four stages.

Each stage is a function of (spark, docs, sf_dir); ``docs`` is what the stage
before kept, read back from Parquet.  All stages but the last return rows of
``documents`` with their own columns.

1. toxicity: documents scored at or above the threshold go.
2. exact_dedup: of equal texts, the row with the largest id stays.
3. simhash_dedup: of each group linked by fingerprints at most three bits
   apart, the row with the smallest id stays.
4. packing: what is left, as pieces of token sequences.

Defined results: NULL texts are read as empty ones, which are scored, equal and
near each other like any text, and pack as an end token; a NULL id is smaller
than any other for stage 2 and comes last in stage 3; of rows repeated with id
and text one stays; columns of any name pass the first three stages untouched;
empty tables give empty results.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelstat.llm import exact_dedup, simhash, toxicity  # noqa: E402
from reelstat.llm.common import documents, table, written  # noqa: E402
from reelstat.llm.queries import pack  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: SQL cannot score toxicity, so there is none; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = written(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
