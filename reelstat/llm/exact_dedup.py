"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step looks only at rows that the step before left undecided:

1. rows are counted by text length (bytes); a length that occurs once is done;
2. rows of repeated lengths are counted by (length, hash of the first
   ``prefix_chars`` characters); a pair that occurs once is done;
3. only rows of repeated pairs have their whole text hashed (SHA-256) and are
   grouped by it.

The counts of steps 1 and 2 are combined map-side, so a hot length (a group of
copies that is a third of the table) costs one row per task.  The surviving
keys are written as tables; the semi joins against them are joins of two plain
shuffles, which adaptive execution splits when one key is hot.

Defined results: a NULL text equals an empty one; of equal texts the row with
the largest id stays (a NULL id is smaller than any other; if all ids of a
group are NULL, ``keep_id`` is NULL); rows repeated with id and text count each
in ``group_size``, all carry the same ``keep_id``, and ``deduplicate`` leaves
one of them.  An empty table gives an empty result.  Columns of any name pass
``deduplicate`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import positions
from .common import id_text, id_text_columns, written

PREFIX_CHARS = 256


def _length() -> Column:
    return F.octet_length("text")


def _prefix(chars: int) -> Column:
    return F.xxhash64(F.substring("text", 1, chars))


def full_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hashed(base: DataFrame, prefix_chars: int) -> DataFrame:
    """The rows of ``base`` whose length and prefix occur again, with text_sha256
    in place of the text."""
    lengths = written(
        base.groupBy(_length().alias("n_bytes")).count().filter("count > 1").select("n_bytes"),
        "lengths")
    pairs = written(
        base.select(_length().alias("n_bytes"), _prefix(prefix_chars).alias("prefix_hash"))
            .join(lengths, "n_bytes", "left_semi")
            .groupBy("n_bytes", "prefix_hash").count().filter("count > 1")
            .select("n_bytes", "prefix_hash"), "prefixes")
    # Written before it is grouped: a join that feeds no further shuffle-bound
    # step may be split by adaptive execution when one pair is hot.
    return written(
        base.select("*", _length().alias("n_bytes"), _prefix(prefix_chars).alias("prefix_hash"))
            .join(pairs, ["n_bytes", "prefix_hash"], "left_semi")
            .withColumn("text_sha256", full_hash(F.col("text")))
            .drop("text", "n_bytes", "prefix_hash"), "hashed")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups of two or more equal texts: text_sha256, keep_id, group_size."""
    return written(
        _hashed(id_text(docs, id_col, text_col), prefix_chars).groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1"), "groups")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Every row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = duplicate_groups(docs, id_col, text_col, prefix_chars)
    rows = id_text(docs, id_col, text_col) \
        .select("doc_id", full_hash(F.col("text")).alias("text_sha256"))
    return (rows.join(groups, "text_sha256", "left")
                .select("doc_id",
                        F.when(F.col("group_size").isNull(), F.col("doc_id"))
                         .otherwise(F.col("keep_id")).alias("keep_id"),
                        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                        "text_sha256")
                .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows that stay, with all their columns.

    Of a group the row with the largest id stays, of several with that id the
    one that stands last.  Texts are not moved: the places of the rows that go
    are looked up where the texts are read (``positions``).
    """
    docs = positions.located(docs)
    rows = _hashed(positions.with_place(docs, *id_text_columns(id_col, text_col)), prefix_chars)
    place = [F.col(positions.FILE), F.col(positions.ROW)]
    last = written(rows.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", *place)).alias("last"), F.count("*").alias("n"))
        .filter("n > 1").select("text_sha256", "last"), "last")
    gone = rows.join(last, "text_sha256").filter(
        (F.col(positions.FILE) != F.col("last")[positions.FILE])
        | (F.col(positions.ROW) != F.col("last")[positions.ROW]))
    return positions.chosen(docs, gone.select(*place), keep=False)
