"""Helpers shared by the operators: input columns, written intermediates, slices."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table_path

#: The ASCII white space that separates words: tab to carriage return, and space.
ASCII_SPACE = "\\x20\\x09-\\x0D"

#: Whether Spark removes the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    The archive is made where the driver runs and Spark hands it to every
    executor (``addPyFile``); nothing is read from that folder by others.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        spark.sparkContext.addPyFile(shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="reelstat-"), "reelstat"), "zip",
            os.path.dirname(package), os.path.basename(package)))
        _shipped.add(app)


def release_memory() -> None:
    """Give back to the system what this Python worker has freed.

    Spark keeps workers from stage to stage; without this a stage would start with
    the heap that the stage before it had at its largest."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is; operators take and cast the columns that they need."""
    return spark.read.parquet(table_path(sf_dir, name))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, NULL text read as empty.

    Whatever else the input carries (also columns with clashing names) never
    meets the operator's own columns.
    """
    ship_package(docs.sparkSession)
    return docs.select(*id_text_columns(id_col, text_col))


def id_text_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text")]


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by its id and text (rows alike share them)."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                          text).cast("binary"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would fold other alphabets too)."""
    return F.translate(text, _UPPER, _UPPER.lower())


def ascii_words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space, in order."""
    return F.filter(F.split(text, f"[{ASCII_SPACE}]+"), lambda w: w != "")


def crc_remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (NULL id: empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")),
                  F.lit(modulus)).cast("int")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Cuts the lineage (a lost executor re-reads files that every executor sees)
    and gives the next plan plain scans, so that adaptive execution can split
    a hot key on either side of a join.  The shuffles of the write are of no use
    after it, so Spark removes their files when it ends, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(spark: SparkSession) -> int:
    """How many parts to deal work into: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

