"""Counts, NULL counts and minima from Parquet footers.

Every Parquet file says in its footer how many rows it has and, for each column
chunk, how many NULLs and which least and largest value.  Spark's DataSource V2
reader answers COUNT, MIN and MAX from there (aggregate push-down) if the
session asks for it, and then opens no column chunk at all: an audit of 100 TB
reads a few kilobytes a file.  The settings belong to a session of its own, so
the caller's session reads its tables as before.

What footers cannot answer is scanned, and only that: NULLs of arrays, maps and
structs (their statistics are about the values inside), and any table with a
file whose writer left the statistics out.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import TABLE_SCHEMAS, check_schema, table_path

_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
#: Types whose order in footers is Spark's (texts are cut short there, and NaN
#: is in no footer's range).
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
ORDERED = (*WHOLE, T.DateType)

_sessions: dict[str, SparkSession] = {}


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet reads push aggregates down."""
    app = spark.sparkContext.applicationId
    if app not in _sessions:
        session = spark.newSession()
        for key, value in _SETTINGS.items():
            session.conf.set(key, value)
        _sessions[app] = session
    return _sessions[app]


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as a frame whose plain aggregates read footers alone."""
    return footer_session(spark).read.parquet(path)


def aggregate(spark: SparkSession, path: str, aggregates: Sequence[Column]) -> tuple:
    """The row of ``aggregates`` (COUNT, MIN, MAX of top-level columns) over the
    table at ``path``: from footers if they have all of it, else by a scan."""
    if not aggregates:
        return ()
    try:
        return tuple(footer_table(spark, path).agg(*aggregates).first())
    except (PySparkException, Py4JJavaError) as e:
        if "aggregatePushdown" not in str(e):
            raise
        # a file without statistics: Spark's error names the setting
        return tuple(spark.read.parquet(path).agg(*aggregates).first())


def row_count(spark: SparkSession, base: str, name: str) -> int:
    return aggregate(spark, table_path(base, name), [F.count(F.lit(1))])[0]


def null_counts(spark: SparkSession, base: str, name: str) -> tuple[int, dict[str, int]]:
    """(rows, NULLs of each column) of a table."""
    path = table_path(base, name)
    df = spark.read.parquet(path)
    if name in TABLE_SCHEMAS:
        check_schema(df, name)
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]
    nested = [c for c in df.columns if c not in flat]
    rows, *there = aggregate(spark, path, [F.count(F.lit(1)), *[F.count(_column(c)) for c in flat]])
    nulls = {c: rows - n for c, n in zip(flat, there)}
    if nested:
        found = df.agg(*[F.count(F.when(_column(c).isNull(), 1)) for c in nested]).first()
        nulls |= dict(zip(nested, found))
    return rows, {c: nulls[c] for c in df.columns}


def ranges(spark: SparkSession, base: str, name: str, kinds=ORDERED) -> dict[str, tuple]:
    """(least, largest) of the columns of a table with one of ``kinds``, types that
    footers order as Spark does."""
    path = table_path(base, name)
    columns = [f.name for f in spark.read.parquet(path).schema.fields
               if isinstance(f.dataType, kinds)]
    found = aggregate(spark, path, [m(_column(c)) for c in columns for m in (F.min, F.max)])
    return {c: (found[2 * i], found[2 * i + 1]) for i, c in enumerate(columns)}


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
