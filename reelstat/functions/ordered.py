"""Row-grain running totals and neighbours, without a task per key.

``SUM(x) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)`` and
``LAG(x) OVER (PARTITION BY k ORDER BY t)`` put all rows of a key into one task.
Here rows are dealt into buckets by ranges of (key, order), so a key with a huge
share of the rows is spread over many buckets, in order.  A window inside each
(bucket, key) does the local part, and what a bucket needs from those before it
is carried over: a sum, or the last row.

Only a key that ends one bucket can go on in the next, so at most one key per
bucket is carried; the carry table has at most two rows a bucket and is
broadcast on that bound.  The bounds of the ranges come from a sample, so rows
are written with their buckets and every use reads the same ones.  The order
must be unique within a key (add an id): rows alike in it cannot be told apart.
NULL keys are a group like any other; NULL order values come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, stored

BUCKET = "_bucket"


def bucketed_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      buckets: int | None = None) -> DataFrame:
    """``df`` written with the number of its range bucket by (keys, order)."""
    n = buckets or partitions(df.sparkSession)
    return stored(df.repartitionByRange(n, *keys, *order)
                    .withColumn(BUCKET, F.spark_partition_id()), "by-range")


def _carried(ranged: DataFrame, keys: Sequence[str], summary: Column, carry) -> DataFrame:
    """(bucket, keys, _carry) for the keys that span buckets: ``summary`` of each
    (bucket, key), and ``carry(window)`` of it over the buckets before."""
    ends = ranged.groupBy(BUCKET).agg(F.max(F.struct(*keys)).alias("_end")).select(
        *[F.col(f"_end.{k}").alias(f"_e_{k}") for k in keys]).distinct()
    at_end = _same(keys, "_e_")
    parts = ranged.join(F.broadcast(ends), at_end, "left_semi").groupBy(BUCKET, *keys).agg(
        summary.alias("_part"))
    before = Window.partitionBy(*keys).orderBy(BUCKET)
    return parts.select(F.col(BUCKET).alias("_c_bucket"), *[F.col(k).alias(f"_c_{k}") for k in keys],
                        carry(before).alias("_carry"))


def _same(keys: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def _with_carry(local: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    # at most two rows a bucket
    out = local.join(F.broadcast(carried), (F.col(BUCKET) == F.col("_c_bucket"))
                     & _same(keys, "_c_"), "left")
    return out.drop("_c_bucket", *[f"_c_{k}" for k in keys])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column],
                buckets: int | None = None) -> DataFrame:
    """``df`` with running totals: ``sums`` names them and gives what is added up
    (NULLs are skipped; a total is NULL until the first value)."""
    ranged = bucketed_by_range(df, keys, order, buckets)
    local = Window.partitionBy(BUCKET, *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    carried = _carried(
        ranged, keys, F.struct(*[F.sum(c).alias(n) for n, c in sums.items()]),
        lambda w: F.struct(*[F.sum(f"_part.{n}").over(
            w.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n in sums]))
    out = _with_carry(ranged.select("*", *[F.sum(c).over(local).alias(f"_l_{n}")
                                           for n, c in sums.items()]), carried, keys)

    def total(n: str) -> Column:
        here, before = F.col(f"_l_{n}"), F.col(f"_carry.{n}")
        return F.coalesce(here + before, here, before).alias(n)

    return out.select(*[F.col(c) for c in df.columns], *[total(n) for n in sums])


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
                 buckets: int | None = None) -> DataFrame:
    """``df`` with columns of the row before in the same key: ``values`` names
    them and gives the column; NULL in a key's first row."""
    ranged = bucketed_by_range(df, keys, order, buckets)
    local = Window.partitionBy(BUCKET, *keys).orderBy(*order)
    row = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    carried = _carried(ranged, keys, F.max_by(row, F.struct(*order)),
                       lambda w: F.lag("_part").over(w))
    out = _with_carry(ranged.select("*", F.lag(row).over(local).alias("_before")), carried, keys)
    before = F.coalesce("_before", "_carry")
    return out.select(*[F.col(c) for c in df.columns],
                      *[before[n].alias(n) for n in values])
