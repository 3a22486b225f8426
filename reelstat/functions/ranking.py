"""Totals, ranks, top-k and medians that stay distributed.

The source reports use ``SUM(x) OVER ()``, ``RANK() OVER (ORDER BY x)`` and a
ROW_NUMBER median.  Written literally in Spark, each of these is a window
with no (or a coarse) partition key: every row of the input meets in one task.
That is fine for a report over 16 categories and fatal over a billion
customers.  The helpers here give the same answers with bounded tasks:

* ``attach_one_row``  -- a one-row aggregate broadcast next to every row.
* ``rank_desc``       -- RANK as 1 + (rows that sort strictly before), from
  per-value counts, range buckets and bucket offsets; no task sees more than
  one bucket, ties collapse in map-side aggregation.
* ``top_n``           -- ``orderBy().limit()`` (partial top-k per task), then
  ranks among the survivors, which equal the global ranks.
* ``median``          -- exact PERCENTILE_CONT(0.5) as a one-row frame (see
  ``quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, stored
from .exprs import pct
from .quantiles import BINS, FEW, grouped_quantiles


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame to every row of ``df``.

    ``one_row`` must be a global aggregate (exactly one row), so the broadcast
    is one row and the join emits exactly ``len(df)`` rows.
    """
    return df.crossJoin(F.broadcast(one_row))


def with_share(df: DataFrame, measure: str, name: str, digits: int = 2,
               bounded: bool = False, scale: int = 2) -> DataFrame:
    """``ROUND(measure * 100 / SUM(measure) OVER (), digits)``.

    ``bounded=True`` is for aggregates whose row count is fixed by design
    (categories, stores, segments, bands, weekdays): the total is a window
    over that small result, computed in the same pass.  Otherwise the total
    is a one-row aggregate broadcast back, which keeps every task bounded at
    the price of evaluating ``df`` twice.  ``scale``: decimals of the measure.
    """
    if bounded:
        out = df.withColumn("_share_total", F.sum(measure).over(Window.partitionBy()))
    else:
        out = attach_one_row(df, df.agg(F.sum(measure).alias("_share_total")))
    return out.withColumn(name, pct(measure, "_share_total", digits, scale)).drop("_share_total")


def _buckets(df: DataFrame) -> int:
    return partitions(df.sparkSession)


def _ordered_prefix(counts: DataFrame, keys: Sequence[str], order: Column,
                    n_col: str, buckets: int) -> DataFrame:
    """Add ``_before``: sum of ``n_col`` over rows with the same ``keys`` that
    sort strictly before this one by ``order``.

    ``counts`` is unique on (keys, order value).  Range partitioning gives each
    row a bucket ``_b`` in sort order; bucket totals (at most buckets + groups
    rows) give the offset of each bucket, and a window inside one bucket gives
    the local part.  The bounds of the ranges come from a sample, so the rows
    are written with their bucket once and both uses read the same buckets.
    NULL keys are a group like any other.
    """
    part_keys = [F.col(k) for k in keys]
    ranged = stored(counts.repartitionByRange(buckets, *part_keys, order)
                    .withColumn("_b", F.spark_partition_id()), "ranged")
    bucket_tot = ranged.groupBy("_b", *keys).agg(F.sum(n_col).alias("_bn"))
    w_off = (Window.partitionBy(*keys).orderBy("_b")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = bucket_tot.select(F.col("_b").alias("_ob"),
                                *[F.col(k).alias(f"_o_{k}") for k in keys],
                                F.coalesce(F.sum("_bn").over(w_off), F.lit(0)).alias("_off"))
    w_loc = (Window.partitionBy("_b", *keys).orderBy(order)
             .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumn("_loc", F.coalesce(F.sum(n_col).over(w_loc), F.lit(0)))
    same = F.col("_b") == F.col("_ob")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return (local.join(offsets, same)
                 .withColumn("_before", F.col("_off") + F.col("_loc"))
                 .drop("_b", "_off", "_loc", "_ob", *[f"_o_{k}" for k in keys]))


def rank_desc(df: DataFrame, value: str, name: str = "rank",
              partition_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Add ``name`` = RANK() OVER (PARTITION BY partition_by ORDER BY value DESC).

    Exact, including ties and NULLs (NULLs sort last, as in DESC order).
    """
    keys = list(partition_by)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    pref = _ordered_prefix(counts, keys, F.col(value).desc_nulls_last(), "_n",
                           buckets or _buckets(df))
    ranks = pref.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(value).alias("_rv"),
                        (F.col("_before") + 1).cast("long").alias(name))
    same = F.col(value).eqNullSafe(F.col("_rv"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(ranks, same).drop("_rv", *[f"_r_{k}" for k in keys])


def small_rank_desc(df: DataFrame, value: str, name: str = "rank",
                    partition_by: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    """RANK via a window: only for inputs whose size is bounded by design
    (categories, stores, months, the survivors of a top-n)."""
    w = Window.partitionBy(*partition_by).orderBy(F.col(value).desc_nulls_last())
    return df.withColumn(name, F.rank().over(w).cast("long"))


def top_n(df: DataFrame, value: str, n: int, tiebreak: Sequence[str]) -> DataFrame:
    """The ``n`` rows with the largest ``value`` (deterministic tie-break).

    Planned as TakeOrderedAndProject: every task keeps its own top ``n``.
    """
    order = [F.col(value).desc_nulls_last()] + [F.col(t).asc() for t in tiebreak]
    return df.orderBy(*order).limit(n)


def median_of_counts(df: DataFrame, value: str, name: str = "median") -> DataFrame:
    """One-row exact median of a per-entity *count* column.

    Spark's exact ``percentile`` keeps one map entry per distinct value.  For
    counts that is safe at any scale: if the counts sum to N, d distinct
    values need 1 + 2 + ... + d <= N, so d <= sqrt(2N) (about 1.4 million
    entries for 10^12 rentals).  Interpolates like PERCENTILE_CONT(0.5).
    """
    return df.agg(F.percentile(F.col(value), F.lit(0.5)).alias(name))


def median(df: DataFrame, value: str, name: str = "median", buckets: int = BINS,
           few: int = FEW) -> DataFrame:
    """One-row frame with the exact median of ``value`` (NULLs ignored; NULL if
    there is none).

    Even counts average the two middle values (PERCENTILE_CONT(0.5)), with one
    decimal more than the values have.  Never sorts the column in one task.
    ``few`` and ``buckets``: as for ``quantiles.grouped_quantiles``.
    """
    return grouped_quantiles(df, [], value, {name: "0.5"}, few, buckets).agg(
        F.max(name).alias(name))
