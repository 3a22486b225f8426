"""Data-quality audit: volumes, NULL profiles, orphans, temporal checks,
duplicate keys, distributions and a one-row scorecard.

Generic forms take any DataFrame and column names; the ``*_report``
functions apply them to the rental roles as the audit script does.  Every
profile reads each table once (one conditional aggregate per table).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import elapsed_days, pct
from ..functions.ranking import with_share
from ..plans.bases import copy_dim
from ..session import partitions
from ..sources import footers
from ..sources.roles import Roles


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_counts(spark: SparkSession, base: str, names: Sequence[str]) -> DataFrame:
    """A1: (table, rows) for every table under ``base``, from Parquet footers."""
    return spark.createDataFrame([(n, footers.row_count(spark, base, n)) for n in names],
                                 "table_name string, rows long")


def null_profile(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """A2 for one table: (field, nulls, pct) per column, one scan of ``df``."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.sum(F.col(c).isNull().cast("long")).alias(f"_n{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{label}.{c}', _n{i}" for i, c in enumerate(cols))
    long = one.selectExpr("_rows", f"stack({len(cols)}, {stack}) AS (field, nulls)")
    return long.select("field", F.coalesce(F.col("nulls"), F.lit(0)).alias("nulls"),
                       pct(F.coalesce(F.col("nulls"), F.lit(0)), "_rows")
                       .cast("double").alias("pct"))


def null_profile_report(roles: Roles) -> DataFrame:
    """A2: the critical nullable fields of the roles."""
    return _union([
        null_profile(roles.rental, ["return_date"], "rental"),
        null_profile(roles.payment, ["rental_id"], "payment"),
        null_profile(roles.customer, ["email"], "customer"),
        null_profile(roles.title, ["length", "rating"], "title"),
    ])


def orphans(left: DataFrame, right: DataFrame, key: str, check: str,
            right_key: str | None = None, ignore_null_key: bool = False) -> DataFrame:
    """A3: rows of ``left`` whose ``key`` has no match in ``right`` (one row)."""
    rk = right_key or key
    if ignore_null_key:
        left = left.where(F.col(key).isNotNull())
    keys = right.select(F.col(rk).alias("_k")).distinct()
    miss = left.select(key).join(keys, F.col(key) == F.col("_k"), "left_anti")
    return miss.agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check_name"), "n")


def inactive_customer_rentals(roles: Roles) -> DataFrame:
    """A3e: rentals made by inactive customers (one row)."""
    inactive = roles.customer.where(~F.col("active")).select("customer_id")
    n = roles.rental.join(inactive, "customer_id", "left_semi")
    return n.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rentals by inactive customers").alias("check_name"), "n")


def rentals_by_month(roles: Roles) -> DataFrame:
    """Rentals per ``yyyy-MM``."""
    return roles.rental.groupBy(F.date_format("rental_date", "yyyy-MM").alias("month")) \
        .agg(F.count(F.lit(1)).alias("rentals"))


def payments_by_year(roles: Roles) -> DataFrame:
    """Payments and revenue per calendar year (exposes out-of-period years)."""
    return roles.payment.groupBy(F.year("payment_date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("payments"),
        F.round(F.sum("amount"), 2).cast("double").alias("revenue"))


def order_violations(df: DataFrame, key, start: str, end: str) -> DataFrame:
    """Rows whose ``end`` precedes ``start``, with the day difference.
    ``key`` is a column name or a list of names carried to the output."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.where(F.col(end).isNotNull() & (F.col(end) < F.col(start))).select(
        *keys, start, end, elapsed_days(start, end).cast("long").alias("diff_days"))


def duration_outliers(df: DataFrame, start: str, end: str, days: int = 30) -> DataFrame:
    """A4d: rows whose calendar length exceeds ``days`` (one-row count)."""
    return df.where(F.col(end).isNotNull()
                    & (elapsed_days(start, end) > days)).agg(
        F.count(F.lit(1)).alias("n"))


def duplicate_keys(keyed: Mapping[str, tuple[DataFrame, object]]) -> DataFrame:
    """A5: COUNT(*) - COUNT(DISTINCT key) per table (NULL keys also count).
    A key is a column name or a tuple of names (composite key)."""
    frames = []
    for name, (df, key) in keyed.items():
        cols = [key] if isinstance(key, str) else list(key)
        rows = df.agg(F.count(F.lit(1)).alias("_rows"))
        # nearly all keys differ: counting them before the shuffle, as a distinct
        # count does, holds the keys of a whole file split in one task
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        keys = df.where(whole).select(*cols).repartition(
            partitions(df.sparkSession), *cols).distinct().agg(F.count(F.lit(1)).alias("_keys"))
        frames.append(rows.crossJoin(keys)  # two one-row aggregates
                      .select(F.lit(f"{name}.{'+'.join(cols)}").alias("check_name"),
                              (F.col("_rows") - F.col("_keys")).alias("duplicates")))
    return _union(frames)


def duplicate_keys_report(roles: Roles) -> DataFrame:
    return duplicate_keys({
        "rental": (roles.rental, "rental_id"),
        "payment": (roles.payment, "payment_id"),
        "copy": (roles.copy, "copy_id"),
        "title": (roles.title, "title_id"),
        "customer": (roles.customer, "customer_id"),
    })


# The key of each test table (composite where no column is unique).
RAW_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": ("l_orderkey", "l_linenumber"), "events": "event_id",
    "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
    "benchmark": "item_id", "labels": "doc_id", "conversations": ("conv_id", "turn"),
}


def raw_null_profile(spark: SparkSession, base: str, names: Sequence[str]) -> DataFrame:
    """A2 over every column of every table under ``base``: from Parquet footers,
    scanning nested columns only."""
    found = []  # a row for each column
    for name in names:
        rows, nulls = footers.null_counts(spark, base, name)
        found += [(f"{name}.{c}", n, rows) for c, n in nulls.items()]
    return spark.createDataFrame(found, "field string, nulls long, _rows long").select(
        "field", "nulls", pct("nulls", "_rows").cast("double").alias("pct"))


def key_ranges(spark: SparkSession, base: str, names: Sequence[str]) -> DataFrame:
    """Least and largest value of every whole-number column, from Parquet footers."""
    found = [(f"{name}.{c}", *ends) for name in names
             for c, ends in footers.ranges(spark, base, name, footers.WHOLE).items()]
    return spark.createDataFrame(found, "field string, low long, high long")


def raw_duplicate_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A5 over the key of every table; a table whose key is not known is an error."""
    unknown = sorted(set(tables) - set(RAW_KEYS))
    if unknown:
        raise KeyError(f"no key is known for {unknown}")
    return duplicate_keys({n: (df, RAW_KEYS[n]) for n, df in tables.items()})


def rows_by_month(df: DataFrame, ts: str) -> DataFrame:
    """A4a on any table: rows per ``yyyy-MM`` of ``ts``."""
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, col: str, bounded: bool = False) -> DataFrame:
    """Rows per value of ``col`` with share of all rows (``bounded=True``
    only for a column whose number of distinct values is fixed)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    g = with_share(g, "n", "pct", bounded=bounded)
    return g.select(col, "n", F.col("pct").cast("double").alias("pct"))


def active_split(roles: Roles) -> DataFrame:
    return distribution(roles.customer, "active", bounded=True)  # true, false, NULL


def copies_store_category(roles: Roles) -> DataFrame:
    """Copies per (store, category); copies of unknown stores are dropped."""
    c = copy_dim(roles).join(roles.store.select("store_id"), "store_id")
    return c.groupBy("store_id", "category").agg(F.count(F.lit(1)).alias("copies"))


def quality_scorecard(roles: Roles) -> DataFrame:
    """A8 (one row): volumes, open rentals, orphan payments, active
    customers, moved and idle copies -- one conditional aggregate per table."""
    r = roles.rental.agg(
        F.count(F.lit(1)).alias("rentals"),
        F.sum(F.col("return_date").isNull().cast("long")).alias("open_rentals"),
        F.countDistinct("copy_id").alias("moved_copies"))
    p = roles.payment.agg(
        F.count(F.lit(1)).alias("payments"),
        F.sum(F.col("rental_id").isNull().cast("long")).alias("orphan_payments"))
    c = roles.customer.agg(F.sum(F.col("active").cast("long")).alias("active_customers"))
    i = roles.copy.agg(F.count(F.lit(1)).alias("copies"))
    one = r.crossJoin(p).crossJoin(c).crossJoin(i)  # four one-row aggregates
    idle = F.col("copies") - F.col("moved_copies")
    return one.select(
        "rentals", "open_rentals",
        pct("open_rentals", "rentals").cast("double").alias("open_pct"),
        "payments", "orphan_payments",
        pct("orphan_payments", "payments").cast("double").alias("orphan_pct"),
        "active_customers", "moved_copies", "copies",
        idle.alias("idle_copies"),
        pct(idle, "copies").cast("double").alias("idle_pct"))
