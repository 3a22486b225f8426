"""Cohort retention, price elasticity, and length against lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import money_out, month_start, pct
from ..sources.curated import derived
from ..sources.roles import Roles
from .lateness import _late_base
from .revenue import _title_sales


def cohort_retention(roles: Roles) -> DataFrame:
    """Customers by the month of their first rental, and how many of them
    rent again each number of months later."""
    active = derived(roles, "active_months", lambda: roles.rental.where(
        F.col("customer_id").isNotNull() & F.col("rental_date").isNotNull()).select(
        "customer_id", month_start("rental_date").alias("month")).distinct())
    first = active.groupBy("customer_id").agg(F.min("month").alias("cohort"))
    g = active.join(first, "customer_id").groupBy(
        "cohort", F.months_between("month", "cohort").cast("long").alias("months_since")).agg(
        F.count(F.lit(1)).alias("customers"))
    # month zero holds the whole cohort; cohorts are bounded by the calendar
    size = F.first("customers").over(Window.partitionBy("cohort").orderBy("months_since"))
    return g.withColumn("cohort_size", size).select(
        F.date_format("cohort", "yyyy-MM-dd").alias("cohort"), "months_since", "customers",
        "cohort_size", pct("customers", "cohort_size").cast("double").alias("retention_pct"))


def price_elasticity(roles: Roles) -> DataFrame:
    """Rentals and revenue per price tier, and the elasticity of rentals per
    title against the next lower price, ln(q2 / q1) / ln(p2 / p1)."""
    # a title may be in several categories: count it once
    titles = _title_sales(roles).groupBy("title_id", "rental_rate").agg(
        F.first("rentals").alias("rentals"), F.first("revenue").alias("revenue"))
    tier = titles.groupBy("rental_rate").agg(
        F.count(F.lit(1)).alias("titles"), F.sum("rentals").alias("rentals"),
        F.sum("revenue").alias("revenue"))
    w = Window.orderBy("rental_rate")  # price tiers: a fixed vocabulary
    q = F.col("rentals").cast("double") / F.col("titles")
    p = F.col("rental_rate").cast("double")
    steps = F.log(p) - F.lag(F.log(p)).over(w)
    rise = F.log(q) - F.lag(F.log(q)).over(w)
    return tier.select(
        p.alias("rental_rate"), "titles", "rentals", money_out("revenue").alias("revenue"),
        F.round(rise / F.nullif(steps, F.lit(0.0)), 4).alias("elasticity"))


def length_lateness(roles: Roles) -> DataFrame:
    """P3 (one row): correlation of a title's length with its late rate, over
    titles with a length and a returned rental."""
    n, over = F.col("n"), F.col("over")
    rate = _late_base(roles, "calendar").groupBy("title_id").agg(
        (F.sum(F.when(over > 0, n).otherwise(0)) / F.sum("n")).alias("rate"))
    j = rate.join(roles.title.where(F.col("length").isNotNull()).select("title_id", "length"),
                  "title_id")
    return j.agg(F.count(F.lit(1)).alias("titles"),
                 F.round(F.corr(F.col("length").cast("double"), "rate"), 6).alias("correlation"))
