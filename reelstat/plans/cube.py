"""Stored sales at a bounded grain, from which the coarser reports roll up.

``sale_facts`` is the only place where the facts meet the copies: paid rentals
are joined to their copy and to the staff member who served them.  It is written
once, a row per rental and payment month: per (title, stores, month, weekday) there
are nearly as many, so summing before it is written would only shuffle them again.

``sales_cube`` goes from there to (month, weekday, copy store, sale store,
price, set of categories), a grain bounded by the calendar and by vocabularies,
whatever the number of sales.  A title's categories stay one set, so that a
title in several categories is not counted twice by the reports that do not ask
for categories; those that do unfold the set.

Measures: ``rentals`` counts a rental once, in the first month it was paid in,
so it adds up over months; ``month_rentals`` counts it in every month it was
paid in; ``revenue`` and ``n_pay`` are the payments.  Sales whose copy, title or
staff is unknown stay in, marked by ``held``, ``titled`` and ``served``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_start
from ..sources.curated import derived
from ..sources.roles import Roles
from .bases import SUM, paid_rentals

MEASURES = ("rentals", "month_rentals", "revenue", "n_pay")
#: Columns of the cube that reports may group by.
GRAIN = ("month", "weekday_no", "copy_store", "sale_store", "rental_rate", "categories")


def _sums() -> list:
    return [F.sum(m).alias(m) for m in MEASURES]


def _sale_facts(roles: Roles) -> DataFrame:
    paid = paid_rentals(roles, by=[month_start("payment_date").alias("month")])
    # rentals and payments lie by rental_id: this window shuffles nothing
    first = F.min("month").over(Window.partitionBy("rental_id"))
    lines = paid.select("copy_id", "staff_id", "month", F.col("paid").cast(SUM).alias("revenue"), "n_pay",
                        F.dayofweek("rental_date").cast("long").alias("weekday_no"),
                        F.col("month").eqNullSafe(first).cast("long").alias("rentals"),
                        F.lit(1).cast("long").alias("month_rentals"))
    copies = roles.copy.select("copy_id", "title_id", F.col("store_id").alias("copy_store"),
                               F.lit(True).alias("held"))
    staff = roles.staff.select("staff_id", F.col("store_id").alias("sale_store"),
                               F.lit(True).alias("served"))
    return lines.join(copies, "copy_id", "left").join(staff, "staff_id", "left").select(
        "title_id", "held", "copy_store", "sale_store", "served", "month", "weekday_no", *MEASURES)


def sale_facts(roles: Roles) -> DataFrame:
    return derived(roles, "sale_facts", lambda: _sale_facts(roles))


def title_totals(roles: Roles) -> DataFrame:
    """Per title of a sold copy: the measures."""
    return sale_facts(roles).where("held").groupBy("title_id").agg(*_sums())


def _sales_cube(roles: Roles) -> DataFrame:
    titles = roles.title.select("title_id", "rental_rate", F.lit(True).alias("titled"))
    names = roles.category.select("category_id", "name")
    # the categories of one title: a handful
    categories = roles.title_category.join(names, "category_id").groupBy("title_id").agg(
        F.sort_array(F.collect_list("name")).alias("categories"))
    facts = sale_facts(roles).join(titles.join(categories, "title_id", "left"), "title_id", "left")
    return facts.groupBy(*GRAIN, "held", "titled", "served").agg(*_sums())


def sales_cube(roles: Roles) -> DataFrame:
    return derived(roles, "sales_cube", lambda: _sales_cube(roles))


def rolled_up(cube: DataFrame, *by: str) -> DataFrame:
    """The measures per ``by`` (columns of the cube, ``category`` for a set unfolded)."""
    if "category" in by:
        cube = cube.withColumn("category", F.explode("categories"))
    return cube.groupBy(*by).agg(*_sums())
