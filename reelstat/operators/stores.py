"""Stores, stock and staff.

Two store attributions coexist, as in the source: sales belong to the store
of the staff member who served the rental; stock belongs to the store that
owns the copy.  Sums per store and per staff member come from one stored table
of visits (staff, customer, month), distinct customers from the stored sets of
``plans.visits``, which roll up; NULL is no customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dec, mean, month_start, money_out, pct, ratio
from ..functions.ranking import rank_desc, small_rank_desc, with_share
from ..plans.bases import copy_dim, paid_rentals, rented_copies, title_dim
from ..plans.cube import rolled_up, sales_cube
from ..plans.visits import staff_sales, store_sales
from ..sources.curated import derived
from ..sources.roles import Roles

# Utilisation labels (long report form, short view form) and cuts.
UTIL_LABELS = ("High utilisation", "Moderate utilisation", "Low utilisation")
UTIL_LABELS_SHORT = ("High", "Moderate", "Low")
UTIL_HIGH, UTIL_MODERATE = 90, 60


def store_performance(roles: Roles) -> DataFrame:
    """Rentals, customers, revenue, ticket and per-customer figures per store."""
    g = with_share(store_sales(roles), "revenue", "share_pct", bounded=True)
    return g.select(
        "store_id", "rentals", "customers",
        money_out("revenue").alias("revenue"),
        mean("revenue", "n_pay", 2, 2).cast("double").alias("avg_ticket"),
        ratio("revenue", "customers", 2).cast("double").alias("revenue_per_customer"),
        ratio("rentals", "customers", 2).cast("double").alias("rentals_per_customer"),
        F.col("share_pct").cast("double").alias("share_pct"))


def store_category(roles: Roles) -> DataFrame:
    """Revenue per (sale store, category) with rank inside the store."""
    g = rolled_up(sales_cube(roles).where("served"), "sale_store", "category") \
        .withColumnRenamed("sale_store", "store_id")
    g = small_rank_desc(g, "revenue", "rank_in_store", ["store_id"])  # stores x categories
    return g.select("store_id", "category", "rentals",
                    money_out("revenue").alias("revenue"), "rank_in_store")


def _copies_with_use(roles: Roles, with_category: bool = True) -> DataFrame:
    """Every copy with ``_moved`` = 1 if it was rented at least once, else NULL."""
    rented = rented_copies(roles).withColumn("_moved", F.lit(1))
    base = copy_dim(roles) if with_category else roles.copy
    return base.join(rented, "copy_id", "left")


def _util_label(moved, copies, labels) -> F.Column:
    m100 = dec(moved, 38, 0) * 100
    return (F.when(m100 >= dec(copies, 38, 0) * UTIL_HIGH, labels[0])
             .when(m100 >= dec(copies, 38, 0) * UTIL_MODERATE, labels[1])
             .otherwise(labels[2]))


def stock_utilisation(roles: Roles, short_labels: bool = False) -> DataFrame:
    """Copies, moved, idle and utilisation per (copy store, category).

    One pass: copies left-joined to the distinct rented copy ids.  The label
    is decided on the unrounded ratio (exact integer comparison).
    """
    g = _copies_with_use(roles).groupBy("store_id", "category").agg(
        F.count(F.lit(1)).alias("copies"), F.count("_moved").alias("moved"))
    labels = UTIL_LABELS_SHORT if short_labels else UTIL_LABELS
    return g.select(
        "store_id", "category", "copies", "moved",
        (F.col("copies") - F.col("moved")).alias("idle"),
        pct("moved", "copies").cast("double").alias("utilisation_pct"),
        _util_label("moved", "copies", labels).alias("label"))


def _idle_by_store_title(roles: Roles) -> DataFrame:
    idle = roles.copy.join(rented_copies(roles), "copy_id", "left_anti")
    return idle.join(title_dim(roles), "title_id").groupBy(
        "store_id", "title", "category", "rental_rate", "replacement_cost").agg(
        F.count(F.lit(1)).alias("idle_copies"))


def idle_stock(roles: Roles) -> DataFrame:
    """Never-rented copies per (store, title text) and immobilised cost."""
    g = _idle_by_store_title(roles)
    return g.select(
        "store_id", "title", "category",
        F.col("rental_rate").cast("double").alias("rental_rate"),
        F.col("replacement_cost").cast("double").alias("replacement_cost"),
        "idle_copies",
        money_out(F.col("idle_copies") * F.col("replacement_cost")).alias("immobilised"))


def idle_value_by_category(roles: Roles) -> DataFrame:
    """Idle copies and immobilised value per category, with the
    category's share of all idle copies."""
    g = _idle_by_store_title(roles).groupBy("category").agg(
        F.sum("idle_copies").alias("idle_copies"),
        F.sum(F.col("idle_copies") * F.col("replacement_cost")).alias("_value"))
    g = with_share(g, "idle_copies", "idle_share_pct", bounded=True)
    return g.select("category", "idle_copies", money_out("_value").alias("immobilised"),
                    F.col("idle_share_pct").cast("double").alias("idle_share_pct"))


def _stock_by_store(roles: Roles) -> DataFrame:
    return _copies_with_use(roles, with_category=False).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("copies"), F.count("_moved").alias("moved"))


def store_scorecard(roles: Roles, view: bool = False) -> DataFrame:
    """E5 (``view=False``) / V5: sales KPIs by sale store joined (inner) to
    stock KPIs by copy store."""
    j = store_sales(roles).join(_stock_by_store(roles), "store_id")
    cols = ["store_id", "rentals", "customers",
            money_out("revenue").alias("revenue"),
            mean("revenue", "n_pay", 2, 2).cast("double").alias("avg_ticket"),
            ratio("revenue", "customers", 2).cast("double").alias("revenue_per_customer")]
    if view:
        j = with_share(j, "revenue", "share_pct", bounded=True)
        cols += [ratio("rentals", "customers", 2).cast("double").alias("rentals_per_customer"),
                 F.col("share_pct").cast("double").alias("share_pct")]
    cols += ["copies", "moved", (F.col("copies") - F.col("moved")).alias("idle"),
             pct("moved", "copies").cast("double").alias("utilisation_pct")]
    return j.select(*cols)


def staff_performance(roles: Roles) -> DataFrame:
    """Per staff member with paid rentals: volume, customers,
    revenue, ticket, share, rank (distributed: staff count grows with data)."""
    staff = roles.staff.select(
        "staff_id", F.concat("first_name", F.lit(" "), "last_name").alias("staff_name"),
        "store_id")
    # written: the total, the rank and the output each read it
    j = derived(roles, "staff_with_sales", lambda: staff_sales(roles).join(staff, "staff_id"))
    j = with_share(j, "revenue", "share_pct")
    j = rank_desc(j, "revenue", "revenue_rank")
    return j.select(
        "staff_id", "staff_name", "store_id", "rentals", "customers",
        money_out("revenue").alias("revenue"),
        mean("revenue", "n_pay", 2, 2).cast("double").alias("avg_ticket"),
        F.col("share_pct").cast("double").alias("share_pct"), "revenue_rank",
        ratio("revenue", "customers", 2).cast("double").alias("revenue_per_customer"))


def staff_by_month(roles: Roles) -> DataFrame:
    """Revenue per payment month and staff member, rank inside the month
    (distributed rank partitioned by month)."""
    g = derived(roles, "staff_month_sales", lambda: paid_rentals(
        roles, by=[month_start("payment_date").alias("month")]).groupBy("month", "staff_id").agg(
        F.count(F.lit(1)).alias("rentals"), F.sum("paid").alias("revenue")))
    staff = roles.staff.select(
        "staff_id", F.concat("first_name", F.lit(" "), "last_name").alias("staff_name"),
        "store_id")
    j = g.join(staff, "staff_id")
    j = rank_desc(j, "revenue", "rank_in_month", ["month"])
    return j.select(F.date_format("month", "yyyy-MM-dd").alias("month"), "staff_id",
                    "staff_name", "store_id", "rentals",
                    money_out("revenue").alias("revenue"), "rank_in_month")


def price_mix_by_store(roles: Roles) -> DataFrame:
    """Paid rentals per (sale store, base price) and share inside the store."""
    g = rolled_up(sales_cube(roles).where("served and titled"), "sale_store", "rental_rate") \
        .withColumnRenamed("sale_store", "store_id")
    tot = g.groupBy("store_id").agg(F.sum("rentals").alias("_store_rentals"))
    j = g.join(tot, "store_id")  # stores x prices: bounded
    return j.select("store_id", F.col("rental_rate").cast("double").alias("rental_rate"),
                    "rentals",
                    pct("rentals", "_store_rentals").cast("double").alias("share_in_store_pct"))
