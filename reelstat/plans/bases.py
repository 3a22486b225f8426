"""Shared join bases of the reports.

Join order is chosen for the fact tables, which are the only large inputs:

* payments are pre-aggregated per rental (and per extra key such as the
  payment month) before they meet ``rental`` -- a hot rental id collapses in
  map-side aggregation instead of landing in one join task;
* the dimension chain copy -> title -> title_category -> category is joined
  first (dimension-sized work, keyed by title), so the fact side is shuffled
  once, by ``copy_id``, to pick up every dimension attribute at once.

All joins are left to Spark, which broadcasts a side only after measuring it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.curated import derived
from ..sources.roles import Roles

#: Type of summed payments of several rentals.
SUM = "decimal(32,2)"


def payments_per_rental(roles: Roles, by: Sequence[Column] = ()) -> DataFrame:
    """(rental_id, *by, paid, n_pay) over payments that name a rental."""
    p = roles.named_payments
    return p.groupBy("rental_id", *by).agg(
        F.sum("amount").alias("paid"),
        F.count(F.lit(1)).alias("n_pay"))


def paid_rentals(roles: Roles, by: Sequence[Column] = ()) -> DataFrame:
    """Rentals with at least one payment, one row per rental (and ``by``)."""
    return roles.rental.join(payments_per_rental(roles, by), "rental_id")


def title_dim(roles: Roles) -> DataFrame:
    """Title attributes with the category name (one row per title-category)."""
    cat = roles.category.select("category_id", F.col("name").alias("category"))
    return (roles.title
            .join(roles.title_category, "title_id")
            .join(cat, "category_id"))


def copy_dim(roles: Roles, with_category: bool = True) -> DataFrame:
    """Copies with their title (and category) attributes."""
    titles = title_dim(roles) if with_category else roles.title
    return roles.copy.join(titles, "title_id")


def sales(roles: Roles, by: Sequence[Column] = ()) -> DataFrame:
    """Paid rentals with copy, title and category attributes.

    ``store_id`` here is the store that owns the copy; the store that made the
    sale comes from the staff member (see :func:`with_sale_store`).
    """
    return paid_rentals(roles, by).join(copy_dim(roles), "copy_id")


def with_sale_store(df: DataFrame, roles: Roles, name: str = "sale_store") -> DataFrame:
    """Attribute each row to the store of the staff member who served it."""
    staff = roles.staff.select("staff_id", F.col("store_id").alias(name))
    return df.join(staff, "staff_id")


def rented_copies(roles: Roles) -> DataFrame:
    """The ids of the copies that were rented at least once."""
    return derived(roles, "rented_copies", lambda: roles.rental.select("copy_id").distinct())


def returned_with_title(roles: Roles, with_category: bool = False) -> DataFrame:
    """Returned rentals (return_date known) with the rented title's terms."""
    r = roles.rental.where(F.col("return_date").isNotNull())
    return r.join(copy_dim(roles, with_category), "copy_id")
