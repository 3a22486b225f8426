"""Revenue and catalogue reports (category, title, price tier, idle titles).

Reports assume the keys audited by ``quality.duplicate_keys`` are unique:
after payments are pre-aggregated per rental, a COUNT(DISTINCT rental_id) of
the source is a row count at rental grain, and a COUNT(DISTINCT title) is a
row count of a per-title aggregate.  Both aggregate in two levels with
map-side partial aggregation, so no distinct-aggregate expansion is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import avg_money, money_out, ratio
from ..functions.ranking import rank_desc, small_rank_desc, top_n, with_share
from ..plans.bases import copy_dim, rented_copies, title_dim
from ..plans.cube import title_totals
from ..sources.curated import derived
from ..sources.roles import Roles


def _title_sales(roles: Roles) -> DataFrame:
    """Per title and category: rentals, revenue and payment count.

    Shared by the category, title and ranking reports; with curated roles it
    is written once (the distributed rank reads its input twice).
    """
    return derived(roles, "title_sales", lambda: _title_sales_plan(roles))


def _title_sales_plan(roles: Roles) -> DataFrame:
    return titles_of(title_totals(roles), roles)


def titles_of(totals: DataFrame, roles: Roles) -> DataFrame:
    """Sums per title with the title's terms, a row for each of its categories."""
    return totals.join(title_dim(roles), "title_id").groupBy(
        "title_id", "title", "category", "rental_rate", "rating").agg(
        F.sum("rentals").alias("rentals"),
        F.sum("revenue").alias("revenue"),
        F.sum("n_pay").alias("n_pay"))


def revenue_by_category(roles: Roles) -> DataFrame:
    """B1: rentals, titles, revenue, mean ticket, share, rank, revenue per title."""
    per_cat = _title_sales(roles).groupBy("category").agg(
        F.sum("rentals").alias("rentals"),
        F.count(F.lit(1)).alias("titles"),
        F.sum("revenue").alias("revenue"),
        F.sum("n_pay").alias("n_pay"))
    # Categories are a fixed vocabulary: ranking them in one window is bounded.
    out = with_share(per_cat, "revenue", "share_pct", bounded=True)
    out = small_rank_desc(out, "revenue", "revenue_rank")
    return out.select(
        "category", "rentals", "titles",
        money_out("revenue").alias("revenue"),
        avg_money("revenue", "n_pay").cast("double").alias("avg_ticket"),
        F.col("share_pct").cast("double").alias("share_pct"),
        "revenue_rank",
        ratio("revenue", "titles", 2).cast("double").alias("revenue_per_title"))


def _title_out(df: DataFrame) -> DataFrame:
    return df.select(
        "title_id", "title", "category",
        F.col("rental_rate").cast("double").alias("rental_rate"),
        "rating", "rentals",
        money_out("revenue").alias("revenue"),
        "rank_all", "rank_in_category")


def top_titles(roles: Roles, n: int = 10) -> DataFrame:
    """B2: the ``n`` titles with most revenue, with overall and in-category rank.

    A title's overall rank counts the titles with more revenue, and all of
    those are among the top ``n``; the same holds inside its category.  So the
    ranks of the survivors of a distributed top-n are the global ranks.
    """
    best = top_n(_title_sales(roles), "revenue", n, ["title_id", "category"])
    best = small_rank_desc(best, "revenue", "rank_all")
    best = small_rank_desc(best, "revenue", "rank_in_category", ["category"])
    return _title_out(best)


def title_ranking(roles: Roles) -> DataFrame:
    """V2: every title with overall and in-category revenue rank (no limit)."""
    ts = _title_sales(roles)
    # both ranks start from the stored table, not one from the other's plan
    within = rank_desc(ts.select(F.col("title_id").alias("_title"), F.col("category").alias("_cat"),
                                 "revenue"), "revenue", "rank_in_category", ["_cat"]).drop("revenue")
    both = rank_desc(ts, "revenue", "rank_all").join(
        within, F.col("title_id").eqNullSafe(F.col("_title"))
        & F.col("category").eqNullSafe(F.col("_cat")))
    return _title_out(both)


def _never_rented_copies(roles: Roles) -> DataFrame:
    return roles.copy.join(rented_copies(roles), "copy_id", "left_anti")


def titles_with_idle_copies(roles: Roles) -> DataFrame:
    """B3a (as the source computes it): titles owning at least one copy that
    was never rented, with the number of such copies."""
    idle = _never_rented_copies(roles).join(title_dim(roles), "title_id")
    return idle.groupBy("title_id", "title", "category", "rental_rate", "rating").agg(
        F.count(F.lit(1)).alias("idle_copies")).select(
        "title_id", "title", "category",
        F.col("rental_rate").cast("double").alias("rental_rate"),
        "rating", "idle_copies")


def unrented_titles(roles: Roles, per_store: bool = False) -> DataFrame:
    """B3b (as the source states it): titles that own copies none of which was
    ever rented.  ``per_store`` asks the same per (copy store, title)."""
    keys = ["store_id", "title_id"] if per_store else ["title_id"]
    rented = (rented_copies(roles)
              .join(roles.copy, "copy_id").select(*keys))
    owned = roles.copy.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    none_rented = owned.join(rented, keys, "left_anti")
    out = none_rented.join(title_dim(roles), "title_id")
    return out.select(
        *keys, "title", "category",
        F.col("rental_rate").cast("double").alias("rental_rate"),
        "rating", "copies")


def top_titles_per_category(roles: Roles, k: int = 3) -> DataFrame:
    """Top-``k`` titles (by title text) per category, RANK ties kept.

    Ranks come from a window partitioned by category followed by a rank
    filter; Spark plans that as a per-task group limit before the shuffle, so
    only each task's local top-k per category moves.
    """
    per = _title_sales(roles).groupBy("category", "title").agg(
        F.sum("rentals").alias("rentals"), F.sum("revenue").alias("revenue"))
    ranked = small_rank_desc(per, "revenue", "category_rank", ["category"])
    return ranked.where(F.col("category_rank") <= k).select(
        "category", "title", "rentals",
        money_out("revenue").alias("revenue"), "category_rank")


def revenue_by_price_tier(roles: Roles) -> DataFrame:
    """Titles, rentals, revenue, ticket, share and rentals per title by base price."""
    per_title = title_totals(roles).join(roles.title.select("title_id", "rental_rate"), "title_id")
    tier = per_title.groupBy("rental_rate").agg(
        F.count(F.lit(1)).alias("titles"),
        F.sum("rentals").alias("rentals"),
        F.sum("revenue").alias("revenue"),
        F.sum("n_pay").alias("n_pay"))
    tier = with_share(tier, "revenue", "share_pct", bounded=True)
    return tier.select(
        F.col("rental_rate").cast("double").alias("rental_rate"),
        "titles", "rentals",
        money_out("revenue").alias("revenue"),
        avg_money("revenue", "n_pay").cast("double").alias("avg_ticket"),
        F.col("share_pct").cast("double").alias("share_pct"),
        ratio("rentals", "titles", 1).cast("double").alias("rentals_per_title"))


def revenue_per_copy(roles: Roles) -> DataFrame:
    """Category revenue divided by the copies the category has in stock."""
    rev = _title_sales(roles).groupBy("category").agg(F.sum("revenue").alias("revenue"))
    stock = copy_dim(roles).groupBy("category").agg(F.count(F.lit(1)).alias("copies"))
    j = stock.join(rev, "category", "left")
    return j.select(
        "category",
        money_out(F.coalesce(F.col("revenue"), F.lit(0))).alias("revenue"),
        "copies",
        ratio(F.coalesce(F.col("revenue"), F.lit(0)), "copies", 2)
        .cast("double").alias("revenue_per_copy"))
