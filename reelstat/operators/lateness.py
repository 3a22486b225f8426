"""Late returns: per-customer lateness, segment rates, day bands, fee loss.

Lateness is ``days - rental_duration`` where ``days`` is the calendar-date
difference of return and rental (``mode="calendar"``, the source SQL) or the
whole elapsed days of the interval (``mode="elapsed"``, the documented
alternative).  Open rentals (no return date) are excluded from every
lateness figure and counted in volumes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (daily_rate, days_over, elapsed_days, floor_zero, mean, money_out,
                               pct, ratio)
from ..functions.ranking import small_rank_desc, with_share
from ..plans.bases import copy_dim, returned_with_title
from ..sources.curated import derived, for_one_pass
from ..sources.roles import Roles
from .customers import customer_metrics_dec, segment_customers, segment_cuts

# Late-day band labels and their inclusive upper edges.
BAND_ON_TIME = "00 - on time"
BANDS = [("01-02 days late", 1, 2), ("03-07 days late", 3, 7), ("08-14 days late", 8, 14)]
BAND_LONG = "15+ days late"


def _over(mode: str) -> Column:
    return days_over("rental_date", "return_date", "rental_duration", mode)


def lateness_rows(roles: Roles) -> DataFrame:
    """K7: every rental with late days (floored at 0) and the late flag,
    NULL while the rental is open; both lateness modes.

    Every rental is read once here, so neither rentals nor copies are written first;
    of a copy only the duration meets them."""
    durations = for_one_pass(roles, "title").select("title_id", "rental_duration")
    copies = for_one_pass(roles, "copy").select("copy_id", "title_id").join(
        durations, "title_id").drop("title_id")
    r = for_one_pass(roles, "rental").join(copies, "copy_id")
    out = [F.col("rental_id"), F.col("customer_id")]
    for mode in ("calendar", "elapsed"):
        d = _over(mode)
        out.append(floor_zero(d).cast("long").alias(f"late_days_{mode}"))
        out.append(F.when(F.col("return_date").isNull(), F.lit(None))
                    .when(d > 0, F.lit(1)).otherwise(F.lit(0))
                    .cast("long").alias(f"late_flag_{mode}"))
    return r.select(*out)


def customer_lateness_dec(roles: Roles, mode: str = "calendar") -> DataFrame:
    """C4a with exact decimals."""
    d = _over(mode)
    late = d > 0
    return returned_with_title(roles).groupBy("customer_id").agg(
        F.count("rental_id").alias("returned"),
        F.sum(F.when(late, 1).otherwise(0)).alias("late"),
        mean(F.sum(F.when(late, d)), F.count(F.when(late, d)), 0, 1).alias("avg_late_days"),
        F.max(floor_zero(d)).alias("max_late_days"))


def customer_lateness(roles: Roles, mode: str = "calendar") -> DataFrame:
    """Returned rentals, late ones, mean lateness of late ones, maximum."""
    c = customer_lateness_dec(roles, mode)
    return c.select("customer_id", "returned", "late",
                    F.col("avg_late_days").cast("double").alias("avg_late_days"),
                    F.col("max_late_days").cast("long").alias("max_late_days"))


def segment_lateness_dec(roles: Roles, mode: str = "calendar") -> DataFrame:
    seg = segment_customers(customer_metrics_dec(roles), segment_cuts(roles)).select(
        "customer_id", "segment")
    a = customer_lateness_dec(roles, mode).join(seg, "customer_id")
    return a.groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        F.sum("late").alias("late"),
        F.sum("returned").alias("returned"),
        F.sum("avg_late_days").alias("_sum_avg"),
        F.count("avg_late_days").alias("_n_avg"),
        F.sum("max_late_days").alias("_sum_max"),
        F.count("max_late_days").alias("_n_max"))


def segment_lateness(roles: Roles, mode: str = "calendar") -> DataFrame:
    """Late rate per segment; means of the per-customer means and maxima."""
    g = segment_lateness_dec(roles, mode)
    return g.select(
        "segment", "customers", "late", "returned",
        pct("late", "returned").cast("double").alias("late_rate_pct"),
        mean("_sum_avg", "_n_avg", 1, 1).cast("double").alias("avg_late_days"),
        mean("_sum_max", "_n_max", 0, 1).cast("double").alias("avg_max_late_days"))


def _band(d: Column) -> Column:
    b = F.when(d <= 0, BAND_ON_TIME)
    for label, lo, hi in BANDS:
        b = b.when(d.between(lo, hi), label)
    return b.otherwise(BAND_LONG)


def _late_base(roles: Roles, mode: str) -> DataFrame:
    """Returned rentals per title and days over: title_id, rental_rate,
    rental_duration, over (NULL without a duration), n, n_ids.  Bounded by
    titles x days, written once; the figures over all rentals roll up from it."""
    return derived(roles, f"late_base_{mode}", lambda: _late_plan(roles, mode))


def _late_plan(roles: Roles, mode: str) -> DataFrame:
    # the days, and whether there is an id, are all that has to meet the copies
    r = roles.rental.where(F.col("return_date").isNotNull()).select(
        "copy_id", elapsed_days("rental_date", "return_date", mode).alias("_days"),
        F.when(F.col("rental_id").isNotNull(), 1).alias("rental_id"))
    return late_counts(r.join(copy_dim(roles, False), "copy_id"),
                       over=F.col("_days") - F.col("rental_duration"))


def late_counts(returned: DataFrame, mode: str = "calendar",
                over: Column | None = None) -> DataFrame:
    over = _over(mode) if over is None else over
    return returned.groupBy(
        "title_id", "rental_rate", "rental_duration", over.alias("over")).agg(
        F.count(F.lit(1)).alias("n"), F.count("rental_id").alias("n_ids"))


def late_bands(roles: Roles, mode: str = "calendar") -> DataFrame:
    """Returned rentals per late-day band with share of all returned."""
    g = _late_base(roles, mode).groupBy(_band(F.col("over")).alias("band")).agg(
        F.sum("n").alias("rentals"))
    g = with_share(g, "rentals", "pct", bounded=True)
    return g.select("band", "rentals", F.col("pct").cast("double").alias("pct"))


def _late(roles: Roles, mode: str) -> DataFrame:
    return _late_base(roles, mode).where(F.col("over") > 0).withColumn(
        "_rate", daily_rate("rental_rate", "rental_duration"))


def _loss_aggs():
    return [F.sum("n_ids").alias("late_rentals"),
            F.sum(F.col("over") * F.col("n")).alias("late_days"),
            F.sum(F.col("over") * F.col("n") * F.col("_rate")).alias("_loss")]


def fee_loss_total(roles: Roles, mode: str = "calendar") -> DataFrame:
    """C6 (one row): late rentals, late days, mean daily rate, total estimated
    uncharged fee and fee per late rental."""
    g = _late(roles, mode).agg(
        *_loss_aggs(), F.sum(F.col("_rate") * F.col("n")).alias("_rate_sum"),
        F.sum(F.when(F.col("_rate").isNotNull(), F.col("n"))).alias("_rate_n"))
    return g.select(
        F.coalesce("late_rentals", F.lit(0)).alias("late_rentals"),
        F.col("late_days").cast("long").alias("late_days"),
        mean("_rate_sum", "_rate_n", 6, 4).cast("double").alias("avg_daily_rate"),
        money_out("_loss").alias("total_loss"),
        ratio("_loss", "late_rentals", 2, scale=6).cast("double").alias("loss_per_late_rental"))


def fee_loss_by_category_dec(roles: Roles, mode: str = "calendar") -> DataFrame:
    categories = roles.title_category.join(roles.category.select(
        "category_id", F.col("name").alias("category")), "category_id")
    g = _late(roles, mode).join(categories, "title_id").groupBy("category").agg(*_loss_aggs())
    return small_rank_desc(g, "_loss", "loss_rank")


def fee_loss_by_category(roles: Roles, mode: str = "calendar") -> DataFrame:
    """Fee loss per category with its rank (by the unrounded loss)."""
    g = fee_loss_by_category_dec(roles, mode)
    return g.select("category", "late_rentals",
                    F.col("late_days").cast("long").alias("late_days"),
                    money_out("_loss").alias("loss"), "loss_rank")


def fee_loss_view(roles: Roles, mode: str = "calendar") -> DataFrame:
    """V8: C7 plus each category's share of the total loss."""
    g = with_share(fee_loss_by_category_dec(roles, mode), "_loss", "share_pct", bounded=True,
                   scale=6)
    return g.select("category", "late_rentals",
                    F.col("late_days").cast("long").alias("late_days"),
                    money_out("_loss").alias("loss"),
                    F.col("share_pct").cast("double").alias("share_pct"), "loss_rank")


def late_rate_gap(roles: Roles, mode: str = "calendar") -> DataFrame:
    """Each segment's late rate against the rate over all returned
    rentals, and the share of late rentals that are 1-2 days late."""
    seg = segment_lateness_dec(roles, mode)
    n, over = F.col("n"), F.col("over")
    overall = _late_base(roles, mode).agg(
        F.sum(F.when(over > 0, n).otherwise(0)).alias("_all_late"), F.sum("n").alias("_all_ret"),
        F.sum(F.when(over.between(1, 2), n).otherwise(0)).alias("_short_late"))
    j = seg.crossJoin(F.broadcast(overall))  # one-row frame
    rate = pct("late", "returned")
    all_rate = pct("_all_late", "_all_ret")
    return j.select(
        "segment",
        rate.cast("double").alias("late_rate_pct"),
        all_rate.cast("double").alias("overall_late_rate_pct"),
        (rate - all_rate).cast("double").alias("gap_pp"),
        pct("_short_late", "_all_late").cast("double").alias("short_late_share_pct"))
