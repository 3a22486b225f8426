"""KPI layer: the documented headline metrics in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import daily_rate, money_out, pct, ratio
from ..plans.bases import rented_copies
from ..sources.roles import Roles
from .lateness import _late_base


def kpi_row(roles: Roles, mode: str = "calendar") -> DataFrame:
    """K1-K6 (one row): total revenue (every payment), ticket per rental
    (revenue / payments naming a rental), frequency (rentals per renting
    customer, two-level distinct), late rate over returned rentals, network
    stock utilisation and estimated fee loss.  Each figure is one aggregate
    over one table; the one-row results are placed side by side."""
    pay = roles.payment.agg(F.sum("amount").alias("_rev"),
                            F.count("rental_id").alias("_paid_rentals"))
    per_cust = roles.rental.groupBy("customer_id").agg(F.count("rental_id").alias("_n"))
    freq = per_cust.agg(F.sum("_n").alias("_rentals"), F.count(F.lit(1)).alias("_customers"))
    n, over = F.col("n"), F.col("over")
    rate = daily_rate("rental_rate", "rental_duration")
    late = _late_base(roles, mode).agg(
        F.sum(F.when(over > 0, n).otherwise(0)).alias("_late"), F.sum("n").alias("_returned"),
        F.sum(F.when(over > 0, over * n * rate)).alias("_loss"))
    moved = rented_copies(roles).join(
        roles.copy.select("copy_id"), "copy_id").agg(F.count(F.lit(1)).alias("_moved"))
    copies = roles.copy.agg(F.count(F.lit(1)).alias("_copies"))
    one = (pay.crossJoin(freq).crossJoin(late).crossJoin(moved)
              .crossJoin(copies))  # five one-row aggregates
    return one.select(
        money_out("_rev").alias("total_revenue"),
        ratio("_rev", "_paid_rentals", 2).cast("double").alias("ticket_per_rental"),
        ratio("_rentals", "_customers", 2).cast("double").alias("rental_frequency"),
        pct("_late", "_returned").cast("double").alias("late_rate_pct"),
        pct("_moved", "_copies").cast("double").alias("stock_utilisation_pct"),
        money_out(F.coalesce(F.col("_loss"), F.lit(0))).alias("fee_loss"))
