"""Time series: monthly revenue and ticket, daily volume anomalies, weekday
profile, category revenue per month.

Months and days are bounded by the calendar (a few hundred or thousand rows
whatever the data volume), so LAG / running totals over them are plain
windows on a small aggregate; the fact tables only go through grouped
aggregation with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (WEEKDAY_NAMES, dec, mean, money_out, month_start, nonzero,
                               pct, weekday_name)
from ..functions.ranking import attach_one_row, small_rank_desc, with_share
from ..plans.cube import rolled_up, sales_cube
from ..plans.visits import month_customers
from ..sources.curated import derived
from ..sources.roles import Roles

# Anomaly labels.
PEAK, TROUGH, NORMAL = "Peak", "Trough", "Normal"


def monthly_revenue_dec(roles: Roles) -> DataFrame:
    """D1 aggregate: per payment month (payments naming a rental)."""
    return derived(roles, "month_sales", lambda: _month_sales(roles))


def _month_sales(roles: Roles) -> DataFrame:
    p = roles.named_payments.withColumn("month", month_start("payment_date"))
    # rentals are counted in two levels, customers from their sets
    by_rental = p.groupBy("rental_id", "month").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("amount").alias("revenue"))
    by_month = by_rental.groupBy("month").agg(
        F.sum("payments").alias("payments"), F.count(F.lit(1)).alias("rentals"),
        F.sum("revenue").alias("revenue"))
    return with_customers(by_month, month_customers(roles))


def with_customers(by_month: DataFrame, customers: DataFrame) -> DataFrame:
    customers = customers.withColumnRenamed("month", "_month")
    return by_month.join(customers, F.col("month").eqNullSafe(F.col("_month")), "left").select(
        "month", "payments", "rentals", "revenue",
        F.coalesce("customers", F.lit(0)).alias("customers"))


def monthly_revenue(roles: Roles, month_as_text: bool = True,
                    calendar: bool = False) -> DataFrame:
    """D1 (text month ``yyyy-MM-01``) / V4 (month start as a timestamp): revenue series with
    month-on-month change and running total.

    The change is against the row before, as in the source; ``calendar=True``
    compares with the calendar month before, NULL if that has no payments."""
    g = monthly_revenue_dec(roles)
    w = Window.orderBy("month")  # calendar-bounded: one small partition
    prev = F.lag("revenue").over(w)
    if calendar:
        prev = F.when(F.lag("month").over(w) == F.add_months("month", -1), prev)
    delta = F.col("revenue") - prev
    out = g.select(
        "*", delta.alias("_delta"), prev.alias("_prev"),
        F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"))
    month = (F.date_format("month", "yyyy-MM-dd") if month_as_text
             else F.col("month").cast("timestamp_ntz"))
    return out.select(
        month.alias("month"), "payments", "rentals",
        money_out("revenue").alias("revenue"),
        mean("revenue", "payments", 2, 2).cast("double").alias("avg_ticket"),
        "customers",
        money_out("_delta").alias("delta"),
        pct("_delta", "_prev").cast("double").alias("growth_pct"),
        money_out("_cum").alias("cumulative"))


def daily_anomalies(df: DataFrame, ts: str, k: int = 2, id_col: str | None = None) -> DataFrame:
    """Rows per day of ``ts`` (day start timestamp), labelled Peak / Trough / Normal against
    mean +- k population standard deviations of the days present.

    The mean and variance come from exact integer moments (N, sum n, sum n^2)
    of the daily counts, so the Peak/Trough tests are exact comparisons:
    n - mean > k*sigma  <=>  N*n - S1 > 0 and (N*n - S1)^2 > k^2 (N*S2 - S1^2).
    z = (N*n - S1) / sqrt(N*S2 - S1^2), NULL when every day has the same count.
    """
    return label_days(count_days(df, ts, id_col), k)


def count_days(df: DataFrame, ts: str, id_col: str | None = None) -> DataFrame:
    """Rows per day of ``ts``: as many rows as the calendar has days."""
    counted = F.count(id_col) if id_col else F.count(F.lit(1))
    return df.groupBy(F.to_date(ts).cast("timestamp_ntz").alias("day"),
                      weekday_name(ts).alias("weekday"),
                      F.dayofweek(ts).cast("long").alias("weekday_no")).agg(
        counted.alias("n"))


def label_days(days: DataFrame, k: int = 2) -> DataFrame:
    """``daily_anomalies`` from the counts per day (read twice)."""
    stats = days.agg(F.count(F.lit(1)).alias("_days"),
                     F.sum("n").alias("_s1"),
                     F.sum(dec("n", 38, 0) * dec("n", 38, 0)).alias("_s2"))
    j = attach_one_row(days, stats)
    dev = dec("_days", 38, 0) * dec("n", 38, 0) - dec("_s1", 38, 0)
    var = dec("_days", 38, 0) * dec("_s2", 38, 0) - dec("_s1", 38, 0) * dec("_s1", 38, 0)
    j = j.withColumn("_dev", dev).withColumn("_var", var)
    far = F.col("_dev") * F.col("_dev") > F.lit(k * k) * F.col("_var")
    label = (F.when((F.col("_dev") > 0) & far, PEAK)
              .when((F.col("_dev") < 0) & far, TROUGH)
              .otherwise(NORMAL))
    z = F.col("_dev").cast("double") / F.sqrt(nonzero("_var").cast("double"))
    z2 = F.signum(z) * F.floor(F.abs(z) * 100 + 0.5) / 100
    return j.select("day", "weekday", "weekday_no", "n",
                    mean("_s1", "_days", 0, 1).cast("double").alias("mean_daily"),
                    label.alias("label"), z2.alias("z"))


def rental_daily_anomalies(roles: Roles, k: int = 2) -> DataFrame:
    days = derived(roles, "rental_days",
                   lambda: count_days(roles.rental, "rental_date", "rental_id"))
    return label_days(days, k)


def weekday_label() -> Column:
    d = F.col("weekday_no")
    e = F.when(d == 1, f"1 - {WEEKDAY_NAMES[0]}")
    for i, name in enumerate(WEEKDAY_NAMES[1:], start=2):
        e = e.when(d == i, f"{i} - {name}")
    return e


def weekday_profile(roles: Roles) -> DataFrame:
    """D3: paid rentals per weekday (one per payment), mean ticket, share."""
    g = rolled_up(sales_cube(roles), "weekday_no").select(
        "weekday_no", weekday_label().alias("weekday"), F.col("n_pay").alias("rentals"), "revenue")
    g = with_share(g, "rentals", "pct", bounded=True)
    return g.select("weekday_no", "weekday", "rentals",
                    mean("revenue", "rentals", 2, 2).cast("double").alias("avg_ticket"),
                    F.col("pct").cast("double").alias("pct"))


def category_by_month(roles: Roles) -> DataFrame:
    """Revenue per payment month and category, rank inside the month."""
    g = rolled_up(sales_cube(roles), "month", "category").select(
        "month", "category", F.col("month_rentals").alias("rentals"), "revenue")
    # months x categories: calendar- and vocabulary-bounded.
    g = small_rank_desc(g, "revenue", "rank_in_month", ["month"])
    return g.select(F.date_format("month", "yyyy-MM-dd").alias("month"), "category",
                    "rentals", money_out("revenue").alias("revenue"), "rank_in_month")


def ticket_trend(roles: Roles) -> DataFrame:
    """Monthly mean ticket (to 4 decimals) with its change and % change."""
    p = roles.named_payments
    g = p.groupBy(month_start("payment_date").alias("month")).agg(
        mean(F.sum("amount"), F.count(F.lit(1)), 2, 4).alias("avg_ticket"))
    w = Window.orderBy("month")
    prev = F.lag("avg_ticket").over(w)
    g = g.select("*", prev.alias("_prev"), (F.col("avg_ticket") - prev).alias("_delta"))
    return g.select(F.date_format("month", "yyyy-MM-dd").alias("month"),
                    F.col("avg_ticket").cast("double").alias("avg_ticket"),
                    F.col("_delta").cast("double").alias("delta"),
                    pct("_delta", "_prev", scale=4).cast("double").alias("delta_pct"))
