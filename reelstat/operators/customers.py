"""Customer value: lifetime value, top customers, LTV x frequency segments.

Per-customer figures are aggregated from the rental-grain fact *before* the
customer dimension is joined, so the fact is shuffled once by customer id
(with map-side partial aggregation) and the dimension join reuses that
partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dec, mean, money_out, pct, ratio
from ..functions.ordered import previous_row, running_sum
from ..functions.quantiles import approx_quantiles, grouped_quantiles
from ..functions.ranking import (attach_one_row, median, median_of_counts, rank_desc,
                                 small_rank_desc, top_n, with_share)
from ..plans.bases import paid_rentals
from ..sources.curated import derived
from ..sources.roles import Roles

# Quadrant labels (LTV x frequency, medians as cut points).
CHAMPIONS = "Champions"
HIGH_VALUE = "High Value"
FREQUENT_LOW_VALUE = "Frequent Low Value"
AT_RISK = "At Risk"


def customer_metrics_dec(roles: Roles, active_only: bool = True) -> DataFrame:
    """C1 with exact decimals: one row per customer with a paid rental.

    Segment reports read this table three or four times in one plan (two
    medians, a rank, a total), so with curated roles it is written once
    (``sources.curated.derived``) instead of being recomputed per branch.
    """
    name = "customer_metrics_active" if active_only else "customer_metrics_all"
    return derived(roles, name, lambda: _customer_metrics(roles, active_only))


def _customer_metrics(roles: Roles, active_only: bool) -> DataFrame:
    return metrics_of(customer_sums(paid_rentals(roles).withColumn("once", F.lit(1))), roles,
                      active_only)


def customer_sums(sales: DataFrame) -> DataFrame:
    """Per customer of ``sales`` (paid, once, rental_date): what adds up over them."""
    return sales.groupBy("customer_id").agg(
        F.sum("paid").alias("ltv"),
        F.sum("once").cast("long").alias("rentals"),
        F.min("rental_date").alias("first_rental"),
        F.max("rental_date").alias("last_rental"))


def metrics_of(per: DataFrame, roles: Roles, active_only: bool = True) -> DataFrame:
    """C1 from the sums per customer."""
    cust = roles.customer
    if active_only:
        cust = cust.where(F.col("active"))
    m = per.join(cust, "customer_id")
    return m.select(
        "customer_id",
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("customer_name"),
        "store_id", "ltv", "rentals",
        ratio("ltv", "rentals", 2).alias("avg_ticket"),
        "first_rental", "last_rental",
        F.datediff("last_rental", "first_rental").cast("long").alias("tenure_days"))


def customer_metrics(roles: Roles, active_only: bool = True) -> DataFrame:
    """C1 report: LTV, rentals, ticket, first/last rental, tenure."""
    m = customer_metrics_dec(roles, active_only)
    return m.select(
        "customer_id", "customer_name", "store_id",
        money_out("ltv").alias("ltv"), "rentals",
        F.col("avg_ticket").cast("double").alias("avg_ticket"),
        "first_rental", "last_rental", "tenure_days")


def top_customers(roles: Roles, n: int = 20) -> DataFrame:
    """Top ``n`` customers by LTV with rank and share of all LTV."""
    m = customer_metrics_dec(roles)
    total = m.agg(F.sum("ltv").alias("_ltv_total"))
    best = top_n(m, "ltv", n, ["customer_id"])
    best = small_rank_desc(best, "ltv", "ltv_rank")
    best = attach_one_row(best, total)
    return best.select(
        "customer_id", "customer_name", "store_id",
        money_out("ltv").alias("ltv"), "rentals",
        F.col("avg_ticket").cast("double").alias("avg_ticket"),
        "tenure_days", "ltv_rank",
        pct("ltv", "_ltv_total").cast("double").alias("share_pct"))


def medians_of(m: DataFrame) -> DataFrame:
    """One row: the medians of LTV and of rentals.

    LTV has up to one distinct value per customer: distributed exact median.
    Rental counts have at most sqrt(2N) distinct values: exact percentile."""
    return median(m, "ltv", "median_ltv").crossJoin(
        median_of_counts(m, "rentals", "median_rentals"))  # one row x one row


def segment_cuts(roles: Roles) -> DataFrame:
    """The medians over the active customers, kept beside their metrics."""
    return derived(roles, "segment_cuts", lambda: medians_of(customer_metrics_dec(roles)))


def segment_customers(m: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """C3 row level: add ``segment`` from the exact medians of LTV and rentals
    (``cuts``, by default those of ``m``)."""
    s = attach_one_row(m, medians_of(m) if cuts is None else cuts)
    hi_v = F.col("ltv") >= F.col("median_ltv")
    hi_f = F.col("rentals") >= F.col("median_rentals")
    seg = (F.when(hi_v & hi_f, CHAMPIONS)
            .when(hi_v & ~hi_f, HIGH_VALUE)
            .when(~hi_v & hi_f, FREQUENT_LOW_VALUE)
            .otherwise(AT_RISK))
    return s.withColumn("segment", seg).drop("median_ltv", "median_rentals")


def segment_summary(roles: Roles) -> DataFrame:
    """C3 summary: customers, revenue, their shares and means per segment."""
    s = segment_customers(customer_metrics_dec(roles), segment_cuts(roles))
    g = s.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("ltv").alias("revenue"),
        F.sum("rentals").alias("rentals_sum"),
        F.sum("avg_ticket").alias("ticket_sum"))
    g = with_share(g, "customers", "pct_customers", bounded=True)
    g = with_share(g, "revenue", "pct_revenue", bounded=True)
    return g.select(
        "segment", "customers",
        F.col("pct_customers").cast("double").alias("pct_customers"),
        money_out("revenue").alias("revenue"),
        F.col("pct_revenue").cast("double").alias("pct_revenue"),
        mean("revenue", "customers", 2, 2).cast("double").alias("avg_ltv"),
        mean("rentals_sum", "customers", 0, 1).cast("double").alias("avg_frequency"),
        mean("ticket_sum", "customers", 2, 2).cast("double").alias("avg_ticket"))


def customer_segments_view(roles: Roles) -> DataFrame:
    """V3: every active paying customer with rank, share of LTV and segment.

    The global LTV rank is distributed (``rank_desc``): the customer count
    grows with the data, so a single ordered window is not an option.
    """
    m = customer_metrics_dec(roles)
    total = m.agg(F.sum("ltv").alias("_ltv_total"))
    s = segment_customers(m, segment_cuts(roles))
    s = rank_desc(s, "ltv", "ltv_rank")
    s = attach_one_row(s, total)
    return s.select(
        "customer_id", "customer_name", "store_id",
        money_out("ltv").alias("ltv"), "rentals",
        F.col("avg_ticket").cast("double").alias("avg_ticket"),
        "ltv_rank",
        pct("ltv", "_ltv_total").cast("double").alias("share_pct"),
        "segment")


# The quantiles that ``ltv_quantiles_by_store`` reports.
LTV_QUANTILES = {"p10": "0.1", "p25": "0.25", "p50": "0.5", "p75": "0.75", "p90": "0.9",
                 "p99": "0.99"}


def ltv_quantiles_by_store(roles: Roles, approximate: bool = False) -> DataFrame:
    """Quantiles of the LTV of active paying customers, per store they belong to
    (exact; ``approximate`` takes values of nearby rank in one aggregate)."""
    locate = approx_quantiles if approximate else grouped_quantiles
    q = locate(customer_metrics_dec(roles), ["store_id"], "ltv", LTV_QUANTILES)
    return q.select("store_id", F.col("n").alias("customers"),
                    *[F.col(c).cast("double").alias(c) for c in LTV_QUANTILES])


def running_ltv(roles: Roles) -> DataFrame:
    """Every payment with its place among its customer's payments, by date and
    id, and what the customer has paid up to and with it."""
    p = roles.payment.select("payment_id", "customer_id", "payment_date", "amount")
    out = running_sum(p, ["customer_id"], ["payment_date", "payment_id"],
                      {"payment_no": F.lit(1).cast("long"), "running": F.col("amount")})
    return out.select("payment_id", "customer_id", "payment_date",
                      money_out("amount").alias("amount"), "payment_no",
                      money_out("running").alias("running_ltv"))


def rental_gaps(roles: Roles) -> DataFrame:
    """Every rental with its customer's rental before it, by date and id, and
    the calendar days between the two (NULL for a first rental)."""
    r = roles.rental.select("rental_id", "customer_id", "rental_date")
    out = previous_row(r, ["customer_id"], ["rental_date", "rental_id"],
                       {"previous_rental_id": "rental_id", "_date": "rental_date"})
    return out.select("rental_id", "customer_id", "rental_date", "previous_rental_id",
                      F.datediff("rental_date", "_date").cast("long").alias("gap_days"))


def payment_ltv_rows(roles: Roles) -> DataFrame:
    """K8: every payment with its customer's LTV and payment count.

    Same result as ``SUM(amount) OVER (PARTITION BY customer_id)`` (NULL is a
    customer like any other), computed as a per-customer aggregate joined back.
    The totals are written first, so both sides of the join are plain shuffles
    and AQE's skew join can split a customer with a huge share of the payments.
    """
    p = roles.payment
    per = derived(roles, "customer_payment_totals", lambda: p.groupBy(
        F.col("customer_id").alias("_customer")).agg(
        F.sum("amount").alias("customer_ltv"),
        F.count(F.lit(1)).alias("customer_payments")))
    return p.join(per, F.col("customer_id").eqNullSafe(F.col("_customer"))).select(
        "payment_id", "customer_id",
        money_out("amount").alias("amount"),
        money_out("customer_ltv").alias("customer_ltv"),
        "customer_payments")


def rental_frequency_rows(roles: Roles) -> DataFrame:
    """K8: every rental with its customer's rental count."""
    r = roles.rental
    per = derived(roles, "customer_rental_counts", lambda: r.groupBy(
        F.col("customer_id").alias("_customer")).agg(
        F.count("rental_id").alias("customer_rentals")))
    return r.join(per, F.col("customer_id").eqNullSafe(F.col("_customer"))).select(
        "rental_id", "customer_id", "customer_rentals")


def concentration(roles: Roles, top_share: float = 0.2, bottom_share: float = 0.4,
                  top_categories: int = 3) -> DataFrame:
    """K11 (one row): revenue share of the top categories, LTV share of the
    top and bottom fractions of customers, and best-to-median LTV ratio.

    Customer order is LTV descending, customer id ascending; the top fraction
    is the first ceil(top_share * N) customers, the bottom fraction the last
    ceil(bottom_share * N).  Positions come from the distributed rank over a
    unique key, so no task holds all customers.
    """
    from .revenue import _title_sales  # category revenue, shared plan shape
    m = customer_metrics_dec(roles)
    n_all = m.agg(F.count(F.lit(1)).alias("_n_cust"), F.sum("ltv").alias("_ltv_all"),
                  F.max("ltv").alias("_max_ltv"))
    # Unique sort key: LTV cents * 2^31 is too wide, so rank by (ltv, -id) as
    # a struct; rank_desc on a struct orders field by field.
    keyed = m.withColumn("_key", F.struct(F.col("ltv"), (-F.col("customer_id")).alias("nid")))
    pos = rank_desc(keyed, "_key", "_pos")
    pos = attach_one_row(pos, n_all)
    k_top = F.ceil(F.col("_n_cust") * F.lit(top_share))
    k_bot = F.ceil(F.col("_n_cust") * F.lit(bottom_share))
    shares = pos.agg(
        F.sum(F.when(F.col("_pos") <= k_top, F.col("ltv"))).alias("_top"),
        F.sum(F.when(F.col("_pos") > F.col("_n_cust") - k_bot, F.col("ltv"))).alias("_bot"),
        F.first("_ltv_all").alias("_ltv_all"), F.first("_max_ltv").alias("_max_ltv"))
    med = segment_cuts(roles).select(F.col("median_ltv").alias("_med"))
    cat = _title_sales(roles).groupBy("category").agg(F.sum("revenue").alias("rev"))
    cat = small_rank_desc(cat, "rev", "_r")
    cat_tot = cat.agg(
        F.sum(F.when(F.col("_r") <= top_categories, F.col("rev"))).alias("_topcat"),
        F.sum("rev").alias("_allcat"))
    one = shares.crossJoin(med).crossJoin(cat_tot)  # three one-row frames
    return one.select(
        pct("_topcat", "_allcat").cast("double").alias("top_category_share_pct"),
        pct("_top", "_ltv_all").cast("double").alias("top_customer_share_pct"),
        pct(F.coalesce(F.col("_bot"), F.lit(0)), "_ltv_all").cast("double")
        .alias("bottom_customer_share_pct"),
        F.round(dec("_max_ltv") / F.nullif(dec("_med", 30, 3), F.lit(0)), 2)
        .cast("double").alias("top_to_median_ltv"))
