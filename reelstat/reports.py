"""Registry of the named reports: name -> function(Roles) -> DataFrame.

``roles_for(spark, base)`` derives the roles from a directory of test tables;
a deployment with real role tables would call ``roles_from_parquet``
instead and reuse the same report functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import attribution, customers, kpis, lateness, quality, revenue, roadmap, stores, trends
from .plans import views
from .session import fit_partitions
from .sources.curated import curated_roles, for_one_pass
from .sources.fixture import role_from_test_tables
from .sources.roles import Roles
from .sources.tables import TEST_TABLES, data_files, read_table, read_tables, table_path

RoleReport = Callable[[Roles], DataFrame]

ROLE_REPORTS: dict[str, RoleReport] = {
    # A -- data-quality audit
    "q_null_profile": quality.null_profile_report,
    "q_orphan_rental_payment": lambda r: quality.orphans(
        r.rental, r.payment, "rental_id", "rentals without payment"),
    "q_orphan_payment_rental": lambda r: quality.orphans(
        r.payment, r.rental, "rental_id", "payments without rental", ignore_null_key=True),
    "q_orphan_copy_title": lambda r: quality.orphans(
        r.copy, r.title, "title_id", "copies without title"),
    "q_orphan_title_category": lambda r: quality.orphans(
        r.title, r.title_category, "title_id", "titles without category"),
    "q_inactive_customer_rentals": quality.inactive_customer_rentals,
    "q_rentals_by_month": quality.rentals_by_month,
    "q_payments_by_year": quality.payments_by_year,
    "q_return_before_rental": lambda r: quality.order_violations(
        r.rental, "rental_id", "rental_date", "return_date"),
    "q_long_rentals": lambda r: quality.duration_outliers(
        for_one_pass(r, "rental"), "rental_date", "return_date"),
    "q_duplicate_keys": quality.duplicate_keys_report,
    "q_active_split": quality.active_split,
    "q_copies_store_category": quality.copies_store_category,
    "q_quality_scorecard": quality.quality_scorecard,
    # B -- revenue and catalogue
    "q_revenue_by_category": revenue.revenue_by_category,
    "q_top_titles": revenue.top_titles,
    "q_titles_with_idle_copies": revenue.titles_with_idle_copies,
    "q_unrented_titles": revenue.unrented_titles,
    "q_unrented_store_titles": lambda r: revenue.unrented_titles(r, per_store=True),
    "q_top3_titles_per_category": revenue.top_titles_per_category,
    "q_revenue_by_price_tier": revenue.revenue_by_price_tier,
    # C -- customer value and lateness
    "q_customer_metrics": customers.customer_metrics,
    "q_top_customers": customers.top_customers,
    "q_segment_summary": customers.segment_summary,
    "q_customer_lateness": lateness.customer_lateness,
    "q_segment_lateness": lateness.segment_lateness,
    "q_late_bands": lateness.late_bands,
    "q_fee_loss_total": lateness.fee_loss_total,
    "q_fee_loss_by_category": lateness.fee_loss_by_category,
    # D -- time
    "q_monthly_revenue": trends.monthly_revenue,
    "q_daily_anomalies": trends.rental_daily_anomalies,
    "q_weekday_profile": trends.weekday_profile,
    "q_category_by_month": trends.category_by_month,
    "q_ticket_trend": trends.ticket_trend,
    # E -- stores, stock, staff
    "q_store_performance": stores.store_performance,
    "q_store_category": stores.store_category,
    "q_stock_utilisation": stores.stock_utilisation,
    "q_idle_stock": stores.idle_stock,
    "q_store_scorecard": stores.store_scorecard,
    "q_staff_performance": stores.staff_performance,
    "q_staff_by_month": stores.staff_by_month,
    # P -- cohorts, price, length
    "q_cohort_retention": roadmap.cohort_retention,
    "q_price_elasticity": roadmap.price_elasticity,
    "q_length_lateness": roadmap.length_lateness,
    "q_revenue_by_actor": attribution.revenue_by_actor,
    "q_monthly_revenue_calendar": lambda r: trends.monthly_revenue(r, calendar=True).select(
        "month", "revenue", "delta", "growth_pct"),
    # V -- published views
    "q_v_category_revenue": views.VIEWS["v_category_revenue"],
    "q_v_title_ranking": views.VIEWS["v_title_ranking"],
    "q_v_customer_segments": views.VIEWS["v_customer_segments"],
    "q_v_monthly_trend": views.VIEWS["v_monthly_trend"],
    "q_v_store_scorecard": views.VIEWS["v_store_scorecard"],
    "q_v_stock_utilisation": views.VIEWS["v_stock_utilisation"],
    "q_v_staff_performance": views.VIEWS["v_staff_performance"],
    "q_v_fee_loss": views.VIEWS["v_fee_loss"],
    # K -- documented metrics
    "q_kpi": kpis.kpi_row,
    "q_lateness_rows": lateness.lateness_rows,
    "q_customer_window_totals": customers.payment_ltv_rows,
    "q_customer_rental_frequency": customers.rental_frequency_rows,
    "q_customer_running_ltv": customers.running_ltv,
    "q_rental_gaps": customers.rental_gaps,
    "q_ltv_quantiles_by_store": customers.ltv_quantiles_by_store,
    "q_revenue_per_copy": revenue.revenue_per_copy,
    "q_concentration": customers.concentration,
    "q_late_rate_gap": lateness.late_rate_gap,
    "q_idle_value_by_category": stores.idle_value_by_category,
    "q_price_mix_by_store": stores.price_mix_by_store,
}

# Reports that read raw tables or the catalogue: name -> function(spark, base).
TABLE_REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q_row_counts": lambda spark, base: quality.row_counts(spark, base, TEST_TABLES),
    "q_key_ranges": lambda spark, base: quality.key_ranges(spark, base, TEST_TABLES),
    "q_view_inventory": lambda spark, base: views.view_inventory(spark, roles_for(spark, base)),
    # audit operators applied to the raw tables themselves
    "q_null_profile_raw": lambda spark, base: quality.raw_null_profile(spark, base, TEST_TABLES),
    "q_duplicate_keys_raw": lambda spark, base: quality.raw_duplicate_keys(
        read_tables(spark, base)),
    "q_orders_by_month": lambda spark, base: quality.rows_by_month(
        read_table(spark, base, "orders"), "o_orderdate"),
    "q_event_daily_anomalies": lambda spark, base: trends.daily_anomalies(
        read_table(spark, base, "events"), "ts"),
    "q_ship_before_order": lambda spark, base: quality.order_violations(
        read_table(spark, base, "lineitem").join(
            read_table(spark, base, "orders").select("o_orderkey", "o_orderdate"),
            F.col("l_orderkey") == F.col("o_orderkey")),
        ["l_orderkey", "l_linenumber", "l_partkey"], "o_orderdate", "l_shipdate"),
}


# The tables whose size decides how many parts a shuffle has.
SIZED_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def fit(spark: SparkSession, base: str) -> None:
    """Shuffle partitions for the tables under ``base`` (see ``fit_partitions``)."""
    fit_partitions(spark, sum(size for t in SIZED_TABLES
                              for _, size, _ in data_files(spark, table_path(base, t))))


def roles_for(spark: SparkSession, base: str) -> Roles:
    """Roles of the test tables under ``base`` (each curated on first use)."""
    fit(spark, base)
    return curated_roles(spark, base, TEST_TABLES, role_from_test_tables)


# Documented row order of the reports whose size is bounded (months, stores,
# categories, top lists): name -> columns, "-" for descending.
ORDER: dict[str, tuple[str, ...]] = {
    "q_row_counts": ("-rows",),
    "q_rentals_by_month": ("month",),
    "q_payments_by_year": ("year",),
    "q_revenue_by_category": ("-revenue",),
    "q_top_titles": ("rank_all", "title_id"),
    "q_top3_titles_per_category": ("category", "category_rank"),
    "q_revenue_by_price_tier": ("rental_rate",),
    "q_top_customers": ("ltv_rank", "customer_id"),
    "q_segment_summary": ("-revenue",),
    "q_segment_lateness": ("-late_rate_pct",),
    "q_late_bands": ("band",),
    "q_fee_loss_by_category": ("-loss",),
    "q_monthly_revenue": ("month",),
    "q_monthly_revenue_calendar": ("month",),
    "q_weekday_profile": ("weekday_no",),
    "q_category_by_month": ("month", "rank_in_month"),
    "q_ticket_trend": ("month",),
    "q_store_performance": ("-revenue",),
    "q_store_category": ("store_id", "rank_in_store"),
    "q_stock_utilisation": ("store_id", "category"),
    "q_store_scorecard": ("store_id",),
    "q_cohort_retention": ("cohort", "months_since"),
    "q_price_elasticity": ("rental_rate",),
    "q_v_category_revenue": ("-revenue",),
    "q_v_monthly_trend": ("month",),
    "q_v_store_scorecard": ("store_id",),
    "q_v_fee_loss": ("loss_rank",),
    "q_ltv_quantiles_by_store": ("store_id",),
}
# Row-level reports are sorted only when asked: that is a full shuffle.
LONG_ORDER: dict[str, tuple[str, ...]] = {
    "q_revenue_by_actor": ("-split_revenue", "actor_id"),
    "q_customer_metrics": ("-ltv", "customer_id"),
    "q_v_customer_segments": ("ltv_rank", "customer_id"),
    "q_v_title_ranking": ("rank_all", "title_id"),
    "q_idle_stock": ("-immobilised", "store_id", "title"),
    "q_staff_performance": ("revenue_rank", "staff_id"),
    "q_staff_by_month": ("month", "rank_in_month", "staff_id"),
}


def run(spark: SparkSession, name: str, base: str, ordered: bool = False) -> DataFrame:
    """The report ``name`` over the tables under ``base``; ``ordered`` also
    sorts the row-level reports."""
    if name in TABLE_REPORTS:
        fit(spark, base)
        out = TABLE_REPORTS[name](spark, base)
    else:
        out = ROLE_REPORTS[name](roles_for(spark, base))
    order = ORDER.get(name) or (LONG_ORDER.get(name) if ordered else None)
    if not order:
        return out
    return out.orderBy(*[F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c)
                         for c in order])


def names() -> list[str]:
    return list(ROLE_REPORTS) + list(TABLE_REPORTS)
