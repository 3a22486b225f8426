"""Reports on the hand-built fixture; expected values derived by hand."""

from datetime import datetime as dt

from reelstat.operators import (customers, kpis, lateness, quality, revenue, stores,
                                trends)
from tests.fixtures import rows


def test_orphans_and_inactive(roles):
    r = roles
    assert quality.orphans(r.rental, r.payment, "rental_id", "x").first()["n"] == 1  # r2
    # p5 (NULL id) is not an orphan; p6 (dangling 999) is.
    assert quality.orphans(r.payment, r.rental, "rental_id", "x",
                           ignore_null_key=True).first()["n"] == 1
    assert quality.orphans(r.copy, r.title, "title_id", "x").first()["n"] == 0
    assert quality.inactive_customer_rentals(r).first()["n"] == 1  # r4 by u3


def test_duplicate_keys_count_null_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    out = quality.duplicate_keys({"t": (df, "k")}).first()
    assert out["duplicates"] == 2  # 4 rows - 2 distinct non-NULL keys


def test_active_split(roles):
    got = {r["active"]: (r["n"], r["pct"]) for r in quality.active_split(roles).collect()}
    assert got == {True: (3, 75.0), False: (1, 25.0)}


def test_null_profile(roles):
    got = {r["field"]: (r["nulls"], r["pct"])
           for r in quality.null_profile_report(roles).collect()}
    assert got["rental.return_date"] == (1, 20.0)
    assert got["payment.rental_id"] == (1, 14.29)   # 1/7
    assert got["customer.email"] == (1, 25.0)
    assert got["title.length"] == (1, 20.0)
    assert got["title.rating"] == (1, 20.0)


def test_revenue_by_category(roles):
    got = {r["category"]: r for r in revenue.revenue_by_category(roles).collect()}
    a, d = got["Action"], got["Drama"]
    # r1 has two payments but is one rental; t1 and t3 are Action titles.
    assert (a["rentals"], a["titles"], a["revenue"]) == (3, 2, 13.97)
    assert a["avg_ticket"] == 3.49            # 13.97 / 4 payments = 3.4925
    assert a["share_pct"] == 82.37 and d["share_pct"] == 17.63
    assert a["revenue_per_title"] == 6.99     # 6.985 rounds half up on decimals
    assert (a["revenue_rank"], d["revenue_rank"]) == (1, 2)


def test_top_titles_rank_ties(roles):
    got = {r["title_id"]: (r["rank_all"], r["rank_in_category"])
           for r in revenue.top_titles(roles, n=10).collect()}
    assert got == {1: (1, 1), 3: (2, 2), 4: (2, 1)}  # t3 and t4 tie at 2.99


def test_title_ranking_matches_top_titles(roles):
    full = {r["title_id"]: (r["rank_all"], r["rank_in_category"])
            for r in revenue.title_ranking(roles).collect()}
    assert full == {1: (1, 1), 3: (2, 2), 4: (2, 1)}


def test_top_per_category_merges_same_title_text(roles):
    got = rows(revenue.top_titles_per_category(roles), "category")
    assert [(r["category"], r["title"], r["rentals"], r["revenue"], r["category_rank"])
            for r in got] == [("Action", "Alpha", 3, 13.97, 1), ("Drama", "Gamma", 1, 2.99, 1)]


def test_idle_and_unrented_titles(roles):
    idle = {r["title_id"]: r["idle_copies"]
            for r in revenue.titles_with_idle_copies(roles).collect()}
    assert idle == {1: 1, 2: 1}               # c12 and c99; t5 has no copy
    assert revenue.unrented_titles(roles).count() == 0   # t2 has a rented copy
    per_store = [(r["store_id"], r["title_id"])
                 for r in revenue.unrented_titles(roles, per_store=True).collect()]
    assert per_store == [(3, 2)]


def test_customer_metrics_and_segments(roles):
    m = {r["customer_id"]: r for r in customers.customer_metrics(roles).collect()}
    assert set(m) == {1, 2}                   # u3 inactive, u4 no paid rental
    assert (m[1]["ltv"], m[1]["rentals"], m[1]["tenure_days"]) == (5.99, 1, 0)
    assert (m[2]["ltv"], m[2]["rentals"], m[2]["avg_ticket"]) == (7.98, 2, 3.99)
    assert m[2]["tenure_days"] == 29          # 2024-02-01 -> 2024-03-01
    seg = {r["segment"]: r for r in customers.segment_summary(roles).collect()}
    # medians: LTV 6.985, rentals 1.5
    assert set(seg) == {"Champions", "At Risk"}
    c = seg["Champions"]
    assert (c["customers"], c["pct_customers"], c["revenue"], c["pct_revenue"]) == \
        (1, 50.0, 7.98, 57.12)
    assert (c["avg_ltv"], c["avg_frequency"], c["avg_ticket"]) == (7.98, 2.0, 3.99)
    assert seg["At Risk"]["pct_revenue"] == 42.88


def test_median_ties_go_up(spark):
    from reelstat.operators.customers import segment_customers
    from decimal import Decimal
    five = Decimal("5.00")
    m = spark.createDataFrame([(1, five, 3), (2, five, 3), (3, five, 3)],
                              "customer_id long, ltv decimal(22,2), rentals long")
    segs = {r["segment"] for r in segment_customers(m).collect()}
    assert segs == {"Champions"}              # all equal: >= sends ties up


def test_customer_lateness(roles):
    got = {r["customer_id"]: r for r in lateness.customer_lateness(roles).collect()}
    assert (got[1]["returned"], got[1]["late"], got[1]["avg_late_days"],
            got[1]["max_late_days"]) == (1, 1, 2.0, 2)   # r2 open: excluded
    assert (got[2]["returned"], got[2]["late"], got[2]["avg_late_days"],
            got[2]["max_late_days"]) == (2, 1, 16.0, 16)
    # NULL duration: not late, no mean, no maximum (GREATEST with NULL is NULL)
    assert (got[3]["returned"], got[3]["late"], got[3]["avg_late_days"],
            got[3]["max_late_days"]) == (1, 0, None, None)


def test_late_bands_null_duration_falls_to_longest(roles):
    got = {r["band"]: (r["rentals"], r["pct"]) for r in lateness.late_bands(roles).collect()}
    assert got == {"00 - on time": (1, 25.0), "01-02 days late": (1, 25.0),
                   "15+ days late": (2, 50.0)}


def test_lateness_modes_differ_at_clock_boundary(roles):
    got = {r["rental_id"]: r for r in lateness.lateness_rows(roles).collect()}
    assert (got[1]["late_days_calendar"], got[1]["late_days_elapsed"]) == (2, 1)
    assert got[2]["late_flag_calendar"] is None and got[2]["late_days_calendar"] is None
    assert (got[3]["late_flag_calendar"], got[3]["late_days_calendar"]) == (0, 0)
    assert got[4]["late_days_calendar"] is None and got[4]["late_flag_calendar"] == 0


def test_fee_loss(roles):
    t = lateness.fee_loss_total(roles).first()
    # r1 (2 days) and r5 (16 days) at 4.99 / 3 = 1.663333 per day
    assert (t["late_rentals"], t["late_days"], t["avg_daily_rate"]) == (2, 18, 1.6633)
    assert (t["total_loss"], t["loss_per_late_rental"]) == (29.94, 14.97)
    cat = {r["category"]: r for r in lateness.fee_loss_view(roles).collect()}
    assert set(cat) == {"Action"} and cat["Action"]["share_pct"] == 100.0


def test_monthly_revenue(roles):
    got = rows(trends.monthly_revenue(roles), "month")
    assert [r["month"] for r in got] == ["2024-01-01", "2024-02-01", "2024-03-01"]
    jan, feb, mar = got
    assert (jan["payments"], jan["rentals"], jan["revenue"], jan["avg_ticket"]) == \
        (2, 1, 5.99, 3.0)                     # 2.995 rounds half up
    assert jan["delta"] is None and jan["growth_pct"] is None
    assert (feb["delta"], feb["growth_pct"], feb["customers"]) == (-0.01, -0.17, 2)
    # the dangling rental id 999 still counts here (payments only)
    assert (mar["rentals"], mar["revenue"], mar["growth_pct"], mar["cumulative"]) == \
        (2, 7.99, 33.61, 19.96)
    v4 = rows(trends.monthly_revenue(roles, month_as_text=False), "month")
    assert v4[0]["month"] == dt(2024, 1, 1)


def test_daily_anomalies_constant_volume(roles):
    got = trends.rental_daily_anomalies(roles).collect()
    assert {r["label"] for r in got} == {"Normal"}
    assert {r["z"] for r in got} == {None}   # sigma = 0


def test_daily_anomalies_population_sigma(spark):
    ts = [dt(2024, 1, 1)] + [dt(2024, 1, 2)] * 2 + [dt(2024, 1, 3)] * 4
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    got = {r["n"]: (r["label"], r["z"]) for r in trends.daily_anomalies(df, "ts", k=1).collect()}
    # mean 7/3, population sigma 1.2472 (sample sigma would give z = 1.09)
    assert got == {1: ("Trough", -1.07), 2: ("Normal", -0.27), 4: ("Peak", 1.34)}


def test_store_attribution_and_scorecard(roles):
    perf = {r["store_id"]: r for r in stores.store_performance(roles).collect()}
    assert (perf[1]["rentals"], perf[1]["revenue"], perf[1]["share_pct"]) == (1, 2.99, 17.63)
    assert (perf[2]["rentals"], perf[2]["customers"], perf[2]["revenue"]) == (3, 3, 13.97)
    assert perf[2]["revenue_per_customer"] == 4.66
    card = {r["store_id"]: r for r in stores.store_scorecard(roles).collect()}
    assert set(card) == {1, 2}                # store 3: stock only, dropped
    assert (card[1]["copies"], card[1]["moved"], card[1]["idle"],
            card[1]["utilisation_pct"]) == (3, 2, 1, 66.67)


def test_stock_utilisation_labels(roles):
    got = {(r["store_id"], r["category"]): (r["copies"], r["moved"], r["label"])
           for r in stores.stock_utilisation(roles).collect()}
    assert got == {(1, "Action"): (3, 2, "Moderate utilisation"),
                   (2, "Drama"): (2, 2, "High utilisation"),
                   (3, "Drama"): (1, 0, "Low utilisation")}


def test_utilisation_label_edges(spark):
    from pyspark.sql import functions as F
    from reelstat.operators.stores import UTIL_LABELS, _util_label
    df = spark.createDataFrame([(90, 100), (60, 100), (5999, 10000), (0, 3)],
                               "moved long, copies long")
    got = [r["l"] for r in df.select(_util_label(F.col("moved"), F.col("copies"),
                                                 UTIL_LABELS).alias("l")).collect()]
    assert got == ["High utilisation", "Moderate utilisation", "Low utilisation",
                   "Low utilisation"]


def test_idle_stock(roles):
    got = sorted((r["store_id"], r["title"], r["idle_copies"], r["immobilised"])
                 for r in stores.idle_stock(roles).collect())
    assert got == [(1, "Alpha", 1, 20.0), (3, "Beta", 1, 10.0)]


def test_staff_performance(roles):
    got = {r["staff_id"]: r for r in stores.staff_performance(roles).collect()}
    assert (got[2]["rentals"], got[2]["customers"], got[2]["revenue_rank"],
            got[2]["share_pct"]) == (3, 3, 1, 82.37)
    assert (got[1]["revenue"], got[1]["revenue_rank"]) == (2.99, 2)


def test_kpi_row(roles):
    k = kpis.kpi_row(roles).first()
    assert k["total_revenue"] == 24.96          # every payment, orphans included
    assert k["ticket_per_rental"] == 4.16       # 24.96 / 6 payments naming a rental
    assert k["rental_frequency"] == 1.67        # 5 rentals / 3 customers
    assert k["late_rate_pct"] == 50.0           # 2 late of 4 returned
    assert k["stock_utilisation_pct"] == 66.67  # 4 of 6 copies moved
    assert k["fee_loss"] == 29.94
