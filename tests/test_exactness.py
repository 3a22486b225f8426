"""Figures that rounding, NULL groups or plan details must not change."""

import dataclasses
from datetime import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelstat import reports
from reelstat.functions.ranking import median, rank_desc
from reelstat.operators import customers, lateness, quality, roadmap, stores, trends
from reelstat.plans import views
from reelstat.session import build_session, checkpoint_dir
from reelstat.sources.curated import CuratedRoles
from reelstat.sources.roles import conform
from reelstat.sources.tables import read_table
from tests.fixtures import _df

SMALL = "/root/testdata/sf0.001"


def with_tables(spark, roles, **rows):
    return dataclasses.replace(roles, **{r: _df(spark, r, rows[r]) for r in rows})


def test_ticket_change_uses_all_four_decimals(spark, roles):
    pays = [(i, 1, 1, i, D(a), dt(2024, m, 3)) for i, (a, m) in enumerate(
        [("4.20", 1), ("4.21", 2), ("4.22", 2)])]
    got = trends.ticket_trend(with_tables(spark, roles, payment=pays)).orderBy("month").collect()
    assert [(r.avg_ticket, r.delta_pct) for r in got] == [(4.2, None), (4.215, 0.36)]


def late_roles(spark, roles):
    """5 late days of a Drama title and 1 of an Action title, each at 0.99 / 7."""
    def rental(i, copy, late):
        return (i, dt(2024, 1, 1), copy, 1, dt(2024, 1, 8 + late), 1)
    return with_tables(
        spark, roles,
        title=[(1, "A", D("0.99"), 7, 100, D("1.00"), "G"), (2, "B", D("0.99"), 7, 90, D("1.00"), "G")],
        title_category=[(1, 1), (2, 2)], copy=[(11, 1, 1), (21, 2, 1)],
        rental=[rental(1, 21, 2), rental(2, 21, 3), rental(3, 11, 1)])


def test_fee_loss_is_divided_before_it_is_rounded(spark, roles):
    r = late_roles(spark, roles)
    two = dataclasses.replace(r, rental=r.rental.where("rental_id < 3"))
    assert lateness.fee_loss_total(two).first().loss_per_late_rental == 0.35
    shares = {x.category: x.share_pct for x in lateness.fee_loss_view(r).collect()}
    assert sorted(shares.values()) == [16.67, 83.33]


def test_null_groups_and_values_are_ranked(spark):
    df = spark.createDataFrame([(None, 5), (None, 7), (None, None), ("a", 7), ("a", 7)],
                               "g string, v int")
    got = sorted((str(r.g), str(r.v), r.rk) for r in rank_desc(df, "v", "rk", ["g"]).collect())
    assert got == [("None", "5", 2), ("None", "7", 1), ("None", "None", 3),
                   ("a", "7", 1), ("a", "7", 1)]


def test_null_month_and_null_customer_stay(spark, roles):
    pays = [(1, None, 1, 1, D("4.00"), None), (2, 1, 1, 3, D("5.00"), dt(2024, 2, 1)),
            (3, None, 1, None, D("1.50"), dt(2024, 2, 1))]
    r = with_tables(spark, roles, payment=pays)
    months = {x.month for x in stores.staff_by_month(r).collect()}
    assert months == {None, "2024-02-01"}
    totals = {x.payment_id: (x.customer_ltv, x.customer_payments)
              for x in customers.payment_ltv_rows(r).collect()}
    assert totals == {1: (5.5, 2), 2: (5.0, 1), 3: (5.5, 2)}
    rentals = [(1, dt(2024, 1, 1), 11, None, None, 1), (2, dt(2024, 1, 1), 11, 1, None, 1)]
    rows = customers.rental_frequency_rows(with_tables(spark, roles, rental=rentals)).collect()
    assert {x.rental_id: x.customer_rentals for x in rows} == {1: 1, 2: 1}


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_do_not_depend_on_reused_exchanges(spark, reuse):
    old = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        n = 1_000_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), (F.col("id") % 3).alias("g"))
        assert rank_desc(df, "v", "rk").where(F.col("rk") != n - F.col("v")).count() == 0
        part = df.where("v < 30000")
        want = part.withColumn("w", F.rank().over(Window.partitionBy("g").orderBy(F.desc("v"))))
        both = rank_desc(want, "v", "rk", ["g"])
        assert both.where("rk <> w").count() == 0
        assert median(df.withColumn("v", F.col("v").cast("decimal(12,2)")), "v").first()[0] == D("499999.5")
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_missing_input_is_an_error(spark, roles):
    with pytest.raises(ValueError, match="return_date"):
        conform(roles.rental.drop("return_date"), "rental")
    assert conform(roles.store.select("store_id"), "store").columns[-1] == "address_id"
    with pytest.raises(KeyError, match="strangers"):
        quality.raw_duplicate_keys({"strangers": roles.store})


def test_drifted_types_are_an_error(spark, tmp_path):
    good = read_table(spark, SMALL, "region")
    good.withColumn("more", F.lit(1)).write.parquet(f"{tmp_path}/a/region.parquet")
    assert "more" in read_table(spark, f"{tmp_path}/a", "region").columns
    good.withColumn("r_regionkey", F.col("r_regionkey").cast("string")) \
        .write.parquet(f"{tmp_path}/b/region.parquet")
    with pytest.raises(TypeError, match="r_regionkey"):
        read_table(spark, f"{tmp_path}/b", "region")


def test_a_cluster_needs_a_shared_folder():
    class Context:
        applicationId, master = "app-none", "yarn"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_roles_are_built_when_asked_for(spark):
    roles = CuratedRoles(spark, lambda r: reports.role_from_test_tables(
        spark, SMALL, r, roles.table), "lazytest", buckets=4)
    quality.active_split(roles).collect()
    assert set(roles._tables) == {"customer"}
    named, every = roles.named_payments, roles.payment
    assert named.where("rental_id is null").count() == 0
    assert every.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert set(roles._tables) == {"customer", "rental_lines", "payment_named", "payment_unnamed"}


def test_a_running_session_keeps_its_settings(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert build_session().conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_views_leave_a_users_own_alone(spark, roles):
    spark.range(1).createOrReplaceTempView("v_fee_loss")
    views.publish_views(spark, roles)
    assert spark.table("v_fee_loss").columns == ["id"]
    assert views.list_published(spark) == sorted(views.VIEWS)


def test_cohorts_prices_and_calendar_change(spark, roles):
    rentals = [(i, dt(2024, m, 2), 11, c, None, 1) for i, (c, m) in enumerate(
        [(1, 1), (2, 1), (1, 2), (3, 2), (1, 4), (None, 1)])]
    got = roadmap.cohort_retention(with_tables(spark, roles, rental=rentals)).collect()
    assert sorted((r.cohort, r.months_since, r.customers, r.cohort_size, r.retention_pct)
                  for r in got) == [("2024-01-01", 0, 2, 2, 100.0), ("2024-01-01", 1, 1, 2, 50.0),
                                    ("2024-01-01", 3, 1, 2, 50.0), ("2024-02-01", 0, 1, 1, 100.0)]
    pays = [(i, 1, 1, i, D("2.00"), dt(2024, m, 3)) for i, m in enumerate([1, 2, 4])]
    paid = with_tables(spark, roles, payment=pays)
    by_row = [r.delta for r in trends.monthly_revenue(paid).orderBy("month").collect()]
    by_month = [r.delta for r in trends.monthly_revenue(paid, calendar=True).orderBy("month").collect()]
    assert by_row == [None, 0.0, 0.0] and by_month == [None, 0.0, None]
