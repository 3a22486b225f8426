"""Running totals and previous rows at row grain, against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelstat.functions.ordered import BUCKET, bucketed_by_range, previous_row, running_sum
from reelstat.operators import customers


def data(spark):
    """One customer holds a third of the rows and several buckets, NULL is one too."""
    pick = random.Random(6)
    who = [5] * 700 + [None] * 300 + [pick.randrange(60) for _ in range(1000)] + [999]
    rows = [(i, c, pick.choice([None, *range(40)]), pick.choice([None, *range(-5, 9)]))
            for i, c in enumerate(who)]
    return spark.createDataFrame(rows, "id long, who long, at int, v int").repartition(6)


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_running_sum_equals_a_plain_window(spark, buckets):
    df = data(spark)
    w = Window.partitionBy("who").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    got = running_sum(df, ["who"], ["at", "id"], {"s": F.col("v"), "n": F.lit(1).cast("long")},
                      buckets)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_previous_row_equals_a_plain_window(spark, buckets):
    df = data(spark)
    w = Window.partitionBy("who").orderBy("at", "id")
    want = df.select("*", F.lag("id").over(w).alias("p"), F.lag("v").over(w).alias("pv"))
    got = previous_row(df, ["who"], ["at", "id"], {"p": "id", "pv": "v"}, buckets)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_customer_is_spread_over_buckets(spark):
    df = spark.range(40_000).select(F.lit(1).alias("who"), F.col("id"))
    ranged = bucketed_by_range(df, ["who"], ["id"], 16)
    sizes = [r["count"] for r in ranged.groupBy(BUCKET).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 40_000 / 16
    out = running_sum(df, ["who"], ["id"], {"n": F.lit(1).cast("long")}, 16)
    assert out.where("n <> id + 1").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "id long, who long, at int, v int")
    assert running_sum(df, ["who"], ["at"], {"s": F.col("v")}).count() == 0
    assert previous_row(df, ["who"], ["at"], {"p": "id"}).count() == 0


def test_hand_fixture(roles):
    got = {r.payment_id: (r.payment_no, r.running_ltv) for r in customers.running_ltv(roles).collect()}
    # u1: p1 4.99, p2 1.00, p6 3.00; u2: p3 2.99, p5 5.00, p7 4.99; u3: p4
    assert got == {1: (1, 4.99), 2: (2, 5.99), 6: (3, 8.99), 3: (1, 2.99), 5: (2, 7.99),
                   7: (3, 12.98), 4: (1, 2.99)}
    gaps = {r.rental_id: (r.previous_rental_id, r.gap_days)
            for r in customers.rental_gaps(roles).collect()}
    # u1: r1 10 Jan, r2 20 Jan; u2: r3 1 Feb, r5 1 Mar 2024; u3: r4
    assert gaps == {1: (None, None), 2: (1, 10), 3: (None, None), 5: (3, 29), 4: (None, None)}
    q = {r.store_id: (r.customers, r.p50, r.p90) for r in
         customers.ltv_quantiles_by_store(roles).collect()}
    assert q == {1: (1, 5.99, 5.99), 2: (1, 7.98, 7.98)}  # u3 is inactive, u4 has no rentals
    assert {r.store_id: r.p50 for r in customers.ltv_quantiles_by_store(roles, True).collect()} == {
        1: 5.99, 2: 7.98}
