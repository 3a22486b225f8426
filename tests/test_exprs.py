"""Expression helpers: NULL-safe division, half-up rounding, lateness days."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from reelstat.functions.exprs import elapsed_days, floor_zero, mean, pct, ratio


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "a long, b long")
    got = [r[0] for r in df.select(ratio("a", "b", 2)).collect()]
    assert got[0] is None and float(got[1]) == 0.33


def test_half_up_on_decimals(spark):
    df = spark.createDataFrame([(1005, 1000)], "a long, b long")
    # 100.5 % exactly -> 100.5 ; ratio 1.005 -> 1.01 (a double would give 1.0)
    r = df.select(ratio("a", "b", 2).alias("r"), pct("a", "b", 1).alias("p")).first()
    assert float(r["r"]) == 1.01 and float(r["p"]) == 100.5


def test_mean_rounds_through_declared_scale(spark):
    # AVG of 2-decimal money: 5.99 / 2 = 2.995 -> 3.00 (half up)
    df = spark.createDataFrame([("5.99", 2)], "s string, n long")
    assert float(df.select(mean(F.col("s").cast("decimal(22,2)"), "n", 2, 2)).first()[0]) == 3.0
    # AVG of integers goes through 4 decimals: 2.24995 -> 2.2500 -> 2.3 at 1 decimal
    df2 = spark.createDataFrame([(44999, 20000)], "s long, n long")
    assert float(df2.select(mean("s", "n", 0, 1)).first()[0]) == 2.3


def test_greatest_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-3,), (4,)], "x int")
    assert [r[0] for r in df.select(floor_zero("x")).collect()] == [None, 0, 4]


def test_calendar_vs_elapsed_days(spark):
    df = spark.createDataFrame([(dt(2024, 1, 1, 23, 59), dt(2024, 1, 3, 0, 1)),
                                (dt(2024, 1, 3, 12, 0), dt(2024, 1, 2, 0, 0))],
                               "s timestamp_ntz, e timestamp_ntz")
    got = df.select(elapsed_days("s", "e", "calendar").alias("c"),
                    elapsed_days("s", "e", "elapsed").alias("x")).collect()
    assert (got[0]["c"], got[0]["x"]) == (2, 1)
    assert (got[1]["c"], got[1]["x"]) == (-1, -1)   # -36 h truncates toward zero
