"""Exact grouped quantiles against brute force."""

import random
from decimal import Decimal as D
from fractions import Fraction

import pytest

from reelstat.functions.quantiles import approx_quantiles, grouped_quantiles
from reelstat.functions.ranking import median

ASKED = {"a": "0", "b": "0.1", "c": "0.5", "d": "0.375", "e": "0.99", "f": "1"}


def brute(values, p):
    v = sorted(values)
    at = Fraction(p) * (len(v) - 1)
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low) if len(v) > 1 else v[0]


def data():
    pick = random.Random(3)
    out = [("hot", pick.randint(-10 ** 6, 10 ** 6)) for _ in range(900)]
    out += [("ties", 7)] * 300 + [("ties", 8)] * 301
    out += [(None, pick.randint(0, 30)) for _ in range(200)] + [("one", -5), ("none", None)]
    out += [("far", x) for x in (-10 ** 15, 0, 1, 2, 10 ** 15)] + [("hot", None)]
    return out


@pytest.mark.parametrize("few,bins", [(10 ** 6, 1024), (0, 1024), (0, 2), (100, 16)])
def test_equals_brute_force(spark, few, bins):
    rows = data()
    df = spark.createDataFrame([(g, None if v is None else D(v) / 10000) for g, v in rows],
                               "g string, v decimal(22,4)").repartition(5)
    got = {r.g: r for r in grouped_quantiles(df, ["g"], "v", ASKED, few, bins).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g, _ in rows}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, r in got.items():
        assert r.n == len(groups[g])
        for name, p in ASKED.items():
            assert Fraction(r[name]) == Fraction(brute(groups[g], p)) / 10000, (g, name)


def test_two_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 4), (1, "x", 9), (1, None, 2), (2, "x", 5)],
                               "n_ long, _v string, name long")
    got = sorted((r.n_, str(r._v), r.n, r.q) for r in
                 grouped_quantiles(df, ["n_", "_v"], "name", {"q": "0.25"}).collect())
    assert got == [(1, "None", 1, D("2.00")), (1, "x", 2, D("5.25")), (2, "x", 1, D("5.00"))]


def test_median_keeps_the_scale(spark):
    df = spark.createDataFrame([(D("1.0049"),), (D("2.0049"),)], "v decimal(10,4)")
    for few in (0, 10):
        assert median(df, "v", "m", few=few).first()["m"] == D("1.5049")
    empty = median(df.where("v is null"), "v", "m")
    assert [r["m"] for r in empty.collect()] == [None]
    assert median(spark.range(4), "id").first()[0] == D("1.5")


def test_doubles_are_refused_and_approximate(spark):
    df = spark.range(1001).selectExpr("id % 2 as g", "cast(id as double) as v")
    with pytest.raises(TypeError, match="approx_quantiles"):
        grouped_quantiles(df, ["g"], "v", {"m": "0.5"})
    got = {r.g: (r.n, r.m) for r in approx_quantiles(df, ["g"], "v", {"m": "0.5"}).collect()}
    assert got == {0: (501, 500.0), 1: (500, 499.0)}
    for wrong in ("1.5", "-0.1", "0.1234567"):
        with pytest.raises(ValueError):
            grouped_quantiles(spark.range(3), [], "id", {"m": wrong})
