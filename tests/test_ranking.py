"""Distributed rank / median / top-n against brute force on random data."""

import random
import statistics
from decimal import Decimal

from pyspark.sql import functions as F

from reelstat.functions.ranking import median, rank_desc, top_n


def _brute_rank(vals):
    # RANK() OVER (ORDER BY v DESC NULLS LAST)
    def key(v):
        return (v is None, -(v or 0))
    return [1 + sum(1 for w in vals if key(w) < key(v)) for v in vals]


def test_rank_desc_matches_brute_force(spark):
    rnd = random.Random(7)
    vals = [rnd.choice([None] + list(range(40))) for _ in range(500)]
    vals += [17] * 200                          # one hot value: a third of the rows
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v long")
    got = {r["id"]: r["rk"] for r in rank_desc(df, "v", "rk", buckets=5).collect()}
    want = _brute_rank(vals)
    assert [got[i] for i in range(len(vals))] == want


def test_rank_desc_partitioned(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice("abc"), rnd.randint(0, 20)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, g string, v long")
    got = {r["id"]: r["rk"] for r in rank_desc(df, "v", "rk", ["g"], buckets=4).collect()}
    for i, g, v in data:
        assert got[i] == 1 + sum(1 for _, g2, v2 in data if g2 == g and v2 > v)


def test_median_exact_even_and_odd(spark):
    rnd = random.Random(11)
    for n in (1, 2, 7, 10, 101):
        vals = [Decimal(rnd.randint(0, 5000)) / 100 for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals], "v decimal(22,2)")
        got = median(df, "v", "m", buckets=3).first()["m"]
        assert Decimal(got) == Decimal(statistics.median(vals))


def test_top_n_tiebreak(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1)], "id long, v long")
    assert [r["id"] for r in top_n(df, "v", 2, ["id"]).collect()] == [2, 3]
    assert top_n(df, "v", 2, ["id"]).select(F.count(F.lit(1))).first()[0] == 2
