"""Revenue split over a many-to-many bridge, to the cent."""

import dataclasses
import random
from collections import defaultdict
from datetime import datetime as dt
from decimal import Decimal as D

import pytest

from reelstat.operators import attribution
from tests.fixtures import _df


def cast_roles(spark, roles, pairs):
    names = [(i, f"F{i}", f"L{i}") for i in sorted({a for _, a in pairs if a})]
    return dataclasses.replace(roles, actor=_df(spark, "actor", names),
                               title_actor=_df(spark, "title_actor", pairs))


def test_hand_fixture(spark, roles):
    # t1 'Alpha': actors 7, 8, 9 (listed out of order, one twice); t3: actor 8; t4: nobody.
    # r1 (t1): 4.99 and 1.00; r3 (t3): 2.99; r4 (t4): 2.99; r5 (t1): 4.99; p5 has no
    # rental (5.00) and p6 an unknown one (3.00).
    got = {r.actor_id: r for r in attribution.revenue_by_actor(cast_roles(
        spark, roles, [(1, 9), (1, 7), (1, 8), (1, 8), (3, 8), (2, 7), (None, 7), (1, None)])).collect()}
    # 4.99 in three: 1.67 1.66 1.66, 1.00 in three: 0.34 0.33 0.33
    assert {k: (r.titles, r.payments, r.full_credit, r.split_revenue, r.revenue_rank)
            for k, r in got.items()} == {
        7: (1, 3, 10.98, 3.68, 2), 8: (2, 4, 13.97, 6.64, 1), 9: (1, 3, 10.98, 3.65, 3),
        None: (1, 3, 10.99, 10.99, None)}
    assert got[8].actor_name == "F8 L8" and got[None].actor_name is None
    assert round(sum(r.split_revenue for r in got.values()), 2) == 24.96  # all payments
    assert got[7].share_pct == 14.74


def test_split_equals_plain_largest_remainder(spark, roles):
    pick = random.Random(9)
    # title 1 holds a third of the bridge, actor 1 is in every title
    pairs = [(1, a) for a in range(1, 60)] + [(t, 1) for t in range(2, 30)] \
        + [(pick.randrange(2, 30), pick.randrange(2, 90)) for _ in range(60)]
    pays = [(i, pick.choice([1] * 15 + list(range(1, 35))), D(pick.randint(-300, 2000)) / 100)
            for i in range(400)]
    amounts = spark.createDataFrame([(t, a, 1) for _, t, a in pays],
                                    "title_id long, amount decimal(12,2), n long") \
        .groupBy("title_id", "amount").sum("n").withColumnRenamed("sum(n)", "n")
    bridge = spark.createDataFrame(pairs, "title_id long, actor_id long").repartition(4)
    got = {r.actor_id: (r.groups, r.payments, int(r.full_cents), int(r.split_cents)) for r in
           attribution.attribute(amounts, bridge, "title_id", "actor_id").collect()}
    cast = defaultdict(set)
    for t, a in pairs:
        cast[t].add(a)
    want = defaultdict(lambda: [set(), 0, 0, 0])
    for _, t, a in pays:
        c, actors = int(a * 100), sorted(cast[t])
        for place, actor in enumerate(actors or [None]):
            row, n = want[actor], max(len(actors), 1)
            row[0].add(t)
            row[1] += 1
            row[2] += c
            row[3] += c // n + (place < c % n)
    assert got == {k: (len(v[0]), *v[1:]) for k, v in want.items()}
    assert sum(v[3] for v in got.values()) == sum(int(a * 100) for *_, a in pays)


@pytest.mark.parametrize("pairs", [[], [(77, 5)]])
def test_without_a_cast_everything_is_one_row(spark, roles, pairs):
    got = attribution.revenue_by_actor(cast_roles(spark, roles, pairs)).collect()
    assert [(r.actor_id, r.payments, r.full_credit, r.split_revenue, r.share_pct)
            for r in got] == [(None, 7, 24.96, 24.96, 100.0)]


def test_nulls(spark, roles):
    pays = [(1, 1, 2, 1, None, dt(2024, 1, 1)), (2, 1, 2, 1, D("-0.05"), None)]
    r = dataclasses.replace(cast_roles(spark, roles, [(1, 7), (1, 8)]),
                            payment=_df(spark, "payment", pays))
    got = {x.actor_id: (x.payments, x.split_revenue) for x in
           attribution.revenue_by_actor(r).collect()}
    assert got == {7: (2, -0.02), 8: (2, -0.03)}
