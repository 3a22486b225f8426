"""Sets that roll up, the sales cube, and what the reports read."""

import dataclasses
import random
from collections import defaultdict
from datetime import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from reelstat import reports
from reelstat.functions import bitmaps
from reelstat.operators import revenue, stores, trends
from reelstat.plans import cube, visits
from tests.fixtures import _df, rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("few", [0, 5, 10 ** 6])
def test_sets_and_their_unions_count_distinct(spark, monkeypatch, few):
    monkeypatch.setattr(bitmaps, "FEW", few)
    pick = random.Random(4)
    # ids far apart; group "a" holds half of the rows
    ids = sorted(pick.sample(range(-10 ** 12, 10 ** 12), 3000))
    data = [(pick.choice("aaabc"), pick.randint(0, 3), pick.choice(ids)) for _ in range(9000)]
    data += [("z", None, ids[0]), (None, 1, ids[0]), (None, 1, ids[1]), ("a", 0, None)]
    df = spark.createDataFrame(data, "g string, m int, id long").repartition(5)
    numbers = {r.id: r.number for r in bitmaps.numbered(df, "id", 7).collect()}
    used = sorted({i for _, _, i in data if i is not None})
    assert numbers == {i: n for n, i in enumerate(used)}
    # numbers spread over several buckets
    wide = df.join(bitmaps.numbered(df, "id"), "id").withColumn("number", F.col("number") * 100)
    parts = bitmaps.sets(wide, ["g", "m"])
    assert parts.where("few is null").isEmpty() == (few > 5)

    def distinct(*at):
        found = defaultdict(set)
        for row in data:
            if row[2] is not None:
                found[tuple(row[i] for i in at)].add(row[2])
        return {k: len(v) for k, v in found.items()}

    def got(frame, *keys):
        return {tuple(r[k] for k in keys): r["n"] for r in frame.collect()}

    assert got(parts.groupBy("g", "m").agg(F.sum("size").alias("n")), "g", "m") == distinct(0, 1)
    assert got(bitmaps.sizes(parts, ["g"], "n"), "g") == distinct(0)
    assert got(bitmaps.sizes(parts, ["m"], "n"), "m") == distinct(1)
    by_group = bitmaps.merged(parts, ["g"])
    assert got(bitmaps.sizes(by_group, [], "n")) == {(): len(used)}


def many(spark, roles):
    """The hand fixture with a rental paid in two months, a title in two
    categories, a rental of an unknown copy and one by unknown staff."""
    def table(role, *more):
        return getattr(roles, role).unionByName(_df(spark, role, list(more)))
    return dataclasses.replace(
        roles,
        title_category=table("title_category", (1, 2)),
        rental=table("rental", (6, dt(2024, 3, 2), 777, 2, None, 1), (7, dt(2024, 3, 3), 31, None, None, 99)),
        payment=table("payment", (8, 1, 2, 1, D("0.50"), dt(2024, 2, 2)),
                      (9, 2, 1, 6, D("7.00"), dt(2024, 3, 2)), (10, 2, 1, 7, D("8.00"), None)))


def test_cube_counts_each_sale_once(spark, roles):
    r = many(spark, roles)
    got = {(x["month"], x["category"]): (x["rentals"], x["revenue"])
           for x in rows(trends.category_by_month(r))}
    # r1 (t1, Action and Drama) is paid in January (5.99) and February (0.50)
    assert got == {("2024-01-01", "Action"): (1, 5.99), ("2024-01-01", "Drama"): (1, 5.99),
                   ("2024-02-01", "Action"): (2, 3.49), ("2024-02-01", "Drama"): (2, 3.49),
                   ("2024-03-01", "Action"): (1, 4.99), ("2024-03-01", "Drama"): (1, 4.99),
                   (None, "Action"): (1, 8.0)}
    got = {(x["store_id"], x["category"]): (x["rentals"], x["revenue"])
           for x in rows(stores.store_category(r))}
    assert got == {(1, "Action"): (1, 2.99), (2, "Action"): (2, 11.48), (2, "Drama"): (3, 14.47)}
    got = {x["rental_rate"]: (x["titles"], x["rentals"], x["revenue"])
           for x in rows(revenue.revenue_by_price_tier(r))}
    assert got == {4.99: (1, 2, 11.48), 2.99: (2, 3, 13.98)}
    got = {(x["store_id"], x["rental_rate"]): x["rentals"] for x in rows(stores.price_mix_by_store(r))}
    assert got == {(1, 2.99): 1, (2, 4.99): 2, (2, 2.99): 1}
    got = {x["weekday_no"]: x["rentals"] for x in rows(trends.weekday_profile(r))}
    # payments by weekday of the rental, sales of unknown copies and staff included
    assert got == {4: 3, 5: 1, 2: 1, 6: 1, 7: 1, 1: 1}


def test_customers_without_an_id_are_nobody(spark, roles):
    got = {x["store_id"]: (x["rentals"], x["customers"]) for x in
           rows(stores.store_performance(many(spark, roles)))}
    assert got == {1: (2, 1), 2: (3, 3)}
    got = {x["staff_id"]: x["customers"] for x in rows(stores.staff_performance(many(spark, roles)))}
    assert got == {1: 1, 2: 3}


def test_reports_read_the_stored_tables(spark):
    r = reports.roles_for(spark, SMALL)
    for name in ("q_category_by_month", "q_store_category", "q_revenue_by_price_tier",
                 "q_weekday_profile", "q_price_mix_by_store", "q_store_performance",
                 "q_store_scorecard", "q_v_store_scorecard", "q_staff_performance",
                 "q_v_staff_performance", "q_monthly_revenue"):
        files = reports.run(spark, name, SMALL).inputFiles()
        assert files and not any("/payment" in f or "/rental/" in f for f in files
                                 if "scorecard" not in name), name
        assert not any("/payment" in f for f in files), name
    assert set(r._tables) >= {f"derived/{t}" for t in (
        "sale_facts", "sales_cube", "visits", "customer_sets", "store_sales", "staff_sales",
        "month_sales")}


def test_the_facts_meet_the_copies_once(roles):
    plan = cube._sale_facts(roles)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3  # payments to rentals, copies, staff
    sets = visits.customer_sets(roles, visits.SALE)
    assert sets.columns == ["kind", "month", "staff_id", "bucket", "size", "few", "bits"]
