"""What a report stores, shuffles and how many parts its shuffles have, so that a
task's share and the bytes moved grow no faster than the input."""

import pytest
from pyspark.sql import functions as F

from reelstat import reports, session
from reelstat.functions import bitmaps
from reelstat.operators import quality
from reelstat.plans import cube, visits
from reelstat.sources.curated import CuratedRoles

SMALL = "/root/testdata/sf0.001"


def curated(spark, tag):
    made = CuratedRoles(spark, lambda r: reports.role_from_test_tables(
        spark, SMALL, r, made.table), tag, buckets=4)
    return made


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unfitted(spark):
    spark.conf.unset(session.INITIAL_CONF)
    yield spark
    spark.conf.unset(session.INITIAL_CONF)


def test_shuffles_get_parts_by_the_size_of_the_input(unfitted):
    before = session.partitions(unfitted)
    session.fit_partitions(unfitted, 1)
    assert session.partitions(unfitted) == before
    session.fit_partitions(unfitted, 1000 * session.PARTITION_BYTES)
    assert session.partitions(unfitted) == 1000
    session.fit_partitions(unfitted, 1)  # a small input after a large one
    assert session.partitions(unfitted) == 1000
    session.fit_partitions(unfitted, 10 ** 15)
    assert session.partitions(unfitted) == session.MOST_PARTITIONS


def test_a_given_number_of_parts_stays(unfitted):
    unfitted.conf.set(session.INITIAL_CONF, "77")
    session.fit_partitions(unfitted, 10 ** 12)
    assert unfitted.conf.get(session.INITIAL_CONF) == "77"


def test_rentals_and_payments_are_written_once_and_meet_without_a_shuffle(spark):
    r = curated(spark, "largeonce")
    joined = r.rental.join(r.named_payments.groupBy("rental_id").agg(F.sum("amount").alias("s")),
                           "rental_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(r.seconds) == {"rental_lines"}
    named = r.named_payments.count()
    assert joined.count() == named < r.payment.count() == r.rental.count()


def test_long_rentals_are_counted_without_numbering_or_storing(spark):
    r = curated(spark, "largelong")
    out = reports.ROLE_REPORTS["q_long_rentals"](r)
    assert "Window" not in plan(out) and not r._tables
    stored = quality.duration_outliers(r.rental, "rental_date", "return_date")
    assert out.collect() == stored.collect() and r.seconds


def test_lateness_rows_are_made_without_storing(spark):
    r = curated(spark, "largelate")
    out = reports.ROLE_REPORTS["q_lateness_rows"](r)
    assert not r._tables and not r.seconds
    got = sorted(out.collect())
    assert not r._tables
    # the same from stored tables
    assert r.rental.count() == len(got) and r.copy.count() and set(r.seconds) == {
        "rental_lines", "copy"}
    assert sorted(reports.ROLE_REPORTS["q_lateness_rows"](r).collect()) == got


def test_months_of_payments_need_no_visits(spark):
    r = curated(spark, "largemonths")
    got = {x.month: x.customers for x in visits.month_customers(r).collect()}
    want = r.named_payments.groupBy(F.date_trunc("month", "payment_date").alias("m")).agg(
        F.countDistinct("customer_id").alias("n")).collect()
    assert {str(k)[:7]: v for k, v in got.items()} == {str(x.m)[:7]: x.n for x in want}
    assert "derived/visits" not in r._tables and "derived/customer_sets" not in r._tables


def test_duplicate_keys_are_counted_after_the_shuffle(spark):
    rows = [(1, 1), (1, 1), (1, None), (None, 2), (None, None), (2, 1)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(3)
    got = {x.check_name: x.duplicates for x in quality.duplicate_keys(
        {"one": (df, "a"), "two": (df, ("a", "b")), "none": (df.limit(0), "a")}).collect()}
    assert got == {"one.a": 4, "two.a+b": 4, "none.a": 0}
    # the first aggregate of the keys stands above their shuffle
    text = plan(quality.duplicate_keys({"one": (df, "a")}))
    assert text.rindex("HashAggregate(keys=[a") < text.index("hashpartitioning(a")


def test_sets_are_listed_after_one_shuffle(spark):
    seen = []
    df = spark.createDataFrame([(g, i % 9) for g in "ab" for i in range(20)], "g string, number long")
    old, bitmaps.stored = bitmaps.stored, lambda d, name: seen.append(plan(d)) or old(d, name)
    try:
        parts = bitmaps.sets(df, ["g"])
    finally:
        bitmaps.stored = old
    assert seen[0].count("Exchange") == 1
    got = parts.groupBy("g").agg(F.sum("size").alias("n")).collect()
    assert {(x.g, x.n) for x in got} == {("a", 9), ("b", 9)}


def test_sales_and_visits_are_not_shuffled_before_they_are_written(roles):
    for build in (cube._sale_facts, visits.visits):
        last = build(roles)._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
        assert "Aggregate" not in last
    revenue = dict(cube.title_totals(roles).dtypes)["revenue"]
    assert revenue == "decimal(38,2)"


def test_payments_do_not_ask_for_the_number_of_a_copy(spark, tmp_path):
    for t in ("lineitem", "orders", "supplier"):
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        if t == "supplier":
            df = df.withColumn("s_nationkey", F.lit(None).cast("int"))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    r = CuratedRoles(spark, lambda role: reports.role_from_test_tables(
        spark, str(tmp_path), role, r.table), "largenation", buckets=4)
    assert r.payment.count() == r.rental.count() > 0
    with pytest.raises(Exception, match="nation key"):
        r.rental.select("copy_id").collect()
