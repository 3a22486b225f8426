"""Views refreshed from new files alone equal views built from everything."""

import os

import pytest
from pyspark.sql import functions as F

from reelstat import reports
from reelstat.plans import incremental
from reelstat.plans.views import VIEWS
from reelstat.sources.roles import roles_from_parquet
from tests.fixtures import hand_roles

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


def same_as_full(spark, base, target):
    full = roles_from_parquet(spark, base)
    for name, build in VIEWS.items():
        assert rows_of(incremental.read_view(spark, target, name)) == rows_of(build(full)), name


def part(df, column, number, of=2):
    return df.where(F.pmod(F.xxhash64(F.lit(column), F.col(column)), F.lit(of)) == number)


def spoil(folder):
    """Overwrite all data files, leaving their sizes and times."""
    for name in os.listdir(folder):
        if name.startswith("part-"):
            path = f"{folder}/{name}"
            at = os.stat(path)
            open(path, "r+b").write(b"\0" * at.st_size)
            os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))


def test_a_new_batch_alone_is_read_and_equals_a_full_build(spark, tmp_path):
    roles = reports.roles_for(spark, SMALL)
    base, target, copy = (f"{tmp_path}/{n}" for n in ("roles", "views", "copy"))
    # some rentals are paid twice, in other months, and half of the payments come
    # in another batch than their rentals
    facts = {"rental": (roles.rental, "rental_id"), "payment": (roles.payment.unionByName(
        roles.payment.where("payment_id % 5 = 0").withColumn(
            "payment_id", -F.col("payment_id")).withColumn(
            "payment_date", F.add_months("payment_date", 1).cast("timestamp_ntz"))), "payment_id")}
    for name, df in roles.as_dict().items():
        for folder in (base, copy):
            (part(*facts[name], 0) if name in facts else df).write.parquet(f"{folder}/{name}")
    made = incremental.refresh(spark, base, target)
    assert (made["version"], made["batches"]) == (1, [1])
    for name in facts:
        spoil(f"{base}/{name}")  # whoever reads an old file fails
        for folder in (base, copy):
            part(*facts[name], 1).write.mode("append").parquet(f"{folder}/{name}")
    with pytest.raises(Exception):
        spark.read.schema(roles.rental.schema).parquet(f"{base}/rental").agg(
            F.max("copy_id")).collect()
    made = incremental.refresh(spark, base, target)
    assert (made["version"], made["batches"]) == (2, [1, 2])
    full = roles_from_parquet(spark, copy)
    for name, build in VIEWS.items():
        assert rows_of(incremental.read_view(spark, target, name)) == rows_of(build(full)), name
    assert incremental.refresh(spark, base, target) == made  # nothing new


def test_changes_rebuild_and_failures_leave_the_old_version(spark, tmp_path, monkeypatch):
    base, target = f"{tmp_path}/roles", f"{tmp_path}/v"
    roles = hand_roles(spark)
    for name in set(VIEWS) - {"v_fee_loss", "v_category_revenue"}:
        monkeypatch.delitem(VIEWS, name)  # two views show it
    for name, df in roles.as_dict().items():
        df.coalesce(1).write.parquet(f"{base}/{name}")
    made = incremental.refresh(spark, base, target)
    kept = incremental.StateRoles(roles, incremental._States(spark, target, made["batches"]))
    with pytest.raises(AttributeError, match="not kept"):
        kept.rental
    # a dimension changes: everything is built anew
    roles.title.withColumn("rating", F.lit("X")).write.mode("overwrite").parquet(f"{base}/title")
    assert incremental.refresh(spark, base, target)["batches"] == [2]
    same_as_full(spark, base, target)
    # a rental is returned: its file is another one
    roles.rental.withColumn("return_date", F.coalesce(
        "return_date", F.col("rental_date") + F.expr("interval 40 days"))).write.mode(
        "overwrite").parquet(f"{base}/rental")
    before = {n: rows_of(incremental.read_view(spark, target, n)) for n in VIEWS}
    with monkeypatch.context() as broken:
        broken.setitem(VIEWS, "v_fee_loss", lambda r: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            incremental.refresh(spark, base, target)
    assert {n: rows_of(incremental.read_view(spark, target, n)) for n in VIEWS} == before
    assert incremental.refresh(spark, base, target)["version"] == 3


def test_no_version_yet(spark, tmp_path):
    assert incremental.latest(spark, str(tmp_path)) is None
    with pytest.raises(FileNotFoundError):
        incremental.read_view(spark, str(tmp_path), "v_fee_loss")


def test_every_order_of_arrival(spark, tmp_path):
    """Payments before, with and after their rentals."""
    roles = hand_roles(spark)
    base, target = f"{tmp_path}/roles", f"{tmp_path}/v"
    batches = [("payment_id in (1, 6, 7)", "rental_id in (3)"),
               ("payment_id in (2, 3)", "rental_id in (1, 2, 4)"), ("payment_id in (4, 5)", "rental_id = 5")]
    for name, df in roles.as_dict().items():
        if name not in incremental.FACTS:
            df.coalesce(1).write.parquet(f"{base}/{name}")
    for pays, rents in batches:
        for name, some in (("payment", pays), ("rental", rents)):
            getattr(roles, name).where(some).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        incremental.refresh(spark, base, target)
    same_as_full(spark, base, target)
