"""Audits answered by Parquet footers."""

import glob
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException

from reelstat import reports
from reelstat.operators import quality
from reelstat.sources import footers
from reelstat.sources.tables import TEST_TABLES

SMALL = "/root/testdata/sf0.001"


def blanked(src, dst):
    """A copy of a Parquet file with everything but its footer overwritten."""
    raw = bytearray(open(src, "rb").read())
    keep = struct.unpack("<I", raw[-8:-4])[0] + 8
    raw[4:-keep] = b"\0" * (len(raw) - keep - 4)
    open(dst, "wb").write(raw)


def test_only_footers_are_read(spark, tmp_path):
    for t in TEST_TABLES:
        blanked(f"{SMALL}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    with pytest.raises(Exception):
        spark.read.parquet(f"{tmp_path}/orders.parquet").selectExpr("sum(o_totalprice)").first()
    counts = dict(map(tuple, quality.row_counts(spark, str(tmp_path), TEST_TABLES).collect()))
    assert counts == {t: pq.read_metadata(f"{SMALL}/{t}.parquet").num_rows for t in TEST_TABLES}
    flat = [t for t in TEST_TABLES if t != "embeddings"]
    got = sorted(map(tuple, quality.raw_null_profile(spark, str(tmp_path), flat).collect()))
    want = sorted(r for r in map(tuple, reports.run(spark, "q_null_profile_raw", SMALL).collect())
                  if not r[0].startswith("embeddings"))
    assert got == want
    got = sorted(map(tuple, quality.key_ranges(spark, str(tmp_path), TEST_TABLES).collect()))
    assert got == sorted(map(tuple, reports.run(spark, "q_key_ranges", SMALL).collect()))


def test_plans_push_the_aggregate(spark):
    df = footers.footer_table(spark, f"{SMALL}/orders.parquet").selectExpr(
        "count(1)", "count(o_orderstatus)", "min(o_orderkey)")
    plan = df._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(o_orderstatus), MIN(o_orderkey)]" in plan
    # the caller's own session is left alone
    assert "PushedAggregation" not in spark.read.parquet(
        f"{SMALL}/orders.parquet").selectExpr("count(1)")._jdf.queryExecution().toString()


def table(path, statistics=True, rows=((1, None), (5, "x"), (None, "y"))):
    data = pa.table({"k": pa.array([r[0] for r in rows], pa.int64()),
                     "a b`c.d": pa.array([r[1] for r in rows], pa.string()),
                     "l": pa.array([None if r[0] is None else [None] for r in rows],
                                   pa.list_(pa.int64()))})
    pq.write_table(data, path, write_statistics=statistics)


@pytest.mark.parametrize("statistics", [True, False])
def test_odd_names_nested_columns_and_missing_statistics(spark, tmp_path, statistics):
    (tmp_path / "t.parquet").mkdir()
    table(f"{tmp_path}/t.parquet/a.parquet")
    table(f"{tmp_path}/t.parquet/b.parquet", statistics, rows=[(7, None), (-2, None)])
    assert footers.row_count(spark, str(tmp_path), "t") == 5
    assert footers.null_counts(spark, str(tmp_path), "t") == (5, {"k": 1, "a b`c.d": 3, "l": 1})
    assert footers.ranges(spark, str(tmp_path), "t") == {"k": (-2, 7)}


def test_empty_and_missing_tables(spark, tmp_path):
    table(f"{tmp_path}/t.parquet", rows=())
    assert footers.null_counts(spark, str(tmp_path), "t") == (0, {"k": 0, "a b`c.d": 0, "l": 0})
    assert footers.ranges(spark, str(tmp_path), "t") == {"k": (None, None)}
    with pytest.raises(PySparkException):
        footers.row_count(spark, str(tmp_path), "nothing")
    assert not glob.glob(f"{tmp_path}/nothing*")
