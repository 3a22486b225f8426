import pytest
from pyspark.sql import functions as F

from reelstat.llm import exact_dedup, positions, simhash
from tests.llm.helpers import empty, frame, rows

#: Every name that the operators give to columns of their own.
CLASHING = ["__text_sha256", "__keep_id", "__keep_rows", "__row", "__key", "__removed", "file", "row",
            "bits", "block", "_metadata", "mark_file", "mark_block", "mark_bits", "_meta_file",
            "_meta_row", "fp", "text_sha256", "last", "n", "root", "first", "a b`c.d"]


def clashing(spark, data=None):
    df = frame(spark, data, extra=False)
    return df.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c)
                            for c in CLASHING])


def values(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("stage", [exact_dedup.deduplicate, simhash.deduplicate])
def test_columns_of_any_name_pass_untouched(spark, tmp_path, stage, stored):
    df = clashing(spark)
    if stored:
        df.write.parquet(f"{tmp_path}/docs")
        df = spark.read.parquet(f"{tmp_path}/docs")
    out = stage(df)
    assert out.columns == df.columns
    kept = values(out)
    assert set(kept) <= set(values(df)) and 0 < len(kept) < len(rows())
    assert len({r.doc_id for r in out.collect()}) == len(kept)


@pytest.mark.parametrize("blocks", [2, 1000])
def test_chosen_rows_of_many_files(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(positions, "BLOCK", 4096)  # several blocks a file
    spark.range(40_000).withColumn("t", F.concat(F.lit("t"), "id")).repartition(5) \
        .write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert positions.located(docs) is docs
    for pick in ("id % 7 = 0", "id = 5", "false", "true"):
        marks = positions.with_place(docs, F.col("id")).filter(pick)
        for keep in (True, False):
            want = docs.filter(pick if keep else f"not ({pick})")
            got = positions.chosen(docs, marks, keep, blocks=blocks)
            assert got.columns == ["id", "t"]
            assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    some = positions.chosen(docs, positions.with_place(docs).filter("row = 3"), True,
                            [F.col("id").alias("x")], blocks)
    assert some.columns == ["x", "file", "row"] and some.count() == 5
    assert {r.row for r in some.collect()} == {3}


def test_texts_are_not_shuffled(spark, tmp_path):
    frame(spark, rows() * 30).write.parquet(f"{tmp_path}/docs")
    for stage in (exact_dedup.deduplicate, simhash.deduplicate):
        plan = stage(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution() \
            .executedPlan().toString()
        for line in plan.splitlines():
            if "Exchange" in line:
                assert "Broadcast" in line, line


def test_tables_without_places_are_copied(spark, tmp_path):
    docs = frame(spark)
    copy = positions.located(docs)
    assert copy is not docs and values(copy) == values(docs)
    docs.write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    twice = read.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    again = positions.located(twice)
    assert again is not twice and again.count() == 2 * len(rows())
    assert positions.located(read.filter("doc_id > 3")).count() == read.filter("doc_id > 3").count()
    assert positions.located(empty(spark)).count() == 0


def test_fresh_names():
    assert positions.fresh(["A", "b", "b_"], "a", "b", "c", "c") == ["a_", "b__", "c", "c_"]
