"""The registered queries: names, SQL parity, and the pipeline's stages."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from reelstat.llm import queries
from reelstat.llm.common import documents, written
from tools.check_oracle import compare

SMALL = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert names == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert compare(got, con.execute(queries.SQL[name]).df()) == "OK"


def test_pipeline_keeps_columns_and_packs_what_is_left(spark):
    docs = documents(spark, SMALL)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before
        before = after
    assert docs.select("text").distinct().count() == before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == before
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "simhash_dedup", "packing"]
