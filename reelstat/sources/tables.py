"""Raw table access: one Parquet dataset per table name under a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The table names the test data directory provides.
TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


# The columns and types that the reports rely on, by table.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, time) of the files of a dataset, in order, asked of the file
    system that ``path`` names; none if there is no such path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    files, found = system.listFiles(folder, True), []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return sorted(found)


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it has the declared columns with their types; types that have
    drifted would otherwise pass silently through the decimal casts.  Further
    columns are left alone, so that audits see them."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(
        TABLE_SCHEMAS[name]).fields if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"table {name} must have the columns {', '.join(wrong)}")
    return df


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Lazy Parquet scan; projections and filters applied later reach the scan."""
    df = spark.read.parquet(table_path(base, name))
    return check_schema(df, name) if name in TABLE_SCHEMAS else df


def read_tables(spark: SparkSession, base: str, names=TEST_TABLES) -> dict[str, DataFrame]:
    return {n: read_table(spark, base, n) for n in names}
