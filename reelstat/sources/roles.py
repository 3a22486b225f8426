"""The bundle of role DataFrames every operator reads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import OPTIONAL, OPTIONAL_ROLES, ROLE_SCHEMAS


@dataclass(frozen=True)
class Roles:
    rental: DataFrame
    payment: DataFrame
    copy: DataFrame
    title: DataFrame
    title_category: DataFrame
    category: DataFrame
    customer: DataFrame
    staff: DataFrame
    store: DataFrame
    actor: DataFrame | None = None
    title_actor: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.store.sparkSession

    @property
    def named_payments(self) -> DataFrame:
        """Payments that name a rental."""
        return self.payment.where(F.col("rental_id").isNotNull())

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)
                if getattr(self, f.name) is not None}


def conform(df: DataFrame, role: str) -> DataFrame:
    """Project ``df`` onto the role schema (column order and types).  A missing
    column is an error unless the role declares it optional."""
    schema = ROLE_SCHEMAS[role]
    missing = [f.name for f in schema.fields
               if f.name not in df.columns and f.name not in OPTIONAL.get(role, ())]
    if missing:
        raise ValueError(f"role {role} lacks the columns {missing}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def roles_from_parquet(spark: SparkSession, base: str, without: Sequence[str] = ()) -> Roles:
    """Roles stored one Parquet dataset per role name (``<base>/<role>``); those
    of ``without`` are empty, and their files not looked at."""
    base = base.rstrip("/")

    def there(role: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{role}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    return Roles(**{r: spark.createDataFrame([], ROLE_SCHEMAS[r]) if r in without
                    else conform(spark.read.parquet(f"{base}/{r}"), r)
                    for r in ROLE_SCHEMAS if r not in OPTIONAL_ROLES or there(r)})
