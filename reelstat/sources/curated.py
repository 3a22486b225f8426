"""Curated role layer: derive each role once, write it as a table, reuse it.

Reports read the roles many times.  Deriving them from raw tables on every
report repeats the lineitem window and the fact joins, so a role is written on
its first use into this application's part of the shared folder named by
``spark.checkpoint.dir`` (never a machine-local folder on a cluster) and read
back from there.  A role that no report asks for is never derived.  Writing
also cuts the lineage: a lost executor recomputes from the curated files.

What several roles are made from is written once, bucketed and sorted by the key
that the adapter names.  ``rental`` and the payments that name a rental are
projections of such a table, with its key as ``rental_id``, so their join and the
per-rental payment aggregate need no shuffle, and a report reads only the
columns it uses.  Payments without a rental are a projection of their own: as one
bucket they would all be one task's work.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import partitions, scratch_path
from .roles import Roles
from .schemas import ROLE_NAMES
from .tables import data_files, table_path

#: What the adapter derives by projection from what it keeps; not written again.
PROJECTED = ("rental", "payment_named", "payment_unnamed")
MATERIALIZE_CONF = "reelstat.materializeRoles"
BUCKETS_CONF = "reelstat.roleBuckets"

_cache: dict[tuple, CuratedRoles] = {}


def _fingerprint(spark: SparkSession, base: str, names) -> str:
    """Identity of the input: path plus size and time of every file, asked of
    the file system that the path names."""
    h = hashlib.sha1(base.encode())
    for n in names:
        h.update(repr(data_files(spark, table_path(base, n))).encode())
    return h.hexdigest()[:16]


class CuratedRoles:
    """Roles that are written when first read (attributes as those of Roles)."""

    def __init__(self, spark: SparkSession, derive: Callable[[str], DataFrame], tag: str,
                 buckets: int | None = None):
        self.spark, self._derive, self._tag = spark, derive, tag
        self.curated_at = scratch_path(spark, "roles", tag)
        self._buckets = buckets or int(spark.conf.get(BUCKETS_CONF, None)
                                       or partitions(spark))
        self._storing = True
        self._tables: dict[str, DataFrame] = {}
        self.seconds: dict[str, float] = {}  # that each table took to write

    def _plain(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.curated_at}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _bucketed(self, name: str, df: DataFrame, key: str) -> DataFrame:
        app = "".join(c if c.isalnum() else "_" for c in self.spark.sparkContext.applicationId)
        table = f"reelstat_{name}_{app}_{self._tag}"
        # Hash-partition by the bucket key first: every write task then
        # holds exactly one bucket and writes one file.
        (df.repartition(self._buckets, key)
           .write.mode("overwrite").option("path", f"{self.curated_at}/{name}")
           .bucketBy(self._buckets, key).sortBy(key).saveAsTable(table))
        return self.spark.table(table)

    def table(self, name: str, build: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
        if name not in self._tables:
            if not self._storing:
                return build()
            began, inner = time.perf_counter(), sum(self.seconds.values())
            self._tables[name] = (self._bucketed(name, build(), key) if key
                                  else self._plain(name, build()))
            # less what the tables took that this one was the first to need
            inner = sum(self.seconds.values()) - inner
            self.seconds[name] = time.perf_counter() - began - inner
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ROLE_NAMES:
            raise AttributeError(name)
        if name == "payment":
            return self.named_payments.unionByName(self._projected("payment_unnamed"))
        if name in PROJECTED:
            return self._projected(name)
        return self.table(name, lambda: self._derive(name))

    def _projected(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._derive(name)
        return self._tables[name]

    @property
    def named_payments(self) -> DataFrame:
        return self._projected("payment_named")

    def unstored(self, role: str) -> DataFrame:
        """The role from what is written already, else derived in the plan of the
        report itself."""
        self._storing = False
        try:
            return self._derive(role)
        finally:
            self._storing = True

    def as_dict(self) -> dict[str, DataFrame]:
        return {r: getattr(self, r) for r in ROLE_NAMES}


def derived(roles, name: str, build) -> DataFrame:
    """A table derived from curated roles, written once next to them.

    Reports that reuse one intermediate several times in a plan (the
    per-customer metrics feed medians, ranks and totals) read it from a
    written table instead of recomputing it per branch.  Roles that keep tables
    have a ``table`` method; lazy ones (hand fixtures, ``materializeRoles=false``)
    just get ``build()``.
    """
    if not isinstance(roles, Roles):
        return roles.table(f"derived/{name}", build)
    return build()


def for_one_pass(roles, role: str) -> DataFrame:
    """A role for a report that reads it once and uses few of its columns, so that
    Spark drops the others (and the steps that only they need) instead of writing
    them."""
    return getattr(roles, role) if isinstance(roles, Roles) else roles.unstored(role)


def curated_roles(spark: SparkSession, base: str, names, derive) -> Roles | CuratedRoles:
    """Roles for ``base``; ``derive(spark, base, role, keep)`` gives one of them
    or of ``PROJECTED``, with ``keep(name, build, key)`` for what several roles
    share (bucketed by ``key``).  Unless
    ``reelstat.materializeRoles`` is false each is written once per application
    and input fingerprint."""
    if spark.conf.get(MATERIALIZE_CONF, "true").lower() != "true":
        return Roles(**{r: derive(spark, base, r, lambda _, build, key=None: build())
                        for r in ROLE_NAMES})
    tag = _fingerprint(spark, base, names)
    key = (spark.sparkContext.applicationId, tag)
    if key not in _cache:
        roles = CuratedRoles(
            spark, lambda r: derive(spark, base, r, roles.table), tag)
        _cache[key] = roles
    return _cache[key]
