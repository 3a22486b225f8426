"""Published views kept up to date: only new files are read.

``refresh`` brings the eight views of ``plans.views`` up to date with role tables
that grow by files.  What the views need of the facts adds up, so every refresh
reads the rental and payment files that appeared since the last one, sums them
to *partial states* (per title, customer, staff member, month, days over; sets
of customers and of rented copies) and writes these beside the states of the
batches before.  The views are then built from the states, by the same
functions as from the facts, which nobody reads again.

Rentals and their payments may come in different batches.  Payments whose rental
is not known yet wait in ``pending``.  Payments of a rental of an earlier batch
are looked up in ``rental_index`` (the columns of a rental that states need), and
``paid_months`` tells which (rental, month) pairs count already; both are read
only when a batch holds such payments.

Nothing is changed in place.  States and views are written to folders of the new
version, and a manifest that names them is put there last, by one rename: readers
see the old version or the new one, whole.  A refresh that fails leaves no
manifest, and the next one does its work again.

Defined results: files of rentals and payments may be added; if one has gone or
changed, or if any dimension changed, the states are built anew from all files.
An update of a rental (its return) is such a change of a file.  Keys are assumed
unique, as by every report.  One refresh of a target at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bitmaps
from ..functions.exprs import month_start
from ..operators.customers import customer_sums, metrics_of
from ..operators.lateness import late_counts
from ..operators.revenue import titles_of
from ..operators.trends import with_customers
from ..session import stored
from ..sources.roles import conform, roles_from_parquet
from ..sources.schemas import ROLE_NAMES
from ..sources.tables import data_files
from .views import VIEWS
from .visits import CASH, SALE, staff_customers, with_customer_counts

FACTS = ("rental", "payment")


# --- manifests ----------------------------------------------------------------

def _system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, target: str) -> dict | None:
    """The newest manifest: version, batches, files, dimensions."""
    folder, system = _system(spark, f"{target}/manifests")
    if not system.exists(folder):
        return None
    names = sorted(str(f.getPath()) for f in system.listStatus(folder)
                   if f.getPath().getName().endswith(".json"))
    if not names:
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(names[-1], wholetext=True).collect()))


def _publish(spark: SparkSession, target: str, manifest: dict) -> None:
    name = f"{target}/manifests/{manifest['version']:08d}"
    path, system = _system(spark, name + ".tmp")
    out = system.create(path, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    final, _ = _system(spark, name + ".json")
    if system.exists(final) or not system.rename(path, final):
        raise OSError(f"{name}.json is there already: another refresh was faster")


def read_view(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A view as the newest version has it."""
    manifest = latest(spark, target)
    if manifest is None:
        raise FileNotFoundError(f"no views below {target}")
    return spark.read.parquet(f"{target}/views/{manifest['version']}/{name}")


# --- partial states of a batch --------------------------------------------------

@dataclass
class _States:
    """Folders of the states, one for each batch."""
    spark: SparkSession
    target: str
    batches: list[int]

    def write(self, batch: int, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.target}/states/{batch}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame | None:
        paths = [f"{self.target}/states/{b}/{name}" for b in self.batches]
        return self.spark.read.parquet(*paths) if paths else None


def _slips(payments: DataFrame) -> DataFrame:
    return payments.where(F.col("rental_id").isNotNull()).groupBy(
        "rental_id", month_start("payment_date").alias("month")).agg(
        F.sum("amount").alias("paid"), F.count(F.lit(1)).alias("n_pay"))


def _merged_slips(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("rental_id", "month").agg(
        F.sum("paid").alias("paid"), F.sum("n_pay").alias("n_pay"))


def _batch(states: _States, number: int, rental: DataFrame, payment: DataFrame, dims) -> None:
    """Write the partial states of the new ``rental`` and ``payment`` rows."""
    spark, write = states.spark, lambda name, df: states.write(number, name, df)
    index = write("rental_index", rental.select(
        "rental_id", "copy_id", "customer_id", "staff_id", "rental_date"))
    slips = stored(_slips(payment), "slips")
    pending = spark.read.parquet(f"{states.target}/states/{states.batches[-1]}/pending") \
        if states.batches else slips.limit(0)

    # payments of this batch whose rental is not in it, and what counts already of
    # the rentals that had payments before
    strangers = stored(slips.join(index.select("rental_id"), "rental_id", "left_anti"), "strangers")
    before = stored(strangers.select("rental_id").unionByName(
        slips.join(pending, "rental_id", "left_semi").select("rental_id")).distinct(), "before")
    late, waiting = strangers.join(index, "rental_id").limit(0), strangers
    known = slips.select("rental_id", "month").limit(0)
    if states.batches and not before.isEmpty():
        late = stored(strangers.join(states.read("rental_index"), "rental_id"), "late")
        known = stored(states.read("paid_months").join(before, "rental_id", "left_semi"), "known")
        waiting = strangers.join(late.select("rental_id"), "rental_id", "left_anti")

    # what counts for the first time: months by (rental, month), rentals by id
    seen = known.select("rental_id", F.col("month").alias("_m")).distinct()
    fresh = write("paid_months", slips.select("rental_id", "month").join(
        seen.withColumnRenamed("rental_id", "_r"),
        (F.col("rental_id") == F.col("_r")) & F.col("month").eqNullSafe(F.col("_m")), "left_anti"))
    write("months", slips.groupBy("month").agg(
        F.sum("n_pay").alias("payments"), F.sum("paid").alias("revenue")).join(
        fresh.groupBy(F.col("month").alias("_month")).agg(F.count(F.lit(1)).alias("rentals")),
        F.col("month").eqNullSafe(F.col("_month")), "left").select(
        "month", "payments", F.coalesce("rentals", F.lit(0)).alias("rentals"), "revenue"))

    # new rentals with all their payments so far; earlier ones with the new payments
    mine = _merged_slips(slips, pending).join(index, "rental_id")
    first = F.row_number().over(Window.partitionBy("rental_id").orderBy("month")) == 1
    again = known.select("rental_id").distinct().withColumn("_again", F.lit(True))
    sales = mine.withColumn("once", first.cast("long"))
    if not late.isEmpty():
        sales = sales.unionByName(
            late.join(again, "rental_id", "left").withColumn(
                "once", (first & F.col("_again").isNull()).cast("long")).drop("_again"))
    sales = stored(sales, "sales")
    write("pending", _merged_slips(
        waiting, pending.join(index.select("rental_id"), "rental_id", "left_anti")))

    def by_key(df: DataFrame, by: str) -> DataFrame:
        return df.groupBy(by).agg(F.sum("once").alias("rentals"), F.sum("paid").alias("revenue"),
                                  F.sum("n_pay").alias("n_pay"))

    write("titles", by_key(sales.join(dims.copy.select("copy_id", "title_id"), "copy_id"), "title_id"))
    write("staff", by_key(sales, "staff_id"))
    write("customers", customer_sums(sales))
    returned = rental.where(F.col("return_date").isNotNull()).join(
        dims.copy.join(dims.title, "title_id"), "copy_id")
    write("late", late_counts(returned))
    write("copies", rental.select("copy_id").distinct())
    _customer_sets(states, number, sales, payment)


def _customer_sets(states: _States, number: int, sales: DataFrame, payment: DataFrame) -> None:
    """Sets of this batch; customers keep the number that they first got."""
    sale = sales.select(F.lit(SALE).alias("kind"), month_start("rental_date").alias("month"),
                        "staff_id", "customer_id")
    cash = payment.where(F.col("rental_id").isNotNull()).select(
        F.lit(CASH).alias("kind"), month_start("payment_date").alias("month"),
        F.lit(None).cast("long").alias("staff_id"), "customer_id")
    who = stored(sale.unionByName(cash).where(F.col("customer_id").isNotNull()).distinct(), "who")
    old = states.read("customer_numbers")
    new, start = who.select("customer_id"), 0
    if old is not None:
        new = new.join(old, "customer_id", "left_anti")
        start = old.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    numbers = states.write(number, "customer_numbers", bitmaps.numbered(new, "customer_id").select(
        "customer_id", (F.col("number") + start).alias("number")))
    every = numbers if old is None else old.unionByName(numbers)
    states.write(number, "customer_sets", bitmaps.sets(
        who.join(every, "customer_id"), ["kind", "month", "staff_id"]))


# --- views from states ----------------------------------------------------------

class StateRoles:
    """Roles whose facts are gone: the dimensions, and the tables that reports
    keep beside the facts, merged from the states."""

    def __init__(self, dims, states: _States):
        self._dims, self._states, self.spark = dims, states, states.spark
        self._tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in FACTS or name not in ROLE_NAMES:
            raise AttributeError(f"{name} is not kept: views are built from states")
        return getattr(self._dims, name)

    def _summed(self, name: str, by: list[str], *adds: str) -> DataFrame:
        return self._states.read(name).groupBy(*by).agg(*[F.sum(a).alias(a) for a in adds])

    def _sets(self, kind: str) -> DataFrame:
        return self._states.read("customer_sets").where(F.col("kind") == kind)

    def _kept(self, name: str) -> DataFrame | None:
        sums = ("rentals", "revenue", "n_pay")
        staff = self._dims.staff.select("staff_id", "store_id")
        if name == "title_sales":
            return titles_of(self._summed("titles", ["title_id"], *sums), self)
        if name == "customer_metrics_active":
            per = self._states.read("customers").groupBy("customer_id").agg(
                F.sum("ltv").alias("ltv"), F.sum("rentals").alias("rentals"),
                F.min("first_rental").alias("first_rental"),
                F.max("last_rental").alias("last_rental"))
            return metrics_of(per.where("rentals > 0"), self)
        if name == "month_sales":
            return with_customers(
                self._summed("months", ["month"], "payments", "rentals", "revenue"),
                bitmaps.sizes(self._sets(CASH), ["month"], "customers"))
        if name == "staff_sales":
            return with_customer_counts(
                self._summed("staff", ["staff_id"], *sums),
                staff_customers(self._sets(SALE)), "staff_id")
        if name == "store_sales":
            return with_customer_counts(
                self._states.read("staff").join(staff, "staff_id").groupBy("store_id").agg(
                    *[F.sum(a).alias(a) for a in sums]),
                bitmaps.sizes(self._sets(SALE).join(staff, "staff_id"), ["store_id"], "customers"),
                "store_id")
        if name == "late_base_calendar":
            return self._summed("late", ["title_id", "rental_rate", "rental_duration", "over"],
                                "n", "n_ids")
        if name == "rented_copies":
            return self._states.read("copies").distinct()
        return None

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            kept = self._kept(name.removeprefix("derived/"))
            self._tables[name] = stored(build() if kept is None else kept, name.replace("/", "-"))
        return self._tables[name]


# --- refresh ----------------------------------------------------------------------

def refresh(spark: SparkSession, base: str, target: str) -> dict:
    """Bring the views below ``target`` up to date with the role tables below
    ``base`` (a Parquet dataset for each role); returns the manifest."""
    base, target = base.rstrip("/"), target.rstrip("/")
    now = {r: [list(f) for f in data_files(spark, f"{base}/{r}")] for r in ROLE_NAMES}
    dimensions = {r: f for r, f in now.items() if r not in FACTS}
    old = latest(spark, target)
    whole = old is None or old["dimensions"] != dimensions or any(
        f not in now[r] for r in FACTS for f in old["files"][r])
    seen = {r: [] if whole else old["files"][r] for r in FACTS}
    new = {r: [f[0] for f in now[r] if f not in seen[r]] for r in FACTS}
    if not whole and not any(new.values()):
        return old
    version = old["version"] + 1 if old else 1
    dims = roles_from_parquet(spark, base, without=FACTS)
    states = _States(spark, target, [] if whole else old["batches"])

    def fresh(role: str) -> DataFrame:
        if not new[role]:
            return getattr(dims, role)  # empty
        return conform(spark.read.parquet(*new[role]), role)

    _batch(states, version, fresh("rental"), fresh("payment"), dims)
    states.batches = [*states.batches, version]
    roles = StateRoles(dims, states)
    for name, build in VIEWS.items():
        build(roles).write.mode("overwrite").parquet(f"{target}/views/{version}/{name}")
    manifest = {"version": version, "batches": states.batches, "files": {r: now[r] for r in FACTS},
                "dimensions": dimensions}
    _publish(spark, target, manifest)
    return manifest
