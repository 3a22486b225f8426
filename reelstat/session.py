"""Session construction and cluster-safe scratch locations.

Everything here is plain SparkSession configuration: AQE on (runtime
coalescing, skew-join splitting, broadcast demotion/promotion), UTC session
clock, UI off.  On a cluster the caller's session is used as-is; the helpers
only fill settings that are unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library wants.  They are defaults: an
# explicit value already present in the session wins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "reelstat",
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the library defaults.

    ``master`` is only for local runs and tests; on a cluster leave it None so
    the submitter's master is used.
    """
    asked = dict(extra or {})
    if shuffle_partitions:
        asked["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        asked["spark.driver.memory"] = driver_memory
    running = SparkSession.getActiveSession()
    if running is not None:
        # a session that runs already keeps what it was given
        given = {k for k, _ in running.sparkContext.getConf().getAll()}
        for k, v in {**DEFAULT_CONF, **asked}.items():
            if k in asked or (k not in given and running.conf.get(k, None) is None):
                if running.conf.isModifiable(k):
                    running.conf.set(k, v)
        return running
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **asked}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared
    folder there).  Only in local mode, where the driver is the only executor,
    a private scratch folder stands in for an unset value; on any other master
    an unset value is an error, because executors would not see each other's
    local files.
    """
    context = spark.sparkContext
    key = context.applicationId
    if key in _local_dirs:
        return _local_dirs[key]
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = context.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="reelstat-ckpt-")
        context.setCheckpointDir(d)
    _local_dirs[key] = d.rstrip("/")
    return _local_dirs[key]


_local_dirs: dict[str, str] = {}


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared folder that belongs to this application alone."""
    own = spark.sparkContext.applicationId
    return "/".join([checkpoint_dir(spark), own] + [p.strip("/") for p in parts])


#: Unset, Spark starts a shuffle with spark.sql.shuffle.partitions.
INITIAL_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Parquet bytes for which a shuffle gets one more partition, and the most of them.
PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 20_000


def partitions(spark: SparkSession) -> int:
    """Number of partitions of a shuffle, before AQE coalesces them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
               int(spark.conf.get(INITIAL_CONF, None) or 0))


def fit_partitions(spark: SparkSession, size: int) -> None:
    """Let shuffles start with enough partitions for an input of ``size`` bytes.

    With a fixed number of partitions a task's share grows with the input until
    its sorts and hash tables spill.  AQE coalesces what a small shuffle does not
    need.  A number that the caller has given, and a session that does not
    coalesce, are left alone."""
    context = spark.sparkContext.applicationId
    given = spark.conf.get(INITIAL_CONF, None)
    on = all(spark.conf.get(f"spark.sql.adaptive.{k}", "true").lower() == "true"
             for k in ("enabled", "coalescePartitions.enabled"))
    if not on or (given and given != _fitted.get(context)):
        return
    wanted = min(-(-size // PARTITION_BYTES), MOST_PARTITIONS)
    if wanted > partitions(spark):
        _fitted[context] = str(wanted)
        spark.conf.set(INITIAL_CONF, str(wanted))


_fitted: dict[str, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what a plan uses more
    than once, or what must not be computed anew when a task is repeated."""
    spark = df.sparkSession
    path = scratch_path(spark, "work", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_test_session(cores: int | None = None) -> SparkSession:
    """Session for tests and local benchmarks (local[N], 8 shuffle partitions)."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(master=f"local[{n}]", shuffle_partitions=8,
                         driver_memory="16g")
