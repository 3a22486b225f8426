import time

from pyspark.sql import functions as F

from reelstat.llm import common


def test_shuffle_files_go_when_a_written_step_ends(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    before, conf = files(), spark.conf.get(common.SHUFFLE_CLEANUP, None)
    out = common.written(spark.range(5000).groupBy((F.col("id") % 997).alias("k")).count(), "test")
    for _ in range(50):  # Spark removes them in the background
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(common.SHUFFLE_CLEANUP, None) == conf
    assert out.count() == 997 and out.agg(F.sum("count")).first()[0] == 5000
