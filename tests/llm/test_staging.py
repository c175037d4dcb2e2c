"""Intermediate tables."""

import os
import time

from pyspark.sql import functions as F

from leadmill.llm.staging import _CLEANUP, stage


def shuffles(spark):
    """Shuffle files on disk."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    walked = [w for d in disk.localDirsString() for w in os.walk(d)]
    return {f for _, _, names in walked for f in names if f.startswith("shuffle_")}


def test_shuffle_files_go_when_the_table_is_written(spark):
    before = shuffles(spark)
    set_before = spark.conf.get(_CLEANUP, None)
    df = spark.range(5000).groupBy(F.col("id") % 700).count().repartition(3, "count")
    staged = stage(df, "counts")
    for _ in range(100):
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(_CLEANUP, None) == set_before
    assert staged.df.count() == 700
    # The frame itself can still be read, by new shuffles.
    assert df.agg(F.sum("count")).first()[0] == 5000
    staged.drop()
    assert not os.path.exists(staged.path.removeprefix("file://"))
