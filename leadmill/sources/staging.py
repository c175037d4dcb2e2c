"""Intermediate tables in the folder that the cluster shares.

A staged table cuts the lineage, outlives an executor, and is read by everything that shares
it. It is removed when the driver's JVM ends.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from leadmill.session import shared_folder


def new_folder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A fresh path in `folder`, by default the shared one."""
    path = f"{folder or shared_folder(spark)}/leadmill-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df once and give the table that was written."""
    path = new_folder(df.sparkSession, name, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
