"""Spark settings the pipelines rely on, and the shared checkpoint folder."""

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Row-preserving joins on customer, phone or order keys can meet a hot key;
    # AQE splits such a partition on the probing side.
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def builder(app_name: str = "leadmill") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; local sessions without one get their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="leadmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
