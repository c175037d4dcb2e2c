"""Places of rows in a global order, from counts per range partition."""

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.llm.staging import Staged, stage


def in_order(df: DataFrame, order: list[Column], name: str) -> Staged:
    """df with `place`, its rows' position from 0 under `order`.

    Rows are dealt by ranges of the whole order, and equal ones by where they came from, so a
    frequent value is spread over many tasks. The written table fixes the partitions, whose
    numbers of rows (one per partition, on the driver) give the place of their first row.
    Null columns come where `order` puts them.
    """
    columns = df.columns
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    by = [*order, F.col("_tie")]
    dealt = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumns({"_part": F.spark_partition_id(), "_row": inside})
        .drop("_tie")
    )
    kept = stage(dealt, name)
    counts = sorted(kept.df.groupBy("_part").count().collect())
    starts = dict(zip([r["_part"] for r in counts], accumulate([0, *(r["count"] for r in counts)])))
    if not starts:
        return Staged(kept.df.select(*columns, F.lit(0).cast("long").alias("place")), kept.path)
    start = df.sparkSession.createDataFrame(list(starts.items()), "_part int, _start long")
    placed = kept.df.join(F.broadcast(start), "_part").withColumn("place", F.col("_start") + F.col("_row"))
    return Staged(placed.select(*columns, "place"), kept.path)
