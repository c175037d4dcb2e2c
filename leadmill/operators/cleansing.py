"""Cleansing steps that need more than one row or table."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from leadmill.functions.text import goods_list
from leadmill.operators.keyed import lookup


def require_key(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def with_default_rows(df: DataFrame, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """Append fixed rows; columns a row does not name are NULL."""
    one_row = df.sparkSession.range(1)
    for row in rows:
        cells = [F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]
        df = df.unionByName(one_row.select(*cells))
    return df


def null_orphan_fk(items: DataFrame, products: DataFrame, spread: str) -> DataFrame:
    """Items with product ids the catalogue lacks set to NULL; every item is kept."""
    known = products.select(
        F.col("product_id").alias("known_id"), F.col("product_id").alias("_kept")
    ).distinct()
    return (
        lookup(items, known, "product_id", "known_id", spread)
        .withColumn("product_id", F.col("_kept"))
        .drop("_kept")
    )


def explode_goods(df: DataFrame, goods: str, keep: Sequence[str]) -> DataFrame:
    """One item row with quantity 1 per entry of the comma-separated goods text."""
    return df.select(
        *keep, F.posexplode(goods_list(F.col(goods))).alias("item_id", "product_raw")
    ).select(
        *keep,
        F.col("item_id").cast("bigint").alias("item_id"),
        "product_raw",
        F.lit(1).cast("bigint").alias("qty_item"),
    )
