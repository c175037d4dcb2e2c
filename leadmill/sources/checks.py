"""Checks on files before a load and on tables after it."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from leadmill.schemas import ORDER_FORM_COLUMNS


def missing_columns(df: DataFrame, required: Sequence[str] = ORDER_FORM_COLUMNS) -> DataFrame:
    """One row: the required columns the file lacks (NULL if none) and its number of rows."""
    missing = [c for c in required if c not in df.columns]
    return df.agg(
        F.lit(", ".join(missing) or None).cast("string").alias("missing"),
        F.count(F.lit(1)).alias("rows"),
    )


def load_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of rows per table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
