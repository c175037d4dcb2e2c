"""Tables written along a space-filling order of two columns, so that filters on either skip files.

Both columns are cut at sampled quantiles into 2^BITS ranges. Interleaving the bits of a row's
two range numbers gives its place on a Z-shaped curve; files are ranges of that place. Each file
then spans a small range of both columns, which its Parquet statistics tell every scan.
"""

from pyspark.sql import Column, DataFrame, functions as F

BITS = 6
#: Rows of the table that quantiles are taken from; any cut is right, a good one skips more.
SAMPLE_ROWS = 20_000


def _cuts(df: DataFrame, column: str) -> list[str]:
    """Quantiles of the column as text, exact for dates, numbers and strings."""
    values = df.select(column).filter(F.col(column).isNotNull())
    some = values.orderBy(F.xxhash64(column, F.monotonically_increasing_id())).limit(SAMPLE_ROWS)
    rows = [r[0] for r in some.orderBy(column).select(F.col(column).cast("string")).collect()]
    n = 1 << BITS
    return list(dict.fromkeys(rows[len(rows) * k // n] for k in range(1, n))) if rows else []


def _range(df: DataFrame, column: str) -> Column:
    """Number of the column's range, 0 for NULL, found by halving."""
    cuts, kind = _cuts(df, column), df.schema[column].dataType

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) < F.lit(cuts[mid]).cast(kind), among(low, mid)).otherwise(among(mid + 1, high))

    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(among(0, len(cuts)))


def curve(df: DataFrame, first: str, second: str) -> Column:
    """A row's place on the curve: the bits of both range numbers, in turn."""
    a, b = _range(df, first), _range(df, second)
    place = F.lit(0)
    for k in range(BITS):
        for shift, c in ((2 * k + 1, a), (2 * k, b)):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)), shift))
    return place


def write_clustered(df: DataFrame, path: str, first: str, second: str, files: int) -> None:
    """Write df as about `files` Parquet files that are ranges of the curve, each sorted by it.

    Many rows of one place are dealt further by both columns, so a frequent value is spread.
    """
    by = ["_place", second, first]
    (
        df.withColumn("_place", curve(df, first, second))
        .repartitionByRange(files, *by)
        .sortWithinPartitions(*by)
        .drop("_place")
        .write.parquet(path)
    )
