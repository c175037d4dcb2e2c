"""The held-out fold of documents and bounded, repeatable samples."""

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of the hash that samples are cut by.
_GRAIN = 1 << 30


def held_out(doc_id: str | Column) -> Column:
    """Whether the id's CRC-32 leaves remainder 1 modulo 3; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def sample(rows: DataFrame, size: int, count: int, *columns: str) -> DataFrame:
    """About `size` of `count` rows, chosen by a hash of the columns; all, if fewer."""
    if count <= size:
        return rows
    h = F.pmod(F.xxhash64(*columns), F.lit(_GRAIN))
    return rows.where(h < int(_GRAIN * size / count))
