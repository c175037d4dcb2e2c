"""Sorted pages of a listing."""

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame, functions as F

MAX_PAGE_ROWS = 5000
#: Rows that may be left to skip when the page is fetched, and keys that a histogram is cut by.
SKIP_ROWS = 1000
SAMPLE_KEYS = 4096

#: The sort columns of a row as text, which is exact for dates, decimals, numbers and strings.
Bound = tuple[str | None, ...]


@dataclass(frozen=True)
class SortKey:
    """A sort column; NULL sorts first ascending and last descending."""

    name: str
    descending: bool = False

    @property
    def column(self) -> Column:
        c = F.col(self.name)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()

    def before(self, value: Column | None) -> Column:
        """Whether the column sorts before a value (None: NULL)."""
        c = F.col(self.name)
        if value is None:
            return c.isNotNull() if self.descending else F.lit(False)
        if self.descending:
            return F.coalesce(c > value, F.lit(False))
        return c.isNull() | (c < value)


def sort_columns(
    requested: str, allowed: Sequence[str], direction: str, keys: Sequence[str]
) -> list[SortKey]:
    """Sort by a permitted column (else the first permitted one), then by key, so that pages are
    repeatable."""
    name = requested if requested in allowed else allowed[0]
    return [SortKey(name, direction != "asc"), *[SortKey(k) for k in keys]]


def page_of(df: DataFrame, order: Sequence[SortKey], page: int = 1, limit: int = 20) -> DataFrame:
    """The page-th `limit` rows in the given order.

    Rows before the page are skipped by nested histograms of the sort key, cell by cell, until at
    most SKIP_ROWS of them are left; then these and the page are a top-k of the last cell. No
    rows are moved but keys of the samples, whatever the page.
    """
    if page < 1 or not 1 <= limit <= MAX_PAGE_ROWS:
        raise ValueError(f"page must be at least 1 and limit from 1 to {MAX_PAGE_ROWS}")
    cell, skip = _cell(df, order, (page - 1) * limit, limit)
    return cell.orderBy(*[k.column for k in order]).offset(skip).limit(limit)


def _cell(df: DataFrame, order: Sequence[SortKey], skip: int, limit: int) -> tuple[DataFrame, int]:
    """Rows among which the page is, and how many of them come before it."""
    inside, size = df, None
    while skip > SKIP_ROWS:
        size = inside.count() if size is None else size
        if skip >= size:
            return inside.limit(0), 0
        bounds = _around(_sample(inside, order), skip, skip + limit, size)
        at = _before(df, order)
        ranks = inside.agg(*[F.count(F.when(at(b), 1)) for b in bounds]).first()
        lower = max(((n, b) for n, b in zip(ranks, bounds) if 0 < n <= skip), default=None, key=_rank)
        upper = min(((n, b) for n, b in zip(ranks, bounds) if skip + limit <= n < size), default=None, key=_rank)
        if lower is None and upper is None:
            break  # only copies of a few keys are left
        if upper is not None:
            size, inside = upper[0], inside.filter(at(upper[1]))
        if lower is not None:
            skip, size, inside = skip - lower[0], size - lower[0], inside.filter(~at(lower[1]))
    return inside, skip


def _rank(found: tuple[int, Bound]) -> int:
    return found[0]


def _sample(rows: DataFrame, order: Sequence[SortKey]) -> list[Bound]:
    """Keys of up to SAMPLE_KEYS rows, chosen by a hash, in order."""
    keys = rows.select(*[k.name for k in order])
    chosen = keys.orderBy(F.xxhash64(*keys.columns)).limit(SAMPLE_KEYS)
    texts = chosen.orderBy(*[k.column for k in order]).select(
        *[F.col(c).cast("string") for c in keys.columns]
    )
    return [tuple(r) for r in texts.collect()]


def _around(sample: list[Bound], first: int, last: int, size: int) -> list[Bound]:
    """Keys of the sample on both sides of where the page should be, near ones and further ones."""
    n = len(sample)
    places = set()
    for rank in (first, last):
        share = min(1.0, rank / size)
        error = max(1.0, sqrt(n * share * (1 - share)))
        for steps in (0, 1, 2, 4, 8):
            places |= {int(n * share + s * steps * error) for s in (-1, 1)}
    return list(dict.fromkeys(sample[p] for p in sorted(places) if 0 <= p < n))


def _before(df: DataFrame, order: Sequence[SortKey]):
    """Condition that a row sorts before a bound: by the first column, or equal there and so on."""
    types = [df.schema[k.name].dataType for k in order]

    def condition(bound: Bound) -> Column:
        values = [None if v is None else F.lit(v).cast(t) for v, t in zip(bound, types)]
        whole = F.lit(False)
        for k, v in reversed(list(zip(order, values))):
            c = F.col(k.name)
            same = c.isNull() if v is None else F.coalesce(c == v, F.lit(False))
            whole = k.before(v) | (same & whole)
        return whole

    return condition


def page_info(df: DataFrame, limit: int = 20) -> DataFrame:
    """One row: number of rows and of pages of the whole listing."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / limit).alias("pages"))
