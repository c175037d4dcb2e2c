"""Building blocks for work per key that stay even when one key holds much of the data."""

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.sources.staging import stage

# Elements of one piece of a list, for every key.
PIECE_ROWS = 10_000
# Keys of long lists that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000


def lookup(left: DataFrame, right: DataFrame, key: str, right_key: str, spread: str) -> DataFrame:
    """Left join to a table that is unique per `right_key`.

    Rows without a key match nothing but would all hash to one task, so they are
    spread by another column (best a unique one); the join condition still rejects
    them. A hot key in `left` is split by AQE. `right_key` is not in the result.
    """
    key_type = right.schema[right_key].dataType
    found = right.withColumnRenamed(right_key, "_found_key")
    spread_key = F.coalesce(F.col(key).cast(key_type), F.xxhash64(spread).cast(key_type))
    on = (spread_key == F.col("_found_key")) & F.col(key).isNotNull()
    return left.join(found, on, "left").drop("_found_key")


def first_by(columns: Sequence[str], order: str, condition: Column | None = None) -> Column:
    """Aggregate: the columns of the row with the smallest `order`, as a struct.

    Unlike row_number, it combines rows on the map side, so a hot key costs one row
    per task in the shuffle.
    """
    return F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), _where(order, condition))


def last_by(columns: Sequence[str], order: str, condition: Column | None = None) -> Column:
    """Aggregate: the columns of the row with the largest `order`, as a struct."""
    return F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), _where(order, condition))


def _where(order: str, condition: Column | None) -> Column:
    # min_by and max_by skip rows whose order is NULL.
    return F.col(order) if condition is None else F.when(condition, F.col(order))


def join_many(
    one: DataFrame, many: DataFrame, keys: Sequence[str], matched: DataFrame | None = None
) -> DataFrame:
    """Left join of a table unique per key to one with many rows per key.

    Spark cannot split a hot key on the optional side of an outer join, but on both sides of
    an inner one. So the matches come from an inner join, and the rows without a match from an
    anti join to the distinct keys, which combine on the map side. Give `matched`, a table with
    the same keys as `many`, where that is cheaper to read.
    """
    found = (many if matched is None else matched).select(*keys).distinct()
    alone = one.join(found, keys, "left_anti")
    return one.join(many, keys).unionByName(alone, allowMissingColumns=True)


@dataclass(frozen=True)
class OrderedLists:
    """Lists in pieces, the keys they have (repeated), and the written rows of the long ones."""

    lists: DataFrame
    keys: DataFrame
    rows: DataFrame | None

    def join_to(self, one: DataFrame) -> DataFrame:
        """Left join of a table to the lists of its keys."""
        by = self.keys.columns
        if self.rows is None:  # one row per key
            return one.join(self.lists, by, "left")
        return join_many(one, self.lists, by, self.keys)


def ordered_lists(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    name: str,
    piece_rows: int = PIECE_ROWS,
    counted: DataFrame | None = None,
) -> OrderedLists:
    """Arrays of structs per key, sorted by `order` (ascending, NULL first).

    The list of a key comes in pieces of `piece_rows` elements (the last may be shorter);
    `part` numbers them from 0. Keys are counted first. Up to `piece_rows` rows are one list,
    made in one shuffle. Rows of longer lists are cut by ranges, see `_long_lists`. Where `df` is
    dear, give `counted`: a table with the same keys, and at least as many rows of each.
    """
    rows = df.select(
        *keys,
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("_order"),
        F.xxhash64(*values).alias("_hash"),
        F.struct(*values).alias("_value"),
    )
    counted = (df if counted is None else counted).select(*keys)
    numbers = counted.groupBy(*keys).count()
    long = stage(numbers.filter(F.col("count") > piece_rows).select(*keys), f"{name}-long")
    n_long = long.count()
    short = rows
    if n_long:
        other = long.select(*[F.col(c).alias(f"l_{c}") for c in keys])
        other = F.broadcast(other) if n_long <= MAX_BROADCAST else other
        same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in keys]
        short = rows.join(other, same, "left_anti")
    sorted_rows = F.sort_array(F.collect_list(F.struct("_order", "_hash", "_value")))
    lists = short.groupBy(*keys).agg(sorted_rows.alias("_rows")).select(
        *keys,
        F.lit(0).cast("long").alias("part"),
        F.transform("_rows", lambda x: x["_value"]).alias(name),
    )
    if not n_long:
        return OrderedLists(lists, counted, None)
    found, kept = _long_lists(rows.join(other, same, "left_semi"), keys, name, piece_rows)
    return OrderedLists(lists.unionByName(found), counted, kept)


def _long_lists(
    rows: DataFrame, keys: Sequence[str], name: str, piece_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Lists in pieces, and the rows as they were written.

    The rows are sorted by ranges of key and order, cut at counted sample quantiles, and written
    once. So a frequent key is spread over several tasks, even if its order columns are all NULL
    or equal: a hash of the values and then the place in the input come after them. Rows per
    range, summed up, give every row its place among all, and its place in the list is how far
    that is from the first of its key.
    """
    by = [*keys, "_order", "_hash", "_tie"]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = stage(
        dealt.select(*keys, "_value", F.spark_partition_id().alias("_range"), inside.alias("_row")),
        name,
    )
    # One row per range; the running sum is over a short table.
    sizes = sorted(tuple(r) for r in kept.groupBy("_range").count().collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    ranges = rows.sparkSession.createDataFrame(
        [(r, start) for (r, _), start in zip(sizes, starts)], "_range int, _start long"
    )
    place = F.col("_start") + F.col("_row")
    placed = kept.join(F.broadcast(ranges), "_range").withColumn("_place", place)
    first = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in keys]
    firsts = first.select(*[F.col(c).alias(f"f_{c}") for c in keys], "_first")
    pairs = F.sort_array(F.collect_list(F.struct("_place", "_value")))
    lists = (
        placed.join(firsts, same)
        .groupBy(*keys, F.floor((F.col("_place") - F.col("_first")) / piece_rows).alias("part"))
        .agg(pairs.alias("_pairs"))
        .select(*keys, "part", F.transform("_pairs", lambda x: x["_value"]).alias(name))
    )
    return lists, kept
