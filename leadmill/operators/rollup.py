"""Sums per day, kept as a table; weeks, months and longer reports are made from it.

Sums of days can be added up. So late orders change only the rows of their days: their own sums
per day are merged into those. In a store, days are in buckets, and a merge rewrites only the
buckets of days that changed.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from leadmill.functions.numbers import mean
from leadmill.functions.times import as_timestamp, months_before, period_label
from leadmill.operators.analytics import count_rows
from leadmill.operators.filters import completed_only
from leadmill.operators.keyed import lookup
from leadmill.schemas import DAILY_SALES
from leadmill.sources.files import conform

SUMS = DAILY_SALES.names[1:]


def daily_sales(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Completed orders per day; revenue of the customers' first day and of later days as well.

    `priced` counts the orders with a revenue, which an average is over. Orders without a date
    are the NULL day.
    """
    first = customers.select("customer_id", F.to_date("first_order_date").alias("first_day"))
    rows = completed_only(orders).select(
        "customer_id", "order_id", "net_revenue", "total_qty", F.to_date("order_date").alias("day")
    )
    amount = F.col("net_revenue")
    sums = (
        lookup(rows, first, "customer_id", "customer_id", spread="order_id")
        .groupBy("day")
        .agg(
            count_rows().alias("orders"),
            F.count(amount).alias("priced"),
            F.sum(amount).alias("revenue"),
            F.sum(F.when(F.col("day") == F.col("first_day"), amount)).alias("revenue_new"),
            F.sum(F.when(F.col("day") > F.col("first_day"), amount)).alias("revenue_repeat"),
            F.sum("total_qty").alias("total_qty"),
        )
    )
    return conform(sums, DAILY_SALES)


def merge_days(*parts: DataFrame) -> DataFrame:
    """The sums of all the orders that the parts are of."""
    rows = reduce(DataFrame.unionByName, parts)
    return conform(rows.groupBy("day").agg(*[F.sum(c).alias(c) for c in SUMS]), DAILY_SALES)


def revenue_from_days(
    daily: DataFrame, group_by: str = "month", day_from: str | None = None, day_to: str | None = None
) -> DataFrame:
    """revenue_by_period for whole days, both included."""
    rows = daily
    if day_from:
        rows = rows.filter(F.col("day") >= F.lit(day_from).cast("date"))
    if day_to:
        rows = rows.filter(F.col("day") <= F.lit(day_to).cast("date"))
    return (
        rows.groupBy(period_label(F.col("day"), group_by).alias("period"))
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("revenue").cast("decimal(28,2)").alias("revenue"),
            mean(F.sum("revenue"), F.sum("priced")).alias("avg_order_value"),
            F.sum("total_qty").alias("total_qty"),
        )
        .orderBy("period")
    )


def monthly_from_days(daily: DataFrame, as_of: str, months: int = 24) -> DataFrame:
    """monthly_new_vs_repeat, for an `as_of` at midnight: a window that begins within a day
    can't be told from sums of days."""
    whole = as_timestamp(as_of)
    rows = daily.filter(
        F.assert_true(whole == F.date_trunc("day", whole), F.lit("as_of must be a midnight")).isNull()
        & (F.col("day") >= F.to_date(months_before(as_of, months)))
    )
    zero = F.lit(0).cast("decimal(28,2)")
    return (
        rows.groupBy(F.date_format("day", "yyyy-MM").alias("month"))
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("revenue").cast("decimal(28,2)").alias("revenue"),
            F.coalesce(F.sum("revenue_new").cast("decimal(28,2)"), zero).alias("revenue_new"),
            F.coalesce(F.sum("revenue_repeat").cast("decimal(28,2)"), zero).alias("revenue_repeat"),
        )
        .orderBy("month")
    )
