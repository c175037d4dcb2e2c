"""Reports over the stored tables."""

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.functions.numbers import mean
from leadmill.functions.times import months_before, period_label
from leadmill.operators.filters import between, completed_only, mapped_products
from leadmill.operators.keyed import lookup

def count_rows() -> Column:
    return F.count(F.lit(1))


def money_sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,2)")


def sum_if(condition: Column, value: Column) -> Column:
    return money_sum(F.when(condition, value))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_rows(*parts: DataFrame) -> DataFrame:
    """Add up one-row tables of counts with the same columns."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def order_kpis(orders: DataFrame) -> DataFrame:
    """One row about completed orders."""
    revenue = F.col("net_revenue")
    return completed_only(orders).agg(
        count_rows().alias("total"),
        money_sum(revenue).alias("total_revenue"),
        F.coalesce(mean(F.sum(revenue), F.count(revenue)), F.lit(0.0)).alias("avg_order_value"),
        money_sum(F.col("shipping_cost")).alias("total_shipping"),
        money_sum(F.col("seller_shipping_discount")).alias("total_subsidi_ongkir"),
    )


def customer_kpis(customers: DataFrame) -> DataFrame:
    """One row: customers in all and per segment."""
    segment = F.col("segment")
    return customers.agg(
        count_rows().alias("total"),
        *[count_if(segment == s).alias(s.lower()) for s in ("Loyal", "Returning", "New", "Churn")],
    )


def monthly_new_vs_repeat(
    orders: DataFrame, customers: DataFrame, as_of: str | datetime, months: int = 24
) -> DataFrame:
    """Revenue per month, split by whether the order fell on the customer's first order day.

    Orders meet the first days directly: that side's rows can be split where a customer has
    very many, and the months' sums combine on the map side, so orders are shuffled once.
    """
    recent = completed_only(orders).filter(F.col("order_date") >= months_before(as_of, months))
    days = recent.select(
        "customer_id", "order_id", "net_revenue", F.to_date("order_date").alias("day")
    )
    first_days = customers.select("customer_id", F.to_date("first_order_date").alias("first_day"))
    day, first_day, amount = F.col("day"), F.col("first_day"), F.col("net_revenue")
    return (
        lookup(days, first_days, "customer_id", "customer_id", spread="order_id")
        .groupBy(F.date_format("day", "yyyy-MM").alias("month"))
        .agg(
            count_rows().alias("orders"),
            F.sum(amount).cast("decimal(28,2)").alias("revenue"),
            sum_if(day == first_day, amount).alias("revenue_new"),
            sum_if(day > first_day, amount).alias("revenue_repeat"),
        )
        .orderBy("month")
    )


def top_products(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    n: int = 10,
    by_category: bool = False,
) -> DataFrame:
    """Products of completed orders with the largest quantity.

    `by_category` counts each item category of a product on its own. Items are first
    counted per product, name and category: sums of numbers combine in hash maps on
    the map side, while a maximum of texts would sort all items. Only those few rows
    meet the catalogue.
    """
    sold = mapped_products(items).join(
        completed_only(orders).select("order_id", "source_platform"),
        ["order_id", "source_platform"],
    )
    variants = sold.groupBy("product_id", "product_name", "product_category").agg(
        count_rows().alias("n"), F.sum("qty_item").alias("qty")
    )
    by = ["product_id", "product_category"] if by_category else ["product_id"]
    sums = variants.groupBy(*by).agg(
        F.max("product_name").alias("item_name"),
        F.max("product_category").alias("category"),
        F.sum("n").alias("order_count"),
        F.sum("qty").alias("total_qty"),
    )
    names = products.select("product_id", F.col("product_name").alias("catalogue_name"))
    return (
        sums.join(names, "product_id", "left")
        .select(
            "product_id",
            F.coalesce("catalogue_name", "item_name").alias("product_name"),
            F.col("category").alias("product_category"),
            "order_count",
            "total_qty",
        )
        .orderBy(F.desc_nulls_last("total_qty"), *by)
        .limit(n)
    )


def top_provinces(customers: DataFrame, n: int = 10) -> DataFrame:
    return (
        customers.filter(F.col("province").isNotNull())
        .groupBy("province")
        .agg(count_rows().alias("customers"))
        .orderBy(F.desc("customers"), "province")
        .limit(n)
    )


def revenue_by_period(
    orders: DataFrame,
    group_by: str = "month",
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Completed orders per month, week or day."""
    revenue = F.col("net_revenue")
    return (
        completed_only(orders)
        .filter(between(F.col("order_date"), date_from, date_to))
        .groupBy(period_label(F.col("order_date"), group_by).alias("period"))
        .agg(
            count_rows().alias("orders"),
            F.sum(revenue).cast("decimal(28,2)").alias("revenue"),
            mean(F.sum(revenue), F.count(revenue)).alias("avg_order_value"),
            F.sum("total_qty").alias("total_qty"),
        )
        .orderBy("period")
    )


def pipeline_stats(leads: DataFrame) -> DataFrame:
    """Leads and converted leads per pipeline status; NULL is a status of its own."""
    return (
        leads.groupBy("pipeline_status")
        .agg(count_rows().alias("total"), F.sum("converted").alias("converted"))
        .orderBy(F.desc("total"), "pipeline_status")
    )
