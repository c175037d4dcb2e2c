"""Optional, AND-ed filters of the listings. An argument left out (or empty) filters nothing."""

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.functions.phones import normalize_phone
from leadmill.functions.text import contains_text
from leadmill.functions.times import as_timestamp
from leadmill.schemas import COMPLETED, PLACEHOLDER_PRODUCTS

WINBACK_VIEWS = {"T4-Unpaid": 0, "T4-Paid": 1}


def completed_only(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == COMPLETED)


def parent_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("is_parent_row") == 1)


def mapped_products(items: DataFrame) -> DataFrame:
    product = F.col("product_id")
    return items.filter(product.isNotNull() & ~product.isin(PLACEHOLDER_PRODUCTS))


def between(c: Column, start: str | None, end: str | None) -> Column:
    """start <= c <= end; a date without a time means its midnight."""
    condition = F.lit(True)
    if start:
        condition &= c >= as_timestamp(start)
    if end:
        condition &= c <= as_timestamp(end)
    return condition


def filter_customers(
    customers: DataFrame,
    search: str | None = None,
    segment: str | None = None,
    province: str | None = None,
    platform: str | None = None,
) -> DataFrame:
    """`search` is a phone prefix if it reads as a phone, otherwise part of the name."""
    condition = F.lit(True)
    if search:
        phone = normalize_phone(F.lit(search))
        condition &= F.when(phone.isNotNull(), F.col("customer_id").startswith(phone)).otherwise(
            contains_text(F.col("name"), search)
        )
    if segment:
        condition &= F.col("segment") == segment
    if province:
        condition &= contains_text(F.col("province"), province)
    if platform:
        condition &= (F.col("first_platform") == platform) | (F.col("last_platform") == platform)
    return customers.filter(condition)


def filter_orders(
    orders: DataFrame,
    status: str | None = None,
    platform: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    condition = between(F.col("order_date"), date_from, date_to)
    if status:
        condition &= F.col("order_status") == status
    if platform:
        condition &= F.col("source_platform") == platform
    return orders.filter(condition)


def filter_leads(
    leads: DataFrame,
    pipeline_status: str | None = None,
    converted: bool | None = None,
    search: str | None = None,
    kota: str | None = None,
    label: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    track: str | None = None,
) -> DataFrame:
    """`date_to` is a date and includes that whole day."""
    condition = between(
        F.col("created_at"), date_from, f"{date_to} 23:59:59" if date_to else None
    )
    if pipeline_status:
        condition &= F.col("pipeline_status") == pipeline_status
    if converted is not None:
        condition &= F.col("converted") == int(converted)
    if kota:
        condition &= contains_text(F.col("kota"), kota)
    if label:
        condition &= contains_text(F.col("label_names"), label)
    if track in WINBACK_VIEWS:
        condition &= F.col("track") == "T4-Winback"
        condition &= F.col("converted") == WINBACK_VIEWS[track]
    elif track:
        condition &= F.col("track") == track
    if search:
        condition &= contains_text(F.col("name"), search) | contains_text(F.col("phone"), search)
    return leads.filter(condition)
