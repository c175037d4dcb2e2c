"""Initial load: raw all-text exports to typed tables."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from leadmill.functions.numbers import default_qty, id_text, parse_rupiah, to_flag, to_num
from leadmill.functions.text import valid_segment
from leadmill.functions.times import to_ts
from leadmill.operators.cleansing import null_orphan_fk, require_key, with_default_rows
from leadmill.schemas import CUSTOMERS, EXTRA_PRODUCT, ORDER_ITEMS, ORDERS, PRODUCTS
from leadmill.sources.files import select_available


def typed(raw: DataFrame, schema: StructType, special: Mapping[str, Column]) -> DataFrame:
    """Known columns that exist, parsed by type; `special` overrides single columns."""

    def parse(name: str, type_name: str) -> Column:
        c = F.col(name)
        if name in special:
            return special[name]
        if type_name == "string":
            return c
        if type_name == "timestamp_ntz":
            return to_ts(c)
        return to_num(c, type_name)

    known = select_available(raw, schema.names)
    return known.select(
        *[
            parse(f.name, f.dataType.simpleString()).cast(f.dataType).alias(f.name)
            for f in schema
            if f.name in known.columns
        ]
    )


def prepare_products(raw: DataFrame) -> DataFrame:
    prices = {c: parse_rupiah(F.col(c)) for c in ("product_price", "product_cost")}
    products = require_key(typed(raw, PRODUCTS, prices), "product_id")
    return with_default_rows(products, [EXTRA_PRODUCT])


def prepare_customers(raw: DataFrame) -> DataFrame:
    return typed(raw, CUSTOMERS, {"segment": valid_segment(F.col("segment"))})


def prepare_orders(raw: DataFrame) -> DataFrame:
    return typed(raw, ORDERS, {"is_hpp": to_flag(F.col("is_hpp"))})


def prepare_items(raw: DataFrame, products: DataFrame) -> DataFrame:
    special = {c: to_flag(F.col(c)) for c in ("is_parent_row", "is_hpp")}
    special["qty_item"] = default_qty(F.col("qty_item"))
    return null_orphan_fk(typed(raw, ORDER_ITEMS, special), products, spread="order_id")


def prepare_master_tables(
    products: DataFrame, customers: DataFrame, orders: DataFrame, items: DataFrame
) -> dict[str, DataFrame]:
    """The four tables of the initial load, by name."""
    catalogue = prepare_products(products)
    return {
        "products": catalogue,
        "customers": prepare_customers(customers),
        "orders": prepare_orders(orders),
        "order_items": prepare_items(items, catalogue),
    }


def reload_orders(raw_orders: DataFrame, raw_items: DataFrame) -> dict[str, DataFrame]:
    """Orders and items for a truncate-and-reload (write them with `reload_table`).

    The exports of this route print customer ids as floats and flags only as words,
    and items keep their product ids unchecked.
    """
    words = ("True",)
    orders = typed(
        raw_orders,
        ORDERS,
        {
            "is_hpp": to_flag(F.col("is_hpp"), words),
            "customer_id": id_text(F.col("customer_id")),
        },
    )
    items = typed(
        raw_items,
        ORDER_ITEMS,
        {
            "is_parent_row": to_flag(F.col("is_parent_row"), words),
            "is_hpp": to_flag(F.col("is_hpp"), words),
            "qty_item": default_qty(F.col("qty_item")),
        },
    )
    return {"orders": orders, "order_items": items}
