"""Listings and joined views of customers, orders and leads."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leadmill.functions.phones import normalize_phone
from leadmill.operators.filters import filter_customers, filter_leads, filter_orders, parent_items
from leadmill.operators.keyed import PIECE_ROWS, join_many, lookup, ordered_lists
from leadmill.operators.paging import page_of, sort_columns
from leadmill.sources.staging import stage

ORDER_KEY = ["order_id", "source_platform"]
HISTORY_COLUMNS = [
    "order_id", "source_platform", "order_date", "order_status", "payment_method", "net_revenue",
    "shipping_cost", "shipping_provider", "shipping_type", "total_qty", "receipt_number",
]
ITEM_COLUMNS = ["product_name", "product_raw", "qty_item", "product_category"]


def list_customers(
    customers: DataFrame,
    sort: str = "last_order_date",
    direction: str = "desc",
    page: int = 1,
    limit: int = 20,
    **filters,
) -> DataFrame:
    allowed = ["last_order_date", "total_orders", "total_revenue", "avg_order_value"]
    columns = [
        "customer_id", "name", "city", "province", "segment", "total_orders", "total_revenue",
        "avg_order_value", "last_order_date", "first_platform", "last_platform", "recency_days",
        "first_order_date",
    ]
    order = sort_columns(sort, allowed, direction, ["customer_id"])
    return page_of(filter_customers(customers, **filters).select(columns), order, page, limit)


def list_orders(orders: DataFrame, page: int = 1, limit: int = 20, **filters) -> DataFrame:
    """Newest first."""
    columns = [
        "order_id", "source_platform", "order_date", "customer_name", "order_status",
        "payment_method", "net_revenue", "shipping_cost", "shipping_provider", "total_qty",
    ]
    order = sort_columns("order_date", ["order_date"], "desc", ORDER_KEY)
    return page_of(filter_orders(orders, **filters).select(columns), order, page, limit)


def list_leads(
    leads: DataFrame,
    customers: DataFrame,
    sort: str = "last_message_at",
    direction: str = "desc",
    page: int = 1,
    limit: int = 20,
    **filters,
) -> DataFrame:
    """Leads with the customer columns; only the rows of the page are joined."""
    allowed = ["last_message_at", "created_at", "name", "pipeline_status"]
    order = sort_columns(sort, allowed, direction, ["contact_id"])
    rows = stage(page_of(filter_leads(leads, **filters), order, page, limit), "page")
    # At most MAX_PAGE_ROWS ids, so broadcasting them is safe for any table size.
    wanted = F.broadcast(rows.select("customer_id").distinct())
    return leads_enriched(rows, customers.join(wanted, "customer_id", "left_semi")).orderBy(
        *[k.column for k in order]
    )


def leads_enriched(leads: DataFrame, customers: DataFrame) -> DataFrame:
    facts = customers.select(
        "customer_id",
        "segment",
        "total_orders",
        "total_revenue",
        F.col("last_order_date").alias("customer_last_order_date"),
    )
    return lookup(leads, facts, "customer_id", "customer_id", spread="contact_id")


def orders_with_product_list(
    orders: DataFrame, items: DataFrame, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Orders with the names of all their items, joined by ', ' in item order.

    There is a row for each `piece_rows` named items of an order, numbered by `part` from 0;
    an order without any has one row.
    """
    named = items.filter(F.col("product_name").isNotNull())
    found = ordered_lists(named, ORDER_KEY, ["item_id"], ["product_name"], "names", piece_rows)
    return found.join_to(orders).select(
        *ORDER_KEY,
        "customer_id",
        "order_date",
        "order_status",
        "payment_method",
        "net_revenue",
        "shipping_cost",
        "total_qty",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.array_join(F.col("names.product_name"), ", ").alias("products"),
    )


def with_order_count(customers: DataFrame, orders: DataFrame) -> DataFrame:
    counts = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"))
    return customers.join(counts, "customer_id", "left").withColumn(
        "order_count", F.coalesce("order_count", F.lit(0))
    )


def customer_order_items(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Flat form of `customer_360`: one row per customer, order and parent item."""
    history = orders.filter(F.col("customer_id").isNotNull()).select(
        "customer_id", *HISTORY_COLUMNS
    )
    lines = parent_items(items).select(*ORDER_KEY, "item_id", *ITEM_COLUMNS)
    bought = join_many(with_order_count(customers, history), history, ["customer_id"])
    return join_many(bought, lines, ORDER_KEY)


def customer_360(
    customers: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    customer_ids: Sequence[str] | None = None,
    piece_rows: int = PIECE_ROWS,
    item_piece_rows: int = 100,
) -> DataFrame:
    """Customers with nested orders (newest first), each with its parent items.

    With `customer_ids` only the orders and items of those customers are used. An order has an
    entry per `item_piece_rows` items, numbered by `item_part`, and a customer a row per
    `piece_rows` entries, numbered by `part`; so a row holds at most the product of both.
    """
    orders = orders.filter(F.col("customer_id").isNotNull())
    lines = parent_items(items)
    if customer_ids is not None:
        customers = customers.filter(F.col("customer_id").isin(*customer_ids))
        orders = orders.filter(F.col("customer_id").isin(*customer_ids))
        lines = lines.join(orders.select(ORDER_KEY), ORDER_KEY, "left_semi")
    listed = ordered_lists(lines, ORDER_KEY, ["item_id"], ITEM_COLUMNS, "items", item_piece_rows)
    entries = orders.select("customer_id", *HISTORY_COLUMNS)
    history = listed.join_to(entries).withColumnRenamed("part", "item_part")
    # An order is one entry, and another for each further piece of its items.
    more = entries.join(listed.lists.filter("part > 0"), ORDER_KEY).select("customer_id")
    # Ascending by this key is newest first with missing dates last.
    newest = -F.unix_micros(F.col("order_date").cast("timestamp"))
    history = history.withColumns(
        {
            "items": F.coalesce("items", F.array().cast(history.schema["items"].dataType)),
            "item_part": F.coalesce("item_part", F.lit(0)),
            "_newest": F.coalesce(newest, F.lit((1 << 63) - 1)),
        }
    )
    bought = ordered_lists(
        history,
        ["customer_id"],
        ["_newest", *ORDER_KEY, "item_part"],
        [*HISTORY_COLUMNS, "item_part", "items"],
        "orders",
        piece_rows,
        counted=entries.select("customer_id").unionByName(more),
    )
    documents = bought.join_to(with_order_count(customers, orders))
    return documents.withColumn("part", F.coalesce("part", F.lit(0)))


def phone_lookup_orders(
    phones: DataFrame, customers: DataFrame, orders: DataFrame, items: DataFrame, row_id: str
) -> DataFrame:
    """Customers by any spelling of their phone, with their orders and product names.

    One row per asked row, order and list piece, to be sorted by order_date; rows whose phone
    is not found have no order. Only orders and items of the customers found are listed.
    """
    asked = stage(match_customers_by_phone(phones, customers, row_id), "asked")
    found = asked.filter("match_status = 'found'").select(
        F.col("normalized_phone").alias("customer_id")
    ).distinct()
    theirs = stage(orders.join(found, "customer_id", "left_semi"), "theirs")
    listed = orders_with_product_list(
        theirs, items.join(theirs.select(ORDER_KEY), ORDER_KEY, "left_semi")
    )
    return join_many(
        asked.select(row_id, F.col("normalized_phone").alias("customer_id"), "match_status"),
        listed.filter(F.col("customer_id").isNotNull()),
        ["customer_id"],
        theirs,
    )


def lead_detail(leads: DataFrame, customers: DataFrame, contact_ids: Sequence[str]) -> DataFrame:
    """Leads by id, with the customer columns; the ids reach the scan as a filter."""
    return leads_enriched(leads.filter(F.col("contact_id").isin(*contact_ids)), customers)


def lead_details(leads: DataFrame, customers: DataFrame, asked: DataFrame) -> DataFrame:
    """The leads of a table of contact_ids, however many, with the customer columns.

    One row per distinct id that is asked; `found` is false, and all else NULL, where there is no
    such lead. Only the customers of these leads are joined.
    """
    ids = asked.filter(F.col("contact_id").isNotNull()).select("contact_id").distinct()
    theirs = leads.join(ids, "contact_id", "left_semi").withColumn("found", F.lit(True))
    detail = leads_enriched(theirs, customers)
    return ids.join(detail, "contact_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def match_customers_by_phone(raw: DataFrame, customers: DataFrame, row_id: str) -> DataFrame:
    """Raw phones (column `phone`) resolved to customers, whose id is their phone.

    match_status is invalid, not_found or found.
    """
    asked = raw.withColumn("normalized_phone", normalize_phone(F.col("phone")))
    known = customers.select(
        F.col("customer_id").alias("match_id"), "name", "segment", "total_orders", "total_revenue",
        F.lit(True).alias("matched"),
    )
    status = (
        F.when(F.col("normalized_phone").isNull(), "invalid")
        .when(F.col("matched"), "found")
        .otherwise("not_found")
    )
    return (
        lookup(asked, known, "normalized_phone", "match_id", spread=row_id)
        .withColumn("match_status", status)
        .drop("matched")
    )
