"""Table schemas and the fixed vocabulary of the data model.

Timestamps are zone-less UTC wall clock (``timestamp_ntz``), so results do not
depend on the session time zone. Money is ``decimal(18,2)``.
"""

from pyspark.sql.types import (
    DataType, DateType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)

MONEY = "decimal(18,2)"

TYPES: dict[str, DataType] = {
    "date": DateType(),
    "total": DecimalType(28, 2),
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "money": DecimalType(18, 2),
    "timestamp": TimestampNTZType(),
}


def table(columns: str) -> StructType:
    """Schema from "name type, ..."; unlike a DDL string it needs no running session."""
    pairs = [column.split() for column in columns.split(",")]
    return StructType([StructField(name, TYPES[kind]) for name, kind in pairs])


# Columns of the stored tables, in their order.
CUSTOMERS = table(
    "customer_id string, name string, phone_raw string, address string, subdistrict string, "
    "city string, province string, all_provinces string, all_cities string, "
    "first_order_date timestamp, last_order_date timestamp, recency_days bigint, "
    "recency_months double, tenure_days bigint, total_orders bigint, "
    "total_revenue money, avg_order_value money, total_qty bigint, "
    "first_platform string, last_platform string, platforms_used string, segment string"
)

ORDERS = table(
    "order_id string, source_platform string, source_month string, "
    "order_date timestamp, completed_date timestamp, "
    "customer_id string, customer_name string, order_status string, payment_status string, "
    "payment_method string, net_revenue money, gross_revenue money, "
    "shipping_cost money, other_cost money, courier string, "
    "receipt_number string, utm_source string, utm_campaign string, handled_by string, "
    "is_hpp int, shipping_provider string, shipping_type string, "
    "seller_shipping_discount money, total_qty int"
)

ORDER_ITEMS = table(
    "item_id bigint, order_id string, source_platform string, product_raw string, "
    "product_id string, product_name string, product_category string, qty_item bigint, "
    "is_parent_row int, variation_raw string, mapping_notes string, is_hpp int"
)

PRODUCTS = table(
    "product_id string, product_category string, product_subcategory string, "
    "product_name string, product_variant string, product_catalogue string, "
    "product_price money, product_cost money, product_weight double"
)

LEADS = table(
    "contact_id string, name string, phone string, pipeline_status string, "
    "stage_status string, label_names string, handled_by_name string, inbox string, "
    "note string, first_message string, kota string, rumah_walet string, usia_rbw string, "
    "ukuran_rbw string, jumlah_sarang string, lantai_rbw string, panen_per_3bulan string, "
    "customer_id string, converted int, created_at timestamp, "
    "last_message_at timestamp, updated_at timestamp, track string"
)

# What orders add up to per customer, so that they need not be read again.
CUSTOMER_STATE = table(
    "customer_id string, completed_orders bigint, completed_revenue money, "
    "last_order_date timestamp, last_completed_date timestamp"
)

# Sums of completed orders per day.
DAILY_SALES = table(
    "day date, orders bigint, priced bigint, revenue total, revenue_new total, "
    "revenue_repeat total, total_qty bigint"
)

TABLES = {
    "products": PRODUCTS,
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "leads": LEADS,
}

# They must be exactly these for results to agree with existing data.
COMPLETED = "completed"
COURIER_PLATFORM = "mengantar"
SEGMENTS = ["New", "Returning", "Loyal", "Churn", "Unknown"]
PLACEHOLDER_PRODUCTS = ["UNMAPPED", "UNKNOWN", "CGEB_UNKNOWN", "CTPWSU_UNKNOWN"]
EXTRA_PRODUCT = {
    "product_id": "EDEQPC01",
    "product_category": "Education",
    "product_subcategory": "Equipment",
    "product_name": "Peralatan Cuci Sarang Walet",
}
ORDER_FORM_COLUMNS = [
    "order_id", "product", "phone", "name", "status", "payment_method", "net_revenue",
    "created_at",
]
PATCHABLE_LEAD_FIELDS = [
    "pipeline_status", "note", "label_names", "handled_by_name", "kota", "name", "track",
    "rumah_walet", "usia_rbw", "ukuran_rbw", "jumlah_sarang", "lantai_rbw",
    "panen_per_3bulan",
]
COURIER_NAMES = {
    "JT": "J&T", "jt": "J&T", "lion": "Lion Parcel", "Sap": "SAP", "sap": "SAP",
    "iDexpress": "ID Express", "SiCepat": "SiCepat", "JNE": "JNE",
}

# Headings of the courier export and of the lead export.
COURIER_HEADINGS = {
    "order_id": "Order ID",
    "phone": "Customer Phone Number",
    "name": "Customer Name",
    "province": "Province",
    "city": "City",
    "expedition": "Expedition",
    "last_status": "Last Status",
    "create_date": "Create Date",
    "goods": "Goods Description",
    "quantity": "Quantity",
    "product_value": "Product Value",
    "shipping_fee": "Shipping Fee",
    "cod": "COD",
}
LEAD_HEADINGS = {
    "contact_id": "contact_id",
    "name": "display_name",
    "phone": "phone_number",
    "pipeline_status": "pipeline_status_name",
    "stage_status": "stage_status",
    "label_names": "label_names",
    "handled_by_name": "handled_by_name",
    "inbox": "inboxes_name",
    "note": "note",
    "first_message": "first_message",
    "kota": "additional_kota",
    "rumah_walet": "additional_data rumah walet",
    "usia_rbw": "additional_usia rumah walet",
    "ukuran_rbw": "additional_ukuran rumah walet",
    "jumlah_sarang": "additional_jumlah sarang (keping)",
    "lantai_rbw": "additional_lantai rumah walet",
    "panen_per_3bulan": "additional_panen per 3 bulan",
    "created_at": "created_at",
    "last_message_at": "last_message_at",
}
# Longest text kept per lead column.
LEAD_TEXT_LIMITS = {
    "label_names": 50, "first_message": 500, "rumah_walet": 20, "usia_rbw": 20,
    "ukuran_rbw": 20, "lantai_rbw": 20,
}
