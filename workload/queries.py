"""The library's queries on the model tables: name -> f(spark, sf_dir) -> DataFrame.

Every query runs over whole tables. Only feature limits (top n, page size) cut rows.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType

from leadmill.functions import numbers, phones, text, times
from leadmill.operators import (
    analytics, cleansing, due, filters, paging, rollup, rules, search, views,
)
from leadmill.operators import customer_state as customer_states
from leadmill.plans import courier_import, lead_import, lead_patches, master_load
from leadmill.session import shared_folder
from leadmill.sources import checks
from leadmill.sources.files import select_available
from leadmill.sources.staging import new_folder, stage
from leadmill.sources.store import Buckets, TableStore
from workload.model import AS_OF, LEAD_IMPORT_AS_OF, Model

#: 40 days before AS_OF.
EARLIER = "2001-06-23 00:00:00"

QUERIES: dict[str, Callable[[Model], DataFrame]] = {}


def query(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def plain(df: DataFrame) -> DataFrame:
    """Money as double: engines name the type of a decimal sum differently."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, DecimalType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def bind(f: Callable[[Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(f(Model(spark, sf_dir)))


# --- reports ---------------------------------------------------------------------


@query
def order_kpis(m):
    return analytics.order_kpis(m.orders)


@query
def customer_kpis(m):
    return analytics.customer_kpis(m.customers)


@query
def monthly_new_vs_repeat(m):
    return analytics.monthly_new_vs_repeat(m.orders, m.customers, AS_OF)


@query
def monthly_new_vs_repeat_all(m):
    return analytics.monthly_new_vs_repeat(m.orders, m.customers, AS_OF, months=120)


@query
def top_products(m):
    return analytics.top_products(m.orders, m.items, m.products)


@query
def top_products_by_category(m):
    return analytics.top_products(m.orders, m.items, m.products, by_category=True)


@query
def top_provinces(m):
    return analytics.top_provinces(m.customers)


@query
def revenue_by_month(m):
    return analytics.revenue_by_period(m.orders, "month")


@query
def revenue_by_week(m):
    return analytics.revenue_by_period(m.orders, "week")


@query
def revenue_by_day(m):
    return analytics.revenue_by_period(m.orders, "day")


@query
def revenue_in_range(m):
    return analytics.revenue_by_period(m.orders, "other", "1998-03-05", "1999-11-20 12:00:00")


def days_after_late_orders(m: Model) -> DataFrame:
    """Sums per day of one channel's orders, into which the other's were merged later."""
    late = F.col("source_platform") == "mengantar"
    parts = [rollup.daily_sales(m.orders.filter(c), m.customers) for c in (~late, late)]
    return rollup.merge_days(*parts)


@query
def daily_sales(m):
    return days_after_late_orders(m)


@query
def revenue_by_week_from_days(m):
    return rollup.revenue_from_days(days_after_late_orders(m), "week")


@query
def revenue_in_days(m):
    return rollup.revenue_from_days(days_after_late_orders(m), "month", "1998-03-05", "1999-11-20")


@query
def monthly_new_vs_repeat_from_days(m):
    return rollup.monthly_from_days(days_after_late_orders(m), AS_OF, months=120)


@query
def pipeline_stats(m):
    return analytics.pipeline_stats(m.leads)


# --- listings and views ----------------------------------------------------------


@query
def list_customers_page(m):
    return views.list_customers(m.customers, "total_revenue", "desc", page=3, limit=50)


@query
def list_customers_search(m):
    return views.list_customers(
        m.customers, "not a column", "asc", limit=500, search="customer#0000001",
        province="a", platform="mengantar",
    )


@query
def list_customers_backslash(m):
    return views.list_customers(m.customers, limit=500, search="customer\\#0000001")


@query
def customers_with_backslash(m):
    # Names that hold a backslash, searched with one.
    odd = m.customers.withColumn("name", F.expr(r"replace(name, '#', '\\#')"))
    found = filters.filter_customers(odd, search="CUSTOMER\\#0000001", province="a")
    return found.select("customer_id", "name", "province")


@query
def list_orders_deep_page(m):
    return views.list_orders(m.orders, page=13, limit=100)


@query
def list_orders_page_near_end(m):
    """The page at nine tenths of all: beyond row 100,000 where there are so many."""
    pages = paging.page_info(m.orders, limit=100).first()["pages"]
    return views.list_orders(m.orders, page=max(1, pages * 9 // 10), limit=100)


@query
def list_customers_by_phone(m):
    return views.list_customers(m.customers, limit=100, search="0800-0000-01")


@query
def list_orders_page(m):
    return views.list_orders(
        m.orders, page=2, limit=100, status="completed", platform="mengantar",
        date_from="1997-01-01", date_to="2000-06-30",
    )


@query
def list_leads_page(m):
    return views.list_leads(
        m.leads, m.customers, "created_at", "asc", page=2, limit=50, label="LABEL",
        date_from="2000-06-01", date_to="2001-07-01",
    )


@query
def filter_customers(m):
    return filters.filter_customers(m.customers, segment="Loyal", province="asia").select(
        "customer_id", "segment", "province"
    )


@query
def search_customers_by_trigrams(m):
    """The names with a pattern, from the buckets of a stored table that can have it."""
    how = Buckets("customer_id", 64)
    columns = [f.name for f in m.customers.schema]
    table = TableStore(m.customers.sparkSession, new_folder(m.customers.sparkSession, "customers"), {"customers": how})
    table.commit("load", {"customers": m.customers})
    stored = table.read("customers", m.customers.schema)
    index = stage(search.trigram_index(stored, ["name", "province", "customer_id"], how.of(stored)), "grams")
    wanted = {"search": "mer#0000001%7", "province": "asi"}
    only = search.candidate_buckets(index, search.customer_patterns(stored, **wanted))
    near = table.read("customers", m.customers.schema, only=only)
    return filters.filter_customers(near.select(columns), **wanted).select("customer_id", "name", "province")


@query
def filter_leads_prospects(m):
    return filters.filter_leads(
        m.leads, pipeline_status="Prospect", converted=False, search="00", kota="nation_1",
        track="T2-Nurturing",
    ).select("contact_id", "kota", "track", "converted")


@query
def filter_leads_winback_paid(m):
    tracked = rules.assign_tracks(m.leads, m.orders, m.customers, AS_OF, "courier_import")
    return filters.filter_leads(tracked, track="T4-Paid").select("contact_id", "track")


@query
def leads_page_info(m):
    return paging.page_info(filters.filter_leads(m.leads, converted=False), limit=20)


@query
def orders_with_product_list(m):
    return views.orders_with_product_list(m.orders, m.items)


@query
def orders_with_cut_product_list(m):
    return views.orders_with_product_list(m.orders, m.items, piece_rows=2)


@query
def phone_lookup_orders(m):
    found = views.phone_lookup_orders(m.messy_phones, m.customers, m.orders, m.items, "row_id")
    return found.select(
        "row_id", "customer_id", "match_status", "order_id", "source_platform", "order_date",
        "net_revenue", "part", "products",
    )


@query
def lead_detail(m):
    # Contacts of the lead export: stored ones with and without customer, and new ones.
    return views.lead_details(m.leads, m.customers, m.lead_export).select(
        "contact_id", "found", "name", "phone", "customer_id", "segment", "total_orders",
        "total_revenue", "customer_last_order_date",
    )


@query
def leads_enriched(m):
    return views.leads_enriched(m.leads, m.customers).select(
        "contact_id", "name", "phone", "customer_id", "segment", "total_orders", "total_revenue",
        "customer_last_order_date",
    )


HISTORY = [
    "customer_id", "name", "order_count", "order_id", "source_platform", "order_date",
    "order_status", "payment_method", "net_revenue", "shipping_cost", "shipping_provider",
    "total_qty", "product_name", "product_raw", "qty_item", "product_category",
]


@query
def customer_360_flat(m):
    return views.customer_order_items(m.customers, m.orders, m.items).select(HISTORY)


@query
def customer_360_nested(m):
    documents = views.customer_360(m.customers, m.orders, m.items)
    orders = documents.select(
        "customer_id", "name", "order_count", F.explode_outer("orders").alias("o")
    )
    rows = orders.select(
        "customer_id", "name", "order_count", "o.*", F.explode_outer("o.items").alias("i")
    )
    return rows.select("*", "i.*").select(HISTORY)


@query
def phone_match(m):
    return views.match_customers_by_phone(m.messy_phones, m.customers, "row_id")


# --- cleansing -------------------------------------------------------------------


@query
def clean_phones(m):
    raw = F.col("phone")
    return m.messy_phones.select(
        "row_id",
        phones.normalize_phone(raw).alias("normalized"),
        phones.courier_phone(raw).alias("courier"),
        phones.lead_phone(raw).alias("lead"),
    )


@query
def clean_courier_fields(m):
    rows = courier_import.typed_rows(courier_import.usable_rows(m.courier_export))
    return rows.drop("goods")


@query
def parse_rupiah(m):
    return m.raw_products.select(
        "product_name", "product_price", "product_cost",
        numbers.parse_rupiah(F.col("product_price")).alias("price"),
        numbers.parse_rupiah(F.col("product_cost")).alias("cost"),
    )


@query
def clean_lead_times(m):
    return m.lead_export.select(
        "row_no",
        times.utc_ts(F.col("created_at")).alias("created_at"),
        text.lead_text(F.col("note")).alias("note"),
        text.truncate_text(F.col("label_names"), 50).alias("label_names"),
    )


@query
def null_nan_prices(m):
    value = F.col("net_revenue").cast("double")
    odd = F.when(F.col("total_qty") == 1, F.lit("NaN").cast("double")).otherwise(value)
    return m.orders.select("order_id", numbers.null_if_nan(odd).alias("net_revenue"))


@query
def explode_goods(m):
    rows = courier_import.usable_rows(m.courier_export)
    return cleansing.explode_goods(rows, "goods", ["row_no"])


@query
def null_orphan_fk(m):
    return cleansing.null_orphan_fk(m.items, m.products, "item_id").select(
        "order_id", "item_id", "product_id", "qty_item"
    )


def master(m: Model) -> dict[str, DataFrame]:
    return master_load.prepare_master_tables(
        m.raw_products, m.raw_customers, m.raw_orders, m.raw_items
    )


@query
def master_products(m):
    return master(m)["products"]


@query
def master_customers(m):
    return master(m)["customers"]


@query
def master_orders(m):
    return master(m)["orders"]


@query
def master_items(m):
    return master(m)["order_items"]


@query
def reload_orders(m):
    return master_load.reload_orders(m.raw_orders, m.raw_items)["orders"]


@query
def reload_items(m):
    return master_load.reload_orders(m.raw_orders, m.raw_items)["order_items"]


@query
def load_report(m):
    return checks.load_report(
        {
            "products": m.products,
            "customers": m.customers,
            "orders": m.orders,
            "order_items": m.items,
            "leads": m.leads,
        }
    )


@query
def order_form_check(m):
    form = select_available(m.raw_orders, ["order_id", "net_revenue", "customer_id"])
    return checks.missing_columns(form)


# --- rules -----------------------------------------------------------------------


@query
def refresh_customer_stats(m):
    # Stored totals are made stale first, so that the refresh has something to do.
    stale = m.customers.withColumns(
        {"total_orders": F.col("total_orders") + 1, "last_order_date": F.col("first_order_date")}
    )
    return rules.refresh_customer_stats(stale, m.orders).select(
        "customer_id", "last_platform", "total_orders", "total_revenue", "avg_order_value",
        "first_order_date", "last_order_date",
    )


@query
def assign_segments(m):
    return rules.assign_segments(m.customers, AS_OF).select(
        "customer_id", "total_orders", "last_order_date", "segment"
    )


def tracks(m: Model, policy: str) -> DataFrame:
    return rules.assign_tracks(m.leads, m.orders, m.customers, AS_OF, policy)


TRACKED = ["contact_id", "phone", "pipeline_status", "converted", "previous_track", "track"]


@query
def tracks_courier_import(m):
    return tracks(m, "courier_import").select(TRACKED)


@query
def tracks_lead_import(m):
    return tracks(m, "lead_import").select(TRACKED)


@query
def tracks_full_sync(m):
    return tracks(m, "full_sync").select(TRACKED)


@query
def tracks_of_due_leads(m):
    """Tracked 40 days earlier; then only leads that are due, or whose buyer bought since."""
    before = F.lit(EARLIER).cast("timestamp_ntz")
    old = m.orders.filter(F.col("order_date") < before)
    buyers = stage(rules.buyer_last_orders(old, m.customers), "buyers")
    tracked = rules.tracks_of(m.leads, buyers, EARLIER, "full_sync").drop("previous_track")
    leads = stage(tracked, "tracked")
    index = stage(due.due_index(leads, buyers, EARLIER, "full_sync"), "due")
    changed = rules.buyer_last_orders(m.orders.filter(F.col("order_date") >= before), m.customers)
    now = rules.buyer_last_orders(m.orders, m.customers)
    touched = due.retrack_due(leads, index, now, changed, AS_OF, "full_sync")
    return due.with_new_tracks(leads, touched).select("contact_id", "converted", "track")


@query
def track_distribution(m):
    return rules.track_distribution(tracks(m, "full_sync"))


@query
def track_report(m):
    buyers = rules.buyer_last_orders(m.orders, m.customers)
    return rules.track_report(tracks(m, "full_sync"), buyers)


# --- imports ---------------------------------------------------------------------


@query
def upsert_leads(m):
    return lead_import.upsert_leads(m.lead_export, m.leads, m.customers, LEAD_IMPORT_AS_OF)


@query
def lead_import_tracks(m):
    after = lead_import.upsert_leads(m.lead_export, m.leads, m.customers, LEAD_IMPORT_AS_OF)
    tracked = rules.assign_tracks(after, m.orders, m.customers, LEAD_IMPORT_AS_OF, "lead_import")
    return tracked.select("contact_id", "converted", "previous_track", "track")


@query
def lead_import_report(m):
    return lead_import.lead_import_report(m.lead_export, m.leads)


def patches(m: Model) -> DataFrame:
    fields = """
        CASE kind WHEN 0 THEN map('note', new_text)
                  WHEN 1 THEN map('kota', new_text, 'track', 'T3-Fresh')
                  WHEN 2 THEN map('phone', new_text)
                  ELSE map('note', CAST(NULL AS STRING), 'phone', new_text) END"""
    return m.patch_events.select("contact_id", "patch_no", F.expr(fields).alias("fields"))


@query
def lead_patches_applied(m):
    return lead_patches.apply_lead_patches(m.leads, patches(m), LEAD_IMPORT_AS_OF)


@query
def lead_patch_report(m):
    return lead_patches.patch_report(patches(m))


def courier(m: Model) -> courier_import.CourierImport:
    return courier_import.CourierImport(
        m.courier_export, m.customers, m.orders, m.leads, AS_OF
    )


def courier_on_state(m: Model) -> courier_import.CourierImport:
    """The import as it runs in use: on a stored customer state, shared inputs written once."""
    state = stage(customer_states.customer_state(m.orders), "customer-state")
    return courier_import.CourierImport(
        m.courier_export, m.customers, m.orders, m.leads, AS_OF,
        shared_folder(state.sparkSession), state,
    )


@query
def courier_new_orders(m):
    return courier(m).new_orders.select(
        "order_id", "source_platform", "customer_id", "customer_name", "order_date",
        "order_status", "payment_method", "shipping_provider", "net_revenue", "shipping_cost",
        "seller_shipping_discount", "total_qty",
    )


@query
def courier_new_items(m):
    return courier(m).new_items.select(
        "order_id", "source_platform", "item_id", "product_raw", "qty_item"
    )


CUSTOMER_STATS = [
    "customer_id", "phone_raw", "name", "city", "province", "segment", "total_orders",
    "total_revenue", "avg_order_value", "first_order_date", "last_order_date", "last_platform",
]


@query
def courier_new_customers(m):
    return courier(m).new_customers.select(CUSTOMER_STATS)


@query
def courier_customers_after(m):
    return courier_on_state(m).customers.select(CUSTOMER_STATS)


@query
def customer_state(m):
    return customer_states.customer_state(m.orders)


@query
def courier_state_after(m):
    return courier_on_state(m).state


@query
def courier_leads_after(m):
    return courier_on_state(m).leads.select("contact_id", "phone", "customer_id", "converted", "track")


@query
def courier_report(m):
    return courier_on_state(m).report
