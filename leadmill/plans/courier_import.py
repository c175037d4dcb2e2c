"""Incremental import of a courier export.

The export is reduced to the first row per new order id before anything else, so only
rows that become orders can create customers or convert leads. All outputs derive from
that table and from one row per phone in it.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, functions as F

from leadmill.functions.numbers import payment_from_cod, whole_amount
from leadmill.functions.phones import courier_phone
from leadmill.functions.text import courier_name, courier_status, courier_text
from leadmill.functions.times import courier_date, days_before
from leadmill.operators.analytics import count_if, count_rows, sum_rows
from leadmill.operators.cleansing import explode_goods
from leadmill.operators.customer_state import (
    FACTS, customer_state, merge_states, merged_facts, order_facts, with_delta,
)
from leadmill.operators.keyed import first_by, lookup
from leadmill.operators.rules import AsOf, assign_segments, buyers_by_state, refreshed, tracks_of
from leadmill.schemas import (
    COURIER_HEADINGS, COURIER_PLATFORM, CUSTOMER_STATE, CUSTOMERS, MONEY, ORDER_ITEMS, ORDERS,
)
from leadmill.sources.files import (
    append_table, conform, layout, reload_table, remove_folder,
)
from leadmill.sources.staging import new_folder


def usable_rows(raw: DataFrame) -> DataFrame:
    """Raw rows under short names, with a clean order id; rows without one are dropped.

    Columns that the export lacks are NULL, as if they were empty."""
    short = raw.select(
        *[
            (F.col(f"`{heading}`") if heading in raw.columns else F.lit(None).cast("string"))
            .alias(name)
            for name, heading in COURIER_HEADINGS.items()
        ],
        "row_no",
    )
    return short.withColumn("order_id", courier_text(F.col("order_id"))).filter(
        F.col("order_id").isNotNull()
    )


def typed_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "order_id",
        "row_no",
        courier_phone(F.col("phone")).alias("phone"),
        *[courier_text(F.col(c)).alias(c) for c in ("name", "province", "city")],
        courier_name(F.col("expedition")).alias("shipping_provider"),
        courier_status(F.col("last_status")).alias("order_status"),
        courier_date(F.col("create_date")).alias("order_date"),
        "goods",
        whole_amount(F.col("quantity"), 1).cast("int").alias("total_qty"),
        whole_amount(F.col("product_value"), 0).cast(MONEY).alias("net_revenue"),
        whole_amount(F.col("shipping_fee"), 0).cast(MONEY).alias("shipping_cost"),
        payment_from_cod(F.col("cod")).alias("payment_method"),
    )


def classified_rows(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """First row of every order id, `copies` (its usable rows) and whether it is `stored`."""
    rows = usable_rows(raw)
    columns = [c for c in rows.columns if c != "order_id"]
    firsts = rows.groupBy("order_id").agg(
        first_by(columns, "row_no").alias("first"), count_rows().alias("copies")
    )
    known = (
        orders.filter(F.col("source_platform") == COURIER_PLATFORM)
        .groupBy(F.col("order_id").alias("known_id")).agg(F.lit(True).alias("stored"))
    )
    joined = firsts.join(known, F.col("order_id") == F.col("known_id"), "left").drop("known_id")
    return joined.withColumn("stored", F.coalesce("stored", F.lit(False)))


def row_counts() -> list[Column]:
    """Of classified rows: orders that are new, and all usable rows."""
    usable = F.coalesce(F.sum("copies"), F.lit(0))
    return [count_if(~F.col("stored")).alias("inserted"), usable.alias("usable")]


def fresh_rows(classified: DataFrame) -> DataFrame:
    """Typed first row of every order id that is not stored yet."""
    return typed_rows(classified.filter(~F.col("stored")).select("order_id", "first.*"))


def customers_by_phone(customers: DataFrame) -> DataFrame:
    """One customer per stored phone: the one with the smallest id."""
    return (
        customers.filter(F.col("phone_raw").isNotNull())
        .groupBy("phone_raw")
        .agg(first_by(["customer_id", "name"], "customer_id").alias("stored"))
    )


def phone_book(fresh: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per phone of the fresh rows: its customer, stored or new, and what these orders
    add to the customer's state.

    A new customer is described by the phone's first row. A stored one keeps its name
    even where that is NULL.
    """
    described = ["name", "city", "province", "net_revenue", "order_date"]
    phones = (
        fresh.filter(F.col("phone").isNotNull())
        .groupBy("phone")
        .agg(
            first_by(described, "row_no").alias("first"),
            *[c.alias(name) for name, c in order_facts().items()],
        )
    )
    # Phones are not NULL here, so the grouping's partitions serve the join.
    stored = customers_by_phone(customers).withColumnRenamed("phone_raw", "stored_phone")
    is_new = F.col("stored").isNull()
    return phones.join(stored, F.col("phone") == F.col("stored_phone"), "left").select(
        "phone",
        is_new.alias("is_new"),
        F.when(is_new, F.col("phone")).otherwise(F.col("stored.customer_id")).alias("customer_id"),
        F.when(is_new, F.col("first.name")).otherwise(F.col("stored.name")).alias("customer_name"),
        "first",
        *FACTS,
    )


def state_delta(book: DataFrame) -> DataFrame:
    """What the import adds to the customers' state; an id may be that of two phones."""
    rows = book.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
    return rows.agg(*[c.alias(name) for name, c in merged_facts().items()])


def new_orders(fresh: DataFrame, book: DataFrame) -> DataFrame:
    names = book.select(F.col("phone").alias("book_phone"), "customer_id", "customer_name")
    matched = lookup(fresh, names, "phone", "book_phone", spread="order_id")
    return conform(
        matched.withColumns(
            {
                "source_platform": F.lit(COURIER_PLATFORM),
                "customer_name": F.when(F.col("phone").isNull(), F.col("name")).otherwise(
                    F.col("customer_name")
                ),
                "seller_shipping_discount": F.lit(0),
            }
        ),
        ORDERS,
    )


def new_items(fresh: DataFrame) -> DataFrame:
    keyed = fresh.withColumn("source_platform", F.lit(COURIER_PLATFORM))
    return conform(explode_goods(keyed, "goods", ["order_id", "source_platform"]), ORDER_ITEMS)


def new_customers(book: DataFrame, customers: DataFrame) -> DataFrame:
    """Unknown phones as customers, unless the phone is already used as an id."""
    taken = customers.select("customer_id")
    added = book.filter("is_new").join(taken, "customer_id", "left_anti")
    return conform(
        added.select(
            "customer_id",
            F.col("phone").alias("phone_raw"),
            F.col("customer_name").alias("name"),
            "first.city",
            "first.province",
            F.lit("New").alias("segment"),
            F.lit(1).alias("total_orders"),
            F.col("first.net_revenue").alias("total_revenue"),
            F.col("first.net_revenue").alias("avg_order_value"),
            F.col("first.order_date").alias("first_order_date"),
            F.col("first.order_date").alias("last_order_date"),
            F.lit(COURIER_PLATFORM).alias("last_platform"),
        ),
        CUSTOMERS,
    )


def converted_leads(leads: DataFrame, book: DataFrame) -> DataFrame:
    """Open leads whose phone has a completed fresh order, with `newly_converted`."""
    buyers = book.filter("completed_orders > 0").select(
        F.col("phone").alias("book_phone"),
        F.col("customer_id").alias("book_customer"),
        F.lit(True).alias("bought"),
    )
    hit = F.coalesce(F.col("bought") & (F.col("converted") == 0), F.lit(False))
    changes = {
        "converted": F.when(hit, 1).otherwise(F.col("converted")),
        "customer_id": F.when(hit, F.col("book_customer")).otherwise(F.col("customer_id")),
        "newly_converted": hit,
    }
    return (
        lookup(leads, buyers, "phone", "book_phone", spread="contact_id")
        .withColumns(changes)
        .select(*leads.columns, "newly_converted")
    )


class CourierImport:
    """New rows of the import, whole tables after it, and its report; all lazy.

    `raw` has the export's headings and an orderable `row_no`. Give a shared folder as
    `stage_dir` when several results are used: the two tables that all results derive
    from are then written there once (a new subfolder each) and read back, instead of
    being computed for each result.

    `state` is the stored customer state (`customer_state`) of the old orders. With it, customers
    and leads are brought up to date from the state and the new orders alone; of the old orders
    only ids are read, to know which are stored. Without it, it is computed from them.
    """

    def __init__(
        self,
        raw: DataFrame,
        customers: DataFrame,
        orders: DataFrame,
        leads: DataFrame,
        as_of: AsOf,
        stage_dir: str | None = None,
        state: DataFrame | None = None,
    ):
        self.raw = raw
        self.old_customers = customers
        self.old_orders = orders
        self.old_leads = leads
        self.as_of = as_of
        self.stage_dir = stage_dir
        self.old_state = customer_state(orders) if state is None else conform(state, CUSTOMER_STATE)
        self._stages: list[str] = []

    @cached_property
    def _classified(self) -> DataFrame:
        rows = classified_rows(self.raw, self.old_orders)
        if self.stage_dir is None:
            return rows
        # Counted while the fresh rows are written, so that the export is read once.
        self._observed = Observation("courier rows")
        return rows.observe(self._observed, *row_counts())

    @cached_property
    def fresh(self) -> DataFrame:
        return self._staged(fresh_rows(self._classified), "fresh")

    @cached_property
    def book(self) -> DataFrame:
        return self._staged(phone_book(self.fresh, self.old_customers), "phones")

    @cached_property
    def new_orders(self) -> DataFrame:
        return new_orders(self.fresh, self.book)

    @cached_property
    def new_items(self) -> DataFrame:
        return new_items(self.fresh)

    @cached_property
    def new_customers(self) -> DataFrame:
        return new_customers(self.book, self.old_customers)

    @cached_property
    def orders(self) -> DataFrame:
        return self.old_orders.unionByName(self.new_orders, allowMissingColumns=True)

    @cached_property
    def _customers(self) -> DataFrame:
        """With the new ones, before the refresh of statistics and segments; state beside them."""
        known = self.old_customers.unionByName(self.new_customers, allowMissingColumns=True)
        return with_delta(known, self.old_state, state_delta(self.book))

    @cached_property
    def state(self) -> DataFrame:
        """The customers' state after the import."""
        return merge_states(self.old_state, conform(state_delta(self.book), CUSTOMER_STATE))

    @cached_property
    def customers(self) -> DataFrame:
        after = assign_segments(refreshed(self._customers), self.as_of)
        return after.drop(*[f"s_{c}" for c in FACTS])

    @cached_property
    def _converted(self) -> DataFrame:
        return converted_leads(self.old_leads, self.book)

    @cached_property
    def leads(self) -> DataFrame:
        buyers = buyers_by_state(self._customers, days_before(self.as_of, 90))
        leads = self._converted.drop("newly_converted")
        return tracks_of(leads, buyers, self.as_of, "courier_import")

    @cached_property
    def report(self) -> DataFrame:
        """One row: orders inserted, usable rows skipped as duplicates, leads converted."""
        synced = self._converted.agg(count_if(F.col("newly_converted")).alias("leads_synced"))
        inserted, usable = F.col("inserted"), F.col("usable")
        if self.stage_dir is not None:
            _ = self.fresh  # the book has been made from it, so its rows are counted
            new, rows = (self._observed.get[c] for c in ("inserted", "usable"))
            return synced.select(
                F.lit(new).cast("bigint").alias("inserted"),
                F.lit(rows - new).cast("bigint").alias("skipped_duplicate"),
                "leads_synced",
            )
        counted, zero = self._classified.agg(*row_counts()), F.lit(0).cast("bigint")
        return sum_rows(
            counted.select("inserted", (usable - inserted).alias("skipped_duplicate"), zero.alias("leads_synced")),
            synced.select(zero.alias("inserted"), zero.alias("skipped_duplicate"), "leads_synced"),
        )

    def save(self, tables_dir: str, new_dir: str) -> None:
        """Write customers, leads and the customers' state after the import to `new_dir`, then
        append the new items and orders to `tables_dir`, in the layout of the tables there.

        Orders come last: until they are stored, a retry with the same export finds them new
        again, replaces what is in `new_dir`, and skips items that are stored already. Needs
        `stage_dir`, as an append changes what the results derive from; the staged tables are
        removed at the end."""
        if self.stage_dir is None:
            raise ValueError("saving needs a stage_dir")
        spark = self.raw.sparkSession
        items_dir, orders_dir = f"{tables_dir}/order_items", f"{tables_dir}/orders"
        added_orders, added_items = self.new_orders, self.new_items
        reload_table(self.customers, f"{new_dir}/customers")
        reload_table(self.leads.drop("previous_track"), f"{new_dir}/leads")
        reload_table(self.state, f"{new_dir}/customer_state")
        if layout(spark, items_dir) is not None:
            key = ["order_id", "source_platform"]
            stored = spark.read.schema(ORDER_ITEMS).parquet(items_dir).select(key).distinct()
            added_items = added_items.join(stored, key, "left_anti")
        append_table(added_items, items_dir)
        append_table(added_orders, orders_dir)
        for path in self._stages:
            remove_folder(spark, path)
        self._stages.clear()

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        if self.stage_dir is None:
            return df
        path = new_folder(df.sparkSession, name, self.stage_dir)
        df.write.parquet(path)
        self._stages.append(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
