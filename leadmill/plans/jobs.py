"""Imports, edits and re-tracking as whole steps on a store: read, compute, commit together.

Each step names its batch. A step that failed anywhere can be run again: nothing of it is valid
until its commit, and a committed batch is not applied twice. Reports come with the commit.
"""

from pyspark.sql import DataFrame, functions as F

from leadmill.functions.times import days_before
from leadmill.operators.analytics import count_if
from leadmill.operators.customer_state import customer_state, prefixed
from leadmill.operators.rules import (
    POLICIES, AsOf, buyers_by_state, track_distribution, tracks_of,
)
from leadmill.plans.courier_import import CourierImport
from leadmill.plans.lead_import import contacts, contacts_report, merged_leads
from leadmill.plans.lead_patches import apply_lead_patches, valid_patches
from leadmill.schemas import CUSTOMER_STATE, CUSTOMERS, LEADS, ORDER_ITEMS, ORDERS, PRODUCTS
from leadmill.sources.staging import new_folder, stage
from leadmill.sources.store import Buckets, Merge, TableStore

SCHEMAS = {
    "products": PRODUCTS, "customers": CUSTOMERS, "orders": ORDERS, "order_items": ORDER_ITEMS,
    "leads": LEADS, "customer_state": CUSTOMER_STATE,
}
LEAD_BUCKETS = {"leads": Buckets("contact_id")}


def load_store(store: TableStore, tables: dict[str, DataFrame], batch: str = "load") -> bool:
    """The first load; the customers' state is made from the orders."""
    return store.commit(batch, {**tables, "customer_state": customer_state(tables["orders"])})


def _tables(store: TableStore, *names: str):
    now = store.snapshot()
    return now, [store.read(n, SCHEMAS[n], now) for n in names]


def import_courier(store: TableStore, raw: DataFrame, as_of: AsOf, batch: str) -> DataFrame | None:
    """Import a courier export; its report, or None if the batch was imported before."""
    now, (customers, orders, leads, state) = _tables(
        store, "customers", "orders", "leads", "customer_state"
    )
    if batch in now.batches:
        return None
    done = CourierImport(
        raw, customers, orders, leads, as_of, new_folder(store.spark, "import"), state
    )
    report = stage(done.report, "report")
    store.commit(
        batch,
        replace={
            "customers": done.customers,
            "leads": done.leads.drop("previous_track"),
            "customer_state": done.state,
        },
        append={"order_items": done.new_items, "orders": done.new_orders},
        base=now,
    )
    return report


def import_leads(
    store: TableStore, export: DataFrame, as_of: AsOf, batch: str
) -> tuple[DataFrame, DataFrame] | None:
    """Upsert a lead export and track all leads anew: the report and the leads per track."""
    now, (leads, customers, state) = _tables(store, "leads", "customers", "customer_state")
    if batch in now.batches:
        return None
    incoming = stage(contacts(export, customers), "contacts")
    after = merged_leads(leads, incoming, as_of)
    tracked = stage(_tracked(after, customers, state, as_of, "lead_import"), "tracked")
    report = stage(contacts_report(incoming, leads), "report")
    store.commit(batch, replace={"leads": tracked.drop("previous_track")}, base=now)
    return report, track_distribution(tracked)


def retrack(store: TableStore, as_of: AsOf, batch: str) -> tuple[DataFrame, DataFrame] | None:
    """Track all leads by their whole purchase history; one row of counts, and leads per track.

    Only buckets in which a track changes are written again.
    """
    now, (leads, customers, state) = _tables(store, "leads", "customers", "customer_state")
    if batch in now.batches:
        return None
    tracked = stage(_tracked(leads, customers, state, as_of, "full_sync"), "tracked")
    changed = ~F.col("track").eqNullSafe(F.col("previous_track"))
    report = tracked.agg(F.count(F.lit(1)).alias("processed"), count_if(changed).alias("updated"))
    # Leads without a contact id can't be told apart by a key; they go with the first change.
    new = tracked.filter(changed & F.col("contact_id").isNotNull()).select("contact_id", "track")
    keyless = tracked.filter(changed & F.col("contact_id").isNull()).isEmpty()
    if keyless:
        change = {"merge": {"leads": Merge(new, LEADS, _with_tracks)}}
    else:
        change = {"replace": {"leads": tracked.drop("previous_track")}}
    store.commit(batch, **change, base=now)
    return report, track_distribution(tracked)


def _with_tracks(old: DataFrame, new: DataFrame) -> DataFrame:
    tracks = new.select(F.col("contact_id").alias("_id"), F.col("track").alias("_track"), F.lit(True).alias("_new"))
    joined = old.join(tracks, F.col("contact_id") == F.col("_id"), "left")
    track = F.when(F.col("_new"), F.col("_track")).otherwise(F.col("track"))
    return joined.withColumn("track", track).select(*LEADS.names)


def upsert(store: TableStore, export: DataFrame, as_of: AsOf, batch: str) -> bool:
    """Upsert a lead export without tracking; only buckets with contacts of it are written."""
    now, (customers,) = _tables(store, "customers")
    incoming = stage(contacts(export, customers), "contacts")
    change = Merge(incoming, LEADS, lambda old, new: merged_leads(old, new, as_of))
    return store.commit(batch, merge={"leads": change}, base=now)


def patch(store: TableStore, patches: DataFrame, as_of: AsOf, batch: str) -> bool:
    """Apply edits of leads; only buckets with leads that are edited are written."""
    usable = valid_patches(patches).filter(
        (F.size("fields") > 0) & F.col("contact_id").isNotNull()
    )
    change = Merge(usable, LEADS, lambda old, new: apply_lead_patches(old, new, as_of))
    return store.commit(batch, merge={"leads": change})


def _tracked(leads: DataFrame, customers: DataFrame, state: DataFrame, as_of: AsOf, policy: str) -> DataFrame:
    days = POLICIES[policy][1]
    since = None if days is None else days_before(as_of, days)
    known = customers.select("customer_id", "phone_raw").join(prefixed(state), "customer_id")
    return tracks_of(leads, buyers_by_state(known, since), as_of, policy)
