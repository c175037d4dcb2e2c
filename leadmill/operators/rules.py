"""Business rules: customer statistics and segments, lead tracks."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.functions.text import strip
from leadmill.functions.times import as_timestamp, days_before, days_since
from leadmill.operators.analytics import count_rows, count_if, sum_rows
from leadmill.operators.customer_state import customer_state, prefixed
from leadmill.operators.filters import completed_only
from leadmill.operators.keyed import lookup
from leadmill.schemas import COURIER_PLATFORM, MONEY

AsOf = str | datetime


def refresh_customer_stats(
    customers: DataFrame, orders: DataFrame, platform: str = COURIER_PLATFORM
) -> DataFrame:
    """Recount orders and revenue of the customers last seen on the platform.

    Counts and revenue are over completed orders, the last order date is over all.
    """
    stats = prefixed(customer_state(orders))
    return refreshed(customers.join(stats, "customer_id", "left"), platform).select(
        *customers.columns
    )


def refreshed(with_state: DataFrame, platform: str = COURIER_PLATFORM) -> DataFrame:
    """Customers of the platform with the statistics of the state beside them (`prefixed`)."""
    mine = F.col("last_platform") == platform

    def new(value: Column, old: str) -> Column:
        return F.when(mine, value).otherwise(F.col(old))

    revenue = F.coalesce("s_completed_revenue", F.lit(0)).cast(MONEY)
    return with_state.withColumns(
        {
            "total_orders": new(F.coalesce("s_completed_orders", F.lit(0)), "total_orders"),
            "total_revenue": new(revenue, "total_revenue"),
            "last_order_date": new(F.col("s_last_order_date"), "last_order_date"),
        }
    )


def segment_of(total_orders: Column, last_order_date: Column, as_of: AsOf) -> Column:
    """Days here are calendar days."""
    recent = F.datediff(as_timestamp(as_of), last_order_date) <= 90
    return (
        F.when(total_orders >= 4, "Loyal")
        .when(total_orders >= 2, "Returning")
        .when((total_orders == 1) & recent, "New")
        .otherwise("Churn")
    )


def assign_segments(customers: DataFrame, as_of: AsOf) -> DataFrame:
    rule = segment_of(F.col("total_orders"), F.col("last_order_date"), as_of)
    return customers.withColumn("segment", rule)


def buyer_last_orders(
    orders: DataFrame, customers: DataFrame, since: Column | None = None
) -> DataFrame:
    """Last completed order per buyer phone; orders are summed up per customer first."""
    bought = completed_only(orders)
    if since is not None:
        bought = bought.filter(F.col("order_date") >= since)
    per_customer = bought.groupBy("customer_id").agg(F.max("order_date").alias("last_bought"))
    return (
        customers.filter(F.col("phone_raw").isNotNull())
        .select("customer_id", "phone_raw")
        .join(per_customer, "customer_id")
        .groupBy("phone_raw")
        .agg(F.max("last_bought").alias("last_bought"), F.lit(True).alias("is_buyer"))
    )


def buyers_by_state(with_state: DataFrame, since: Column | None = None) -> DataFrame:
    """buyer_last_orders from customers with their state beside them (`prefixed`)."""
    bought = F.col("s_completed_orders") > 0
    if since is not None:
        bought = F.col("s_last_completed_date") >= since
    return (
        with_state.filter(F.col("phone_raw").isNotNull() & bought)
        .groupBy("phone_raw")
        .agg(F.max("s_last_completed_date").alias("last_bought"), F.lit(True).alias("is_buyer"))
    )


def blacklisted() -> Column:
    return strip(F.coalesce("pipeline_status", F.lit(""))) == "Blacklist"


def last_activity() -> Column:
    return F.coalesce("last_message_at", "created_at")


def courier_import_track(as_of: AsOf) -> Column:
    return (
        F.when(blacklisted(), "Arsip")
        .when(F.col("is_buyer"), "T3-Fresh")
        .when(days_since(as_of, last_activity()) <= 90, "T2-Nurturing")
        .when(F.col("last_message_at").isNotNull(), "T4-Winback")
        .otherwise("T1-Akuisisi")
    )


def prospect_track(as_of: AsOf) -> Column:
    """Track of a lead without a known purchase."""
    return (
        F.when(F.col("converted") == 1, "T3-Fresh")
        .when(days_since(as_of, F.col("created_at")) <= 14, "T1-Akuisisi")
        .when(days_since(as_of, last_activity()) <= 90, "T2-Nurturing")
        .otherwise("T4-Winback")
    )


def lead_import_track(as_of: AsOf) -> Column:
    return (
        F.when(blacklisted(), "Arsip")
        .when(F.col("is_buyer"), "T3-Fresh")
        .otherwise(prospect_track(as_of))
    )


def full_sync_track(as_of: AsOf) -> Column:
    idle = days_since(as_of, F.col("last_bought"))
    buyer = F.when(idle <= 90, "T3-Fresh").when(idle <= 365, "T3-Lama").otherwise("T4-Winback")
    return (
        F.when(blacklisted(), "Arsip")
        .when(F.col("is_buyer"), buyer)
        .otherwise(prospect_track(as_of))
    )


# Rule, and for how many days back a purchase makes a buyer (None: ever).
POLICIES: dict[str, tuple[Callable[[AsOf], Column], int | None]] = {
    "courier_import": (courier_import_track, 90),
    "lead_import": (lead_import_track, 90),
    "full_sync": (full_sync_track, None),
}


def assign_tracks(
    leads: DataFrame, orders: DataFrame, customers: DataFrame, as_of: AsOf, policy: str
) -> DataFrame:
    """Leads with the track of the policy; the old one is kept as `previous_track`.

    The courier import also marks every recent buyer as converted.
    """
    days = POLICIES[policy][1]
    since = None if days is None else days_before(as_of, days)
    return tracks_of(leads, buyer_last_orders(orders, customers, since), as_of, policy)


def tracks_of(leads: DataFrame, buyers: DataFrame, as_of: AsOf, policy: str) -> DataFrame:
    """assign_tracks for buyer phones (phone_raw, last_bought, is_buyer) that are known."""
    rule, _ = POLICIES[policy]
    known = leads.withColumn("_phone", F.nullif("phone", F.lit("")))
    joined = lookup(known, buyers, "_phone", "phone_raw", spread="contact_id")
    converted = F.col("converted")
    if policy == "courier_import":
        converted = F.when(F.col("is_buyer") & (converted == 0), 1).otherwise(converted)
    changes = {"previous_track": F.col("track"), "track": rule(as_of), "converted": converted}
    return joined.withColumns(changes).select(*leads.columns, "previous_track")


def track_distribution(tracked: DataFrame) -> DataFrame:
    """Leads per new track, and how many of them had another track before (or none)."""
    changed = ~F.col("track").eqNullSafe(F.col("previous_track"))
    return (
        tracked.groupBy("track")
        .agg(count_rows().alias("leads"), count_if(changed).alias("changed"))
        .orderBy("track")
    )


def track_report(tracked: DataFrame, buyers: DataFrame) -> DataFrame:
    """One row: leads processed, tracks changed, and buyer phones of all time."""
    changed = ~F.col("track").eqNullSafe(F.col("previous_track"))
    none = F.lit(0).cast("bigint")
    leads = tracked.agg(
        count_rows().alias("processed"), count_if(changed).alias("updated"), none.alias("buyers_total")
    )
    phones = buyers.agg(
        none.alias("processed"), none.alias("updated"), count_rows().alias("buyers_total")
    )
    return sum_rows(leads, phones)
