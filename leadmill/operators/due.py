"""When a lead's track changes by age alone, so that re-tracking touches due leads only.

A track depends on the lead, on its phone's last purchase, and on how long ago three instants
are. Ages cross a limit at known instants. Until the next of them, a lead whose own data and
buyer stay the same keeps its track.
"""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.functions.times import as_timestamp
from leadmill.operators.keyed import lookup
from leadmill.operators.rules import AsOf, last_activity, tracks_of

_SOON = timedelta(microseconds=1)
#: Per policy the instants whose age counts, and from when on another rule holds.
#: "At most 14 days" ends when the 15th is over; a purchase is recent to the microsecond.
LIMITS: dict[str, list[tuple[str, timedelta]]] = {
    "courier_import": [("active", timedelta(days=91)), ("bought", timedelta(days=90) + _SOON)],
    "lead_import": [
        ("created", timedelta(days=15)), ("active", timedelta(days=91)),
        ("bought", timedelta(days=90) + _SOON),
    ],
    "full_sync": [
        ("created", timedelta(days=15)), ("active", timedelta(days=91)),
        ("bought", timedelta(days=91)), ("bought", timedelta(days=366)),
    ],
}


def next_change(as_of: AsOf, policy: str) -> Column:
    """The first instant after as_of at which an age crosses a limit; NULL if there is none."""
    now = as_timestamp(as_of)
    instants = {"created": F.col("created_at"), "active": last_activity(), "bought": F.col("last_bought")}
    changes = [instants[name] + F.lit(after) for name, after in LIMITS[policy]]
    return F.array_min(F.array(*[F.when(c > now, c) for c in changes]))


def due_index(leads: DataFrame, buyers: DataFrame, as_of: AsOf, policy: str) -> DataFrame:
    """contact_id, phone and due_at of the leads as they are tracked at as_of.

    `buyers` have phone_raw and last_bought of all purchases, also of those that are not recent.
    """
    known = leads.withColumn("_phone", F.nullif("phone", F.lit("")))
    dates = buyers.select("phone_raw", "last_bought")
    joined = lookup(known, dates, "_phone", "phone_raw", spread="contact_id")
    return joined.select("contact_id", "phone", next_change(as_of, policy).alias("due_at"))


def retrack_due(
    leads: DataFrame,
    index: DataFrame,
    buyers: DataFrame,
    changed_phones: DataFrame,
    as_of: AsOf,
    policy: str,
) -> DataFrame:
    """The leads that are due, or whose buyer changed, with their track at as_of.

    `index` is their due_index of an earlier as_of, `changed_phones` (phone_raw) are of buyers
    with orders since then. Leads that were edited since must be given a due_at in the past. All
    other leads keep their track. `buyers` are as in assign_tracks.
    """
    due = index.filter(F.col("due_at") <= as_timestamp(as_of)).select("contact_id")
    moved = changed_phones.filter(F.col("phone_raw").isNotNull()).select(F.col("phone_raw").alias("phone"))
    ids = due.unionByName(index.join(moved, "phone", "left_semi").select("contact_id"))
    touched = leads.join(ids.distinct(), "contact_id", "left_semi")
    return tracks_of(touched, buyers, as_of, policy)


def with_new_tracks(leads: DataFrame, touched: DataFrame) -> DataFrame:
    """All leads, the touched ones with their new track and conversion."""
    new = touched.select(
        F.col("contact_id").alias("_id"), F.col("track").alias("_track"),
        F.col("converted").alias("_converted"), F.lit(True).alias("_touched"),
    )
    joined = lookup(leads.withColumn("_spread", F.xxhash64(*leads.columns)), new, "contact_id", "_id", "_spread")
    return joined.withColumns(
        {c: F.when(F.col("_touched"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("track", "converted")}
    ).select(*leads.columns)
