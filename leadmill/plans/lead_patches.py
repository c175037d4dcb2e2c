"""Edits of single leads, applied as a batch."""

from pyspark.sql import DataFrame, functions as F

from leadmill.functions.times import as_timestamp
from leadmill.operators.analytics import count_if
from leadmill.operators.keyed import last_by
from leadmill.operators.rules import AsOf
from leadmill.schemas import PATCHABLE_LEAD_FIELDS


def valid_patches(patches: DataFrame) -> DataFrame:
    """`fields` (map of text to text) cut down to the fields that may be edited."""
    kept = F.map_filter("fields", lambda k, _: k.isin(PATCHABLE_LEAD_FIELDS))
    return patches.withColumn("fields", kept)


def patch_report(patches: DataFrame) -> DataFrame:
    """One row: patches accepted, and patches rejected because no field may be edited."""
    size = F.size("fields")
    return valid_patches(patches).agg(
        count_if(size > 0).alias("accepted"), count_if(size <= 0).alias("rejected")
    )


def apply_lead_patches(leads: DataFrame, patches: DataFrame, as_of: AsOf) -> DataFrame:
    """Leads after patches (contact_id, patch_no, fields) applied in patch_no order.

    Only supplied fields change; a supplied NULL clears the field. Per lead and field
    only the last patch that supplies it matters.
    """
    usable = valid_patches(patches).filter(F.size("fields") > 0)
    values = usable.select(
        F.col("contact_id").alias("patched_id"),
        "patch_no",
        "fields",
        *[F.try_element_at("fields", F.lit(f)).alias(f) for f in PATCHABLE_LEAD_FIELDS],
    )
    merged = values.groupBy("patched_id").agg(
        *[
            last_by([f], "patch_no", F.map_contains_key("fields", f)).alias(f"new_{f}")
            for f in PATCHABLE_LEAD_FIELDS
        ]
    )
    joined = leads.join(merged, F.col("contact_id") == F.col("patched_id"), "left")
    changes = {
        f: F.when(F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}.{f}")).otherwise(F.col(f))
        for f in PATCHABLE_LEAD_FIELDS
        if f in leads.columns
    }
    changes["updated_at"] = F.when(
        F.col("patched_id").isNotNull(), as_timestamp(as_of)
    ).otherwise(F.col("updated_at"))
    return joined.withColumns(changes).select(*leads.columns)
