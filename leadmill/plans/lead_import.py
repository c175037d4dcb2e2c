"""Lead import: the export is upserted into the leads by contact id."""

from pyspark.sql import DataFrame, functions as F

from leadmill.functions.phones import lead_phone
from leadmill.functions.text import lead_text, truncate_text
from leadmill.functions.times import as_timestamp, utc_ts
from leadmill.operators.analytics import count_if, count_rows
from leadmill.operators.keyed import first_by, last_by, lookup
from leadmill.operators.rules import AsOf
from leadmill.plans.courier_import import customers_by_phone
from leadmill.schemas import LEAD_HEADINGS, LEAD_TEXT_LIMITS, LEADS
from leadmill.sources.files import conform
from leadmill.sources.staging import stage

TIMES = ["created_at", "last_message_at"]
# Everything but the key, the time of creation and what the import itself derives.
OVERWRITTEN = [c for c in LEAD_HEADINGS if c not in ("contact_id", "created_at")] + [
    "customer_id",
    "converted",
]


def usable_rows(export: DataFrame) -> DataFrame:
    """Raw rows under table column names; columns the export lacks are NULL."""
    short = export.select(
        *[
            (F.col(f"`{heading}`") if heading in export.columns else F.lit(None).cast("string"))
            .alias(name)
            for name, heading in LEAD_HEADINGS.items()
        ],
        "row_no",
    )
    return short.withColumn("contact_id", lead_text(F.col("contact_id"))).filter(
        F.col("contact_id").isNotNull()
    )


def contacts(export: DataFrame, customers: DataFrame) -> DataFrame:
    """One typed row per contact: its last row, with the creation time of its first one.

    The contact is linked to the customer with its phone, unless that customer's id is
    the phone itself.
    """
    rows = usable_rows(export)
    columns = [c for c in LEAD_HEADINGS if c not in ("contact_id", "created_at")]
    reduced = rows.groupBy("contact_id").agg(
        last_by(columns, "row_no").alias("last"),
        first_by(["created_at"], "row_no").alias("first"),
        count_rows().alias("copies"),
    )
    texts = [c for c in columns if c not in ("phone", *TIMES)]

    def text(name: str):
        cleaned = lead_text(F.col(f"last.{name}"))
        limit = LEAD_TEXT_LIMITS.get(name)
        return (truncate_text(cleaned, limit) if limit else cleaned).alias(name)

    clean = reduced.select(
        "contact_id",
        "copies",
        *[text(c) for c in texts],
        lead_phone(F.col("last.phone")).alias("phone"),
        utc_ts(F.col("first.created_at")).alias("created_at"),
        utc_ts(F.col("last.last_message_at")).alias("last_message_at"),
    )
    matched = lookup(clean, customers_by_phone(customers), "phone", "phone_raw", "contact_id")
    found = F.nullif(F.col("stored.customer_id"), F.col("phone"))
    return matched.withColumns(
        {"customer_id": found, "converted": F.when(found.isNotNull(), 1).otherwise(0)}
    ).drop("stored")


def upsert_leads(
    export: DataFrame, leads: DataFrame, customers: DataFrame, as_of: AsOf
) -> DataFrame:
    """All leads after the import; `export` has an orderable `row_no`."""
    return merged_leads(leads, stage(contacts(export, customers), "contacts"), as_of)


def merged_leads(leads: DataFrame, incoming: DataFrame, as_of: AsOf) -> DataFrame:
    """Leads after `contacts` were upserted.

    A stored lead keeps its creation time and track. Only a row that met a lead, stored
    or from an earlier row of the file, sets updated_at. Stored leads without a contact id match
    nothing and are spread over all tasks; new contacts come from an anti join, so that nothing
    needs a full outer join.
    """
    stored = conform(leads, LEADS).withColumn("_spread", F.xxhash64(*LEADS.names))
    new = incoming.select(*[F.col(c).alias(f"n_{c}") for c in incoming.columns])
    in_file = F.col("n_copies").isNotNull()
    changes = {c: F.when(in_file, F.col(f"n_{c}")).otherwise(F.col(c)) for c in OVERWRITTEN}
    changes["updated_at"] = F.when(in_file, as_timestamp(as_of)).otherwise(F.col("updated_at"))
    kept = lookup(stored, new, "contact_id", "n_contact_id", spread="_spread").withColumns(changes)
    known = leads.filter(F.col("contact_id").isNotNull()).select("contact_id")
    repeated = F.when(F.col("copies") > 1, as_timestamp(as_of))
    added = incoming.join(known, "contact_id", "left_anti").withColumn("updated_at", repeated)
    return kept.select(*LEADS.names).unionByName(conform(added, LEADS))


def lead_import_report(export: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: contacts inserted, rows that updated a lead, and both together."""
    rows = usable_rows(export).groupBy("contact_id").agg(count_rows().alias("copies"))
    return contacts_report(rows, leads)


def contacts_report(incoming: DataFrame, leads: DataFrame) -> DataFrame:
    """lead_import_report of `contacts`, so that the export need not be read again."""
    known = leads.groupBy(F.col("contact_id").alias("known_id")).agg(F.lit(True).alias("stored"))
    joined = incoming.join(known, F.col("contact_id") == F.col("known_id"), "left")
    return joined.agg(
        count_if(F.col("stored").isNull()).alias("inserted"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"),
    ).select("inserted", (F.col("total") - F.col("inserted")).alias("updated"), "total")
