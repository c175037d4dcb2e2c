"""Imports as small scenarios."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leadmill.operators.customer_state import customer_state, merge_states
from leadmill.plans import courier_import, lead_import, lead_patches
from leadmill.schemas import COURIER_HEADINGS, CUSTOMERS, LEAD_HEADINGS, LEADS, ORDER_ITEMS, ORDERS
from leadmill.sources.files import append_table, load_table
from tests.test_rules import table

NOW = datetime(2024, 6, 30, 12)


def export(spark, headings, rows):
    """Export rows from dicts of short names, numbered in order."""
    ddl = "row_no bigint, " + ", ".join(f"`{h}` string" for h in headings.values())
    values = [(i, *[r.get(c) for c in headings]) for i, r in enumerate(rows)]
    return spark.createDataFrame(values, ddl)


def courier(spark, *rows):
    base = {"last_status": "Delivered", "create_date": "01-06-2024 08:00", "quantity": "2",
            "product_value": "100", "shipping_fee": "10", "cod": "0", "goods": "Nest"}
    return export(spark, COURIER_HEADINGS, [{**base, **r} for r in rows])


@pytest.fixture(scope="module")
def stored(spark):
    customers = table(spark, CUSTOMERS, [
        {"customer_id": "C1", "phone_raw": "62811", "name": None, "last_platform": "orderonline",
         "total_orders": 7, "total_revenue": Decimal(700)},
        {"customer_id": "C2", "phone_raw": "62811", "name": "Second", "total_orders": 0},
        {"customer_id": "62822", "phone_raw": None, "name": "Id only", "total_orders": 1,
         "last_platform": "mengantar"},
        {"customer_id": "62833", "phone_raw": "62833", "name": "Own phone", "total_orders": 0},
    ])
    orders = table(spark, ORDERS, [
        {"order_id": "OLD", "source_platform": "mengantar", "customer_id": "C1",
         "order_status": "completed", "net_revenue": Decimal(5)},
        {"order_id": "A1", "source_platform": "orderonline", "customer_id": "C1"},
    ])
    leads = table(spark, LEADS, [
        {"contact_id": "L1", "phone": "62811", "converted": 0, "created_at": datetime(2020, 1, 1)},
        {"contact_id": "L2", "phone": "62811", "converted": 1, "customer_id": "X"},
        {"contact_id": "L3", "phone": "62899", "converted": 0},
        {"contact_id": "L4", "phone": None, "converted": 0},
        {"contact_id": "L5", "phone": "62811", "converted": None},
    ])
    return customers, orders, leads


@pytest.fixture(scope="module")
def raw(spark):
    return courier(
        spark,
        {"order_id": "'A1", "phone": "'0811", "name": "ignored"},
        {"order_id": "A1", "phone": "0877", "name": "in-file repeat"},
        {"order_id": "OLD", "phone": "0888", "name": "known order"},
        {"order_id": " ", "phone": "0866", "name": "no id"},
        {"order_id": "A2", "phone": "899", "name": "First", "city": "'Jambi", "last_status": "RTS"},
        {"order_id": "A3", "phone": "62 8-99", "name": "Later", "goods": "a, b,,c",
         "quantity": "", "product_value": "50.9"},
        {"order_id": "A4", "phone": "", "name": "Nobody", "goods": "", "cod": "5",
         "create_date": "bad"},
        {"order_id": "A5", "phone": "0822", "name": "Id taken"},
    )


@pytest.fixture(scope="module")
def imported(raw, stored):
    customers, orders, leads = stored
    return courier_import.CourierImport(raw, customers, orders, leads, NOW)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_new_orders(imported):
    got = by(imported.new_orders, "order_id")
    assert {k: (r["customer_id"], r["customer_name"]) for k, r in got.items()} == {
        "A1": ("C1", None), "A2": ("62899", "First"), "A3": ("62899", "First"),
        "A4": (None, "Nobody"), "A5": ("62822", "Id taken"),
    }
    assert (got["A3"]["total_qty"], got["A3"]["net_revenue"]) == (1, 50)
    assert (got["A4"]["payment_method"], got["A4"]["order_date"]) == ("COD", None)
    assert {r["source_platform"] for r in got.values()} == {"mengantar"}


def test_new_items(imported):
    rows = imported.new_items.select("order_id", "item_id", "product_raw", "qty_item").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("A1", 0, "Nest", 1), ("A2", 0, "Nest", 1), ("A3", 0, "a", 1), ("A3", 1, "b", 1),
        ("A3", 2, "c", 1), ("A4", 0, "Unknown", 1), ("A5", 0, "Nest", 1),
    ]


def test_unknown_phone_makes_one_customer(imported):
    (new,) = imported.new_customers.collect()
    assert (new["customer_id"], new["name"], new["city"]) == ("62899", "First", "Jambi")
    assert (new["segment"], new["total_orders"], new["total_revenue"]) == ("New", 1, 100)


def test_customers_after(imported):
    got = by(imported.customers, "customer_id")
    assert set(got) == {"C1", "C2", "62822", "62833", "62899"}
    # One of the new customer's two orders was delivered; its first value stays the average.
    new = got["62899"]
    assert (new["total_orders"], new["total_revenue"], new["avg_order_value"]) == (1, 50, 100)
    assert new["segment"] == "New"
    # A customer of another channel is not recounted, but everybody is segmented.
    assert (got["C1"]["total_orders"], got["C1"]["segment"]) == (7, "Loyal")
    assert (got["62822"]["total_orders"], got["62822"]["segment"]) == (1, "New")
    assert got["62833"]["segment"] == "Churn"


def test_leads_after(imported):
    got = {k: (r["converted"], r["customer_id"], r["track"])
           for k, r in by(imported.leads, "contact_id").items()}
    assert got == {
        "L1": (1, "C1", "T3-Fresh"), "L2": (1, "X", "T3-Fresh"), "L3": (1, "62899", "T3-Fresh"),
        "L4": (0, None, "T1-Akuisisi"), "L5": (None, None, "T3-Fresh"),
    }


def test_report(imported, raw, stored, tmp_path):
    want = {"inserted": 5, "skipped_duplicate": 2, "leads_synced": 2}
    assert imported.report.first().asDict() == want
    # Counted on the way, where the fresh rows are written once.
    customers, orders, leads = stored
    written = courier_import.CourierImport(raw, customers, orders, leads, NOW, str(tmp_path))
    assert written.report.first().asDict() == want
    nothing = courier_import.CourierImport(raw.limit(0), customers, orders, leads, NOW, str(tmp_path))
    assert nothing.report.first().asDict() == dict.fromkeys(want, 0)


def test_import_on_a_stored_state(raw, stored, imported):
    customers, orders, leads = stored
    on_state = courier_import.CourierImport(
        raw, customers, orders, leads, NOW, state=customer_state(orders)
    )
    assert by(on_state.customers, "customer_id") == by(imported.customers, "customer_id")
    assert by(on_state.leads, "contact_id") == by(imported.leads, "contact_id")
    # The merged state is the state of all orders.
    recounted = customer_state(imported.orders.select(orders.columns))
    assert by(on_state.state, "customer_id") == by(recounted, "customer_id")


def test_states_add_up(spark, stored):
    _, orders, _ = stored
    rows = table(spark, ORDERS, [
        {"order_id": f"S{i}", "customer_id": [None, "C1", "C9"][i % 3],
         "order_status": ["completed", "rts"][i % 2], "net_revenue": Decimal(i),
         "order_date": None if i % 5 == 0 else datetime(2024, 1, 1 + i)}
        for i in range(20)
    ])
    whole = by(customer_state(orders.unionByName(rows)), "customer_id")
    parts = [customer_state(x) for x in (orders, rows.limit(0), rows.filter("order_id < 'S15'"),
                                         rows.filter("order_id >= 'S15'"))]
    assert by(merge_states(*parts), "customer_id") == whole
    assert None not in whole and whole["C9"]["completed_orders"] == 3


def test_second_import_inserts_nothing(spark, raw, stored, tmp_path):
    customers, orders, leads = stored
    tables, new, stage = (str(tmp_path / d) for d in ("tables", "new", "stage"))
    append_table(orders, f"{tables}/orders")
    before = load_table(spark, f"{tables}/orders", ORDERS)
    first = courier_import.CourierImport(raw, customers, before, leads, NOW, stage)
    first.save(tables, new)
    assert load_table(spark, f"{new}/customers", CUSTOMERS).count() == 5
    assert load_table(spark, f"{tables}/order_items", ORDER_ITEMS).count() == 7
    after = load_table(spark, f"{tables}/orders", ORDERS)
    assert after.count() == 7
    second = courier_import.CourierImport(
        raw, load_table(spark, f"{new}/customers", CUSTOMERS), after,
        load_table(spark, f"{new}/leads", LEADS), NOW,
    )
    assert second.report.first().asDict() == {
        "inserted": 0, "skipped_duplicate": 7, "leads_synced": 0,
    }
    assert second.new_customers.count() == 0


@pytest.mark.parametrize("layout", [[], ["source_platform"]])
def test_failed_save_can_be_retried(spark, raw, stored, tmp_path, monkeypatch, layout):
    customers, orders, leads = stored
    tables, new, stage = (str(tmp_path / d) for d in ("tables", "new", "stage"))
    append_table(orders, f"{tables}/orders", layout)
    before = load_table(spark, f"{tables}/orders", ORDERS)
    real, calls = courier_import.append_table, []

    def failing(df, path, *args):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("no more room")
        real(df, path, *args)

    monkeypatch.setattr(courier_import, "append_table", failing)
    with pytest.raises(OSError):
        courier_import.CourierImport(raw, customers, before, leads, NOW, stage).save(tables, new)
    courier_import.CourierImport(raw, customers, before, leads, NOW, stage).save(tables, new)
    assert load_table(spark, f"{tables}/order_items", ORDER_ITEMS).count() == 7
    assert load_table(spark, f"{tables}/orders", ORDERS).count() == 7
    # The second run removed its staged tables, the failed one left its own.
    assert len(list((tmp_path / "stage").iterdir())) == 2


@pytest.mark.parametrize("gone", ["Shipping Fee", "Product Value", "COD", "Province"])
def test_export_without_a_heading(raw, stored, gone):
    from leadmill.schemas import COURIER_HEADINGS

    names = [h for h in COURIER_HEADINGS.values() if h.lower() == gone.lower()] or [
        list(COURIER_HEADINGS.values())[-1]
    ]
    done = courier_import.CourierImport(raw.drop(*names), *stored, NOW)
    assert done.new_orders.count() == 5


def test_saving_needs_a_stage(imported, tmp_path):
    with pytest.raises(ValueError):
        imported.save(str(tmp_path), str(tmp_path))


def test_inserted_and_skipped_are_all_usable_rows(imported, raw):
    row = imported.report.first()
    usable = courier_import.usable_rows(raw).count()
    assert row["inserted"] + row["skipped_duplicate"] == usable


def test_lead_upsert(spark, stored):
    customers, _, leads = stored
    rows = export(spark, LEAD_HEADINGS, [
        {"contact_id": "L1", "phone": "62833.0", "name": "Renamed", "created_at": "2024-01-01"},
        {"contact_id": "N1", "phone": "62811", "name": "Old", "created_at": "2024-02-01T07:00+07:00"},
        {"contact_id": "N1", "phone": "62811", "name": "None", "created_at": "2024-03-01",
         "label_names": "x" * 60},
        {"contact_id": "N2", "phone": "n/a", "created_at": "2024-04-01"},
        {"contact_id": "nan", "phone": "1"},
    ])
    got = by(lead_import.upsert_leads(rows, leads, customers, NOW), "contact_id")
    assert set(got) == {"L1", "L2", "L3", "L4", "L5", "N1", "N2"}
    # The matched customer's id is the phone itself, so the match does not count.
    old = got["L1"]
    assert (old["name"], old["phone"], old["customer_id"], old["converted"]) == (
        "Renamed", "62833", None, 0,
    )
    assert (old["created_at"], old["updated_at"]) == (datetime(2020, 1, 1), NOW)
    new = got["N1"]
    assert (new["name"], new["customer_id"], new["converted"]) == (None, "C1", 1)
    assert (new["created_at"], new["updated_at"]) == (datetime(2024, 2, 1), NOW)
    assert new["label_names"] == "x" * 50
    assert (got["N2"]["phone"], got["N2"]["updated_at"]) == (None, None)
    assert (got["L2"]["converted"], got["L2"]["customer_id"]) == (1, "X")
    assert lead_import.lead_import_report(rows, leads).first().asDict() == {
        "inserted": 2, "updated": 2, "total": 4,
    }


def test_lead_export_may_lack_columns(spark, stored):
    customers, _, leads = stored
    rows = spark.createDataFrame([(1, "L4", "New name")],
                                 "row_no int, contact_id string, display_name string")
    got = by(lead_import.upsert_leads(rows, leads, customers, NOW), "contact_id")
    assert (got["L4"]["name"], got["L4"]["phone"], got["L4"]["note"]) == ("New name", None, None)


def test_patches(spark, stored):
    leads = stored[2].withColumns({"note": F.lit("old"), "kota": F.lit("old")})
    patches = spark.createDataFrame(
        [("L1", 2, {"note": "second"}), ("L1", 1, {"note": "first", "kota": "Medan"}),
         ("L2", 1, {"note": None}), ("L3", 1, {"phone": "1", "converted": "1"}),
         ("L4", 1, {}), ("gone", 1, {"note": "x"})],
        "contact_id string, patch_no int, fields map<string,string>",
    )
    got = by(lead_patches.apply_lead_patches(leads, patches, NOW), "contact_id")
    pick = lambda r: (r["note"], r["kota"], r["updated_at"])
    assert pick(got["L1"]) == ("second", "Medan", NOW)
    assert pick(got["L2"]) == (None, "old", NOW)
    assert pick(got["L3"]) == pick(got["L4"]) == ("old", "old", None)
    assert got["L3"]["phone"] == "62899" and "gone" not in got
    assert lead_patches.patch_report(patches).first().asDict() == {"accepted": 4, "rejected": 2}
