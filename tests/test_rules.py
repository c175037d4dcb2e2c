"""Segment and track rules at their boundaries."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leadmill.operators import rules
from leadmill.schemas import CUSTOMERS, LEADS, ORDERS
from leadmill.sources.files import conform

NOW = datetime(2024, 6, 30, 12)


def ago(days, **more):
    return NOW - timedelta(days=days, **more)


def table(spark, schema, rows):
    """Rows given as dicts; columns they do not name are NULL."""
    used = [f for f in schema if any(f.name in r for r in rows)]
    values = [tuple(r.get(f.name) for f in used) for r in rows]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in used)
    return conform(spark.createDataFrame(values, ddl), schema)


@pytest.mark.parametrize("orders, last, expected", [
    (4, None, "Loyal"), (3, ago(999), "Returning"), (2, None, "Returning"), (1, ago(90), "New"),
    (1, ago(90, hours=12), "New"), (1, ago(91), "Churn"), (1, None, "Churn"), (0, NOW, "Churn"),
    (None, NOW, "Churn"),
])
def test_segments(spark, orders, last, expected):
    df = table(spark, CUSTOMERS, [{"customer_id": "c", "total_orders": orders,
                                   "last_order_date": last}])
    assert rules.assign_segments(df, NOW).first()["segment"] == expected


def test_refresh_touches_only_the_platform(spark):
    old = {"total_orders": 9, "total_revenue": Decimal(9), "avg_order_value": Decimal(9),
           "last_order_date": ago(1)}
    customers = table(spark, CUSTOMERS, [
        {"customer_id": "a", "last_platform": "mengantar", **old},
        {"customer_id": "b", "last_platform": "orderonline", **old},
        {"customer_id": "c", "last_platform": "mengantar", **old},
    ])
    orders = table(spark, ORDERS, [
        {"order_id": str(i), "customer_id": c, "order_status": s, "net_revenue": Decimal(v),
         "order_date": d}
        for i, (c, s, v, d) in enumerate([
            ("a", "completed", 5, ago(30)), ("a", "completed", 7, ago(40)), ("a", "rts", 9, ago(2)),
            ("b", "completed", 5, ago(3)), (None, "completed", 1, ago(0)),
        ])
    ])
    got = {r["customer_id"]: r for r in rules.refresh_customer_stats(customers, orders).collect()}
    pick = lambda r: (r["total_orders"], r["total_revenue"], r["avg_order_value"],
                      r["last_order_date"])
    assert pick(got["a"]) == (2, 12, 9, ago(2))
    assert pick(got["b"]) == (9, 9, 9, ago(1))
    assert pick(got["c"]) == (0, 0, 9, None)


# Leads by name: phone, pipeline, converted, created, last message.
LEAD_CASES = {
    "blacklisted buyer": ("p90", " Blacklist ", 0, ago(1), ago(1)),
    "bought 90 days ago": ("p90", "Prospect", 0, ago(500), None),
    "bought 91 days ago": ("p91", "Prospect", 0, ago(500), None),
    "bought 365 days ago": ("p365", None, 0, ago(500), ago(400)),
    "bought 366 days ago": ("p366", None, 0, ago(5), ago(5)),
    "bought at an unknown time": ("pnull", None, 0, ago(5), ago(5)),
    "converted": ("none", "Prospect", 1, ago(500), ago(500)),
    "created 14 days ago": (None, "Prospect", 0, ago(14, hours=23), None),
    "created 15 days ago": (None, "Prospect", 0, ago(15), None),
    "talked 90 days ago": ("", "Prospect", 0, ago(500), ago(90, hours=23)),
    "talked 91 days ago": ("none", "Prospect", 0, ago(5), ago(91)),
    "silent since 91 days": ("none", "blacklist", 0, ago(91), None),
    "no dates": ("none", "Prospect", 0, None, None),
}
EXPECTED = {
    "courier_import": {
        "blacklisted buyer": "Arsip", "bought 90 days ago": "T3-Fresh",
        "bought 91 days ago": "T1-Akuisisi", "bought 365 days ago": "T4-Winback",
        "bought 366 days ago": "T2-Nurturing", "bought at an unknown time": "T2-Nurturing",
        "converted": "T4-Winback", "created 14 days ago": "T2-Nurturing",
        "created 15 days ago": "T2-Nurturing", "talked 90 days ago": "T2-Nurturing",
        "talked 91 days ago": "T4-Winback", "silent since 91 days": "T1-Akuisisi",
        "no dates": "T1-Akuisisi",
    },
    "lead_import": {
        "blacklisted buyer": "Arsip", "bought 90 days ago": "T3-Fresh",
        "bought 91 days ago": "T4-Winback", "bought 365 days ago": "T4-Winback",
        "bought 366 days ago": "T1-Akuisisi", "bought at an unknown time": "T1-Akuisisi",
        "converted": "T3-Fresh", "created 14 days ago": "T1-Akuisisi",
        "created 15 days ago": "T2-Nurturing", "talked 90 days ago": "T2-Nurturing",
        "talked 91 days ago": "T1-Akuisisi", "silent since 91 days": "T4-Winback",
        "no dates": "T4-Winback",
    },
    "full_sync": {
        "blacklisted buyer": "Arsip", "bought 90 days ago": "T3-Fresh",
        "bought 91 days ago": "T3-Lama", "bought 365 days ago": "T3-Lama",
        "bought 366 days ago": "T4-Winback", "bought at an unknown time": "T4-Winback",
        "converted": "T3-Fresh", "created 14 days ago": "T1-Akuisisi",
        "created 15 days ago": "T2-Nurturing", "talked 90 days ago": "T2-Nurturing",
        "talked 91 days ago": "T1-Akuisisi", "silent since 91 days": "T4-Winback",
        "no dates": "T4-Winback",
    },
}


@pytest.fixture(scope="module")
def crm(spark):
    bought = {"p90": ago(90), "p91": ago(91), "p365": ago(365, hours=23), "p366": ago(366),
              "pnull": None}
    customers = table(spark, CUSTOMERS, [
        {"customer_id": f"c-{p}", "phone_raw": p} for p in bought
    ] + [{"customer_id": "c-empty", "phone_raw": ""}])
    orders = table(spark, ORDERS, [
        {"order_id": p, "customer_id": f"c-{p}", "order_status": "completed", "order_date": d}
        for p, d in bought.items()
    ] + [
        {"order_id": "e", "customer_id": "c-empty", "order_status": "completed", "order_date": NOW},
        {"order_id": "x", "customer_id": "c-p366", "order_status": "rts", "order_date": NOW},
    ])
    leads = table(spark, LEADS, [
        {"contact_id": name, "phone": p, "pipeline_status": s, "converted": c, "created_at": t,
         "last_message_at": m, "track": "T2-Nurturing"}
        for name, (p, s, c, t, m) in LEAD_CASES.items()
    ])
    return leads, orders, customers


@pytest.mark.parametrize("policy", list(EXPECTED))
def test_tracks(crm, policy):
    rows = rules.assign_tracks(*crm, NOW, policy).collect()
    assert {r["contact_id"]: r["track"] for r in rows} == EXPECTED[policy]
    assert {r["previous_track"] for r in rows} == {"T2-Nurturing"}


def test_courier_import_converts_recent_buyers(crm):
    rows = rules.assign_tracks(*crm, NOW, "courier_import").collect()
    converted = {r["contact_id"] for r in rows if r["converted"] == 1}
    assert converted == {"blacklisted buyer", "bought 90 days ago", "converted"}


def test_track_counts_add_up(crm):
    leads, orders, customers = crm
    tracked = rules.assign_tracks(leads, orders, customers, NOW, "full_sync")
    counts = rules.track_distribution(tracked).agg(F.sum("leads"), F.sum("changed")).first()
    report = rules.track_report(tracked, rules.buyer_last_orders(orders, customers)).first()
    assert counts[0] == report["processed"] == len(LEAD_CASES)
    assert counts[1] == report["updated"] == sum(
        t != "T2-Nurturing" for t in EXPECTED["full_sync"].values()
    )
    assert report["buyers_total"] == 6
