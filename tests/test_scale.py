"""Rollups, due leads, trigram search and clustered files against the plain way."""

from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leadmill.operators import analytics, due, filters, rollup, rules, search
from leadmill.schemas import CUSTOMERS, DAILY_SALES, LEADS, ORDERS
from leadmill.sources import clustered
from leadmill.sources.files import conform, load_table
from leadmill.sources.store import Buckets, Merge, TableStore
from tests.test_rules import table
from workload.compare import spark_rows
from workload.model import Model


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return Model(spark, sf_dir)


def same(a, b):
    return spark_rows(a)[2] == spark_rows(b)[2]


def test_late_orders_change_only_their_days(model, spark, tmp_path):
    orders, customers = model.orders, model.customers
    s = TableStore(spark, str(tmp_path / "store"), {"daily": Buckets("day", 128)})
    last = orders.filter("order_status = 'completed'").agg(F.max(F.to_date("order_date"))).first()[0]
    late = F.to_date("order_date") >= last
    s.commit("load", {"daily": rollup.daily_sales(orders.filter(~late), customers)})
    before = s.snapshot().tables["daily"]
    delta = rollup.daily_sales(orders.filter(late), customers)
    change = Merge(delta, DAILY_SALES, rollup.merge_days)
    assert s.commit("late", merge={"daily": change}) and not s.commit("late", merge={"daily": change})
    after = s.snapshot().tables["daily"]
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2
    daily = s.read("daily", DAILY_SALES)
    assert same(daily, rollup.daily_sales(orders, customers))
    for period in ("day", "week", "month", "other"):
        assert same(rollup.revenue_from_days(daily, period), analytics.revenue_by_period(orders, period))
    with pytest.raises(Exception, match="midnight"):
        rollup.monthly_from_days(daily, "2001-08-02 12:00:00").collect()


def test_days_of_odd_orders(spark):
    orders = table(spark, ORDERS, [
        {"order_id": "1", "order_status": "completed", "customer_id": None, "order_date": None, "total_qty": 1},
        {"order_id": "2", "order_status": "completed", "customer_id": "A", "order_date": datetime(2024, 1, 1, 23)},
        {"order_id": "3", "order_status": "rts", "customer_id": "A", "order_date": datetime(2024, 1, 1)},
    ])
    customers = table(spark, CUSTOMERS, [{"customer_id": "A", "first_order_date": datetime(2024, 1, 1)}])
    daily = rollup.daily_sales(orders, customers)
    assert same(rollup.revenue_from_days(daily, "day"), analytics.revenue_by_period(orders, "day"))
    assert rollup.merge_days(daily.limit(0)).count() == 0


@pytest.mark.parametrize("policy", ["full_sync", "lead_import", "courier_import"])
@pytest.mark.parametrize("days", [1, 15, 91, 400])
def test_due_leads_give_what_all_leads_give(spark, policy, days):
    start = datetime(2024, 6, 1)
    as_of = start + timedelta(days=days)
    leads = table(spark, LEADS, [
        {"contact_id": f"L{i}", "phone": [None, "", f"62{i}"][min(i % 5, 2)], "converted": i % 2,
         "created_at": start - timedelta(days=i * 7 % 120, hours=i), "pipeline_status": "Blacklist" if i % 11 == 0 else None,
         "last_message_at": None if i % 3 else start - timedelta(days=i % 100)}
        for i in range(120)
    ])
    customers = table(spark, CUSTOMERS, [{"customer_id": f"C{i}", "phone_raw": f"62{i}"} for i in range(80)])
    orders = table(spark, ORDERS, [
        {"order_id": f"{i}-{k}", "customer_id": f"C{i}", "order_status": "completed" if i % 7 else "rts",
         "order_date": start - timedelta(days=(i * 13) % 400) + timedelta(days=k * 380, minutes=i)}
        for i in range(60) for k in (0, 1)
    ])
    old = orders.filter(F.col("order_date") < start)
    since = orders.filter((F.col("order_date") >= start) & (F.col("order_date") < as_of))
    known = orders.filter(F.col("order_date") < as_of)
    tracked = rules.assign_tracks(leads, old, customers, start, policy).drop("previous_track")
    index = due.due_index(tracked, rules.buyer_last_orders(old, customers), start, policy)
    limit = rules.POLICIES[policy][1]
    from leadmill.functions.times import days_before
    recent = None if limit is None else days_before(as_of, limit)
    touched = due.retrack_due(
        tracked, index, rules.buyer_last_orders(known, customers, recent),
        rules.buyer_last_orders(since, customers), as_of, policy,
    )
    got = due.with_new_tracks(tracked, touched)
    want = rules.assign_tracks(tracked, known, customers, as_of, policy).drop("previous_track")
    assert same(got.select("contact_id", "converted", "track"), want.select("contact_id", "converted", "track"))
    if days <= 15:
        assert touched.count() < 60


@pytest.mark.parametrize("wanted", [
    {"search": "mer#0000001"}, {"search": "MER#%12"}, {"search": "0_1"}, {"search": "0800-0000-01"},
    {"province": "asi"}, {"search": "no such name"}, {"search": "ab"}, {"search": "a\\#b"},
    {"search": "#00000014", "province": "EUROPE"},
])
def test_trigram_search_equals_like(model, spark, tmp_path, wanted):
    how = Buckets("customer_id", 32)
    s = TableStore(spark, str(tmp_path / "s"), {"customers": how})
    s.commit("load", {"customers": conform(model.customers, CUSTOMERS)})
    stored = s.read("customers", CUSTOMERS)
    index = search.trigram_index(stored, ["name", "province", "customer_id"], how.of(stored))
    only = search.candidate_buckets(index, search.customer_patterns(stored, **wanted))
    near = s.read("customers", CUSTOMERS, only=only)
    assert same(filters.filter_customers(near, **wanted), filters.filter_customers(stored, **wanted))
    if wanted == {"search": "no such name"}:
        assert only == set()
    if wanted.get("search") == "#00000014":
        assert len(near.inputFiles()) < len(stored.inputFiles()) / 2
    if wanted == {"search": "ab"}:
        assert only is None


def test_both_filters_skip_files_of_a_clustered_table(model, spark, tmp_path):
    orders = conform(model.orders, ORDERS)
    clustered.write_clustered(orders, str(tmp_path / "o"), "order_date", "customer_id", 36)
    stored = load_table(spark, str(tmp_path / "o"), ORDERS)
    assert same(stored, orders)

    def files(column, low, high):
        """Files whose statistics let them hold such values."""
        found = total = 0
        for path in (tmp_path / "o").glob("*.parquet"):
            meta = pq.ParquetFile(path).metadata
            at = meta.schema.names.index(column)
            groups = [meta.row_group(k).column(at).statistics for k in range(meta.num_row_groups)]
            total += 1
            found += any(g.min <= high and g.max >= low for g in groups)
        return found, total

    found, total = files("order_date", datetime(1998, 3, 1), datetime(1998, 3, 31))
    assert total >= 30 and found <= total / 3
    one = orders.filter("customer_id IS NOT NULL").agg(F.max("customer_id")).first()[0]
    found, total = files("customer_id", one, one)
    assert found <= total / 3


def test_clustering_odd_tables(spark, tmp_path):
    rows = [(None, None)] * 5 + [(datetime(2024, 1, 1), "a")] * 50 + [(None, "b"), (datetime(2025, 1, 1), None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, k string")
    clustered.write_clustered(df, str(tmp_path / "a"), "t", "k", 4)
    assert same(load_table(spark, str(tmp_path / "a")), df)
    clustered.write_clustered(df.limit(0), str(tmp_path / "b"), "t", "k", 4)
    assert load_table(spark, str(tmp_path / "b"), df.schema).count() == 0
