"""What Spark makes of the queries."""

import re

import pytest
from pyspark.sql import functions as F

from leadmill.operators import analytics, rules, views
from leadmill.operators.customer_state import customer_state
from leadmill.plans.courier_import import CourierImport, classified_rows, fresh_rows, phone_book
from leadmill.schemas import CUSTOMERS, LEADS, ORDER_ITEMS, ORDERS
from leadmill.sources.files import conform, load_table, reload_table
from leadmill.sources.staging import stage
from workload.model import Model
from workload.queries import QUERIES, bind


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(name, spark, sf_dir):
    text = plan(bind(QUERIES[name])(spark, sf_dir))
    assert not re.search(r"Python|Pandas|CartesianProduct|NestedLoop", text)
    assert "Window" not in text


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The model as Parquet tables, as the library meets it in use."""
    m = Model(spark, sf_dir)
    folder = tmp_path_factory.mktemp("tables")
    tables = {}
    for name, df, schema in [("orders", m.orders, ORDERS), ("items", m.items, ORDER_ITEMS),
                             ("customers", m.customers, CUSTOMERS), ("leads", m.leads, LEADS)]:
        reload_table(conform(df, schema), f"{folder}/{name}")
        tables[name] = load_table(spark, f"{folder}/{name}", schema)
    return tables


def scans(df):
    """(pushed filters, read columns) of every scan of the plan."""
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", formatted(df))


def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    ).replace("\n", ", ")


def test_completed_filter_reaches_the_scan(stored):
    (scan,) = scans(analytics.order_kpis(stored["orders"]))
    assert "EqualTo(order_status,completed)" in scan[0]
    assert set(re.findall(r"(\w+):", scan[1])) == {
        "order_status", "net_revenue", "shipping_cost", "seller_shipping_discount",
    }


def test_date_range_reaches_the_scan(stored):
    df = analytics.revenue_by_period(stored["orders"], "day", "1998-01-01", "1999-01-01")
    assert "GreaterThanOrEqual(order_date" in scans(df)[0][0]
    assert "LessThanOrEqual(order_date" in scans(df)[0][0]


def test_search_by_phone_reaches_the_scan(stored):
    df = views.list_customers(stored["customers"], search="0800-0000-01")
    assert "StringStartsWith(customer_id,62800000001)" in scans(df)[0][0]


def test_window_of_months_reaches_the_scan(stored):
    df = analytics.monthly_new_vs_repeat(stored["orders"], stored["customers"], "2001-08-02")
    pushed = [p for p, _ in scans(df)]
    assert any("GreaterThanOrEqual(order_date,1999-08-02" in p for p in pushed)


def test_statistics_need_one_shuffle_per_table(stored):
    df = rules.refresh_customer_stats(stored["customers"], stored["orders"])
    assert plan(df).count("Exchange hashpartitioning(customer_id") <= 2


def test_top_lists_are_not_sorted_in_full(stored):
    assert "TakeOrderedAndProject" in plan(analytics.top_provinces(stored["customers"]))
    assert "TakeOrderedAndProject" in plan(views.list_orders(stored["orders"], page=3))


def test_one_customer_reads_only_the_needed_orders(stored):
    df = views.customer_360(
        stored["customers"], stored["orders"], stored["items"], customer_ids=["628000000001"]
    )
    # What is written in between holds orders of that customer alone.
    pushed = [p for p, columns in scans(df) if "customer_id:" in columns and "_row:" not in columns]
    assert pushed and all("628000000001" in p for p in pushed)
    assert df.select(F.size("orders")).first()[0] > 0


@pytest.fixture()
def no_broadcast(spark):
    """Plans as on tables that are too large to be broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture()
def steps(monkeypatch):
    """Plans of the tables that are written on the way."""
    from leadmill.operators import keyed

    found = []

    def noted(df, *args):
        found.append(plan(df))
        return stage(df, *args)

    monkeypatch.setattr(keyed, "stage", noted)
    monkeypatch.setattr(views, "stage", noted)
    return found


def scanned(text):
    return text.count("FileScan")


def exchanges(text):
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?!SinglePartition)", text))


def test_documents_read_little_twice(stored, no_broadcast, steps):
    text = plan(views.customer_360(stored["customers"], stored["orders"], stored["items"]))
    assert scanned(text) <= 8 and exchanges(text) <= 12
    assert sum(map(exchanges, [text, *steps])) <= 20
    assert all(scanned(s) <= 6 for s in steps)


def test_short_lists_move_once(stored, no_broadcast, steps):
    text = plan(views.customer_360(stored["customers"], stored["orders"], stored["items"]))
    # Only keys of long lists are written on the way, and there are none.
    assert len(steps) == 2 and not any("_value" in s for s in steps)
    assert scanned(text) <= 4 and exchanges(text) <= 5


def test_lookups_read_little_twice(stored, no_broadcast, steps, spark, sf_dir):
    phones = Model(spark, sf_dir).messy_phones
    df = views.phone_lookup_orders(
        phones, stored["customers"], stored["orders"], stored["items"], "row_id"
    )
    assert scanned(plan(df)) <= 10 and all(scanned(s) <= 10 for s in steps)


def test_an_import_on_a_state_reads_only_ids_of_old_orders(stored, no_broadcast, spark, sf_dir, tmp_path):
    m = Model(spark, sf_dir)
    reload_table(customer_state(stored["orders"]), f"{tmp_path}/state")
    reload_table(m.courier_export, f"{tmp_path}/export")
    done = CourierImport(
        load_table(spark, f"{tmp_path}/export"), stored["customers"], stored["orders"],
        stored["leads"], "2001-08-02", str(tmp_path), load_table(spark, f"{tmp_path}/state"),
    )
    fresh = fresh_rows(classified_rows(done.raw, stored["orders"]))
    assert exchanges(plan(fresh)) <= 2 and plan(fresh).count("FileScan") == 2
    of_orders = [c for _, c in scans(fresh) if "source_platform:" in c]
    assert of_orders == ["order_id:string,source_platform:string"]
    assert exchanges(plan(phone_book(done.fresh, stored["customers"]))) <= 2
    for df in (done.customers, done.leads, done.state, done.report):
        assert exchanges(plan(df)) <= 12
        assert not [c for _, c in scans(df) if "order_status:" in c or "Last Status" in c]
