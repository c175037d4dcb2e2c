"""Joins and lists stay whole when some keys are hot."""

from pyspark.sql import functions as F
import pytest

from leadmill.operators import keyed, paging, views
from workload.compare import spark_rows
from workload.model import Model


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    """A model in which one order has a third of all items and one customer a third of
    all orders."""
    m = Model(spark, sf_dir)
    orders = m.orders.withColumn(
        "customer_id",
        F.when(F.xxhash64("order_id") % 3 == 0, "628000000001").otherwise(F.col("customer_id")),
    )
    heavy = F.xxhash64("item_id", "order_id") % 3 == 0
    items = m.items.withColumns(
        {
            "order_id": F.when(heavy, "5").otherwise(F.col("order_id")),
            "source_platform": F.when(heavy, "mengantar").otherwise(F.col("source_platform")),
            # Unique in the hot order too.
            "item_id": F.xxhash64("item_id", "order_id"),
            "is_parent_row": F.lit(1),
        }
    )
    return m.customers, orders.cache(), items.cache()


def test_lookup_keeps_rows_without_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, None)], "id int, k string")
    right = spark.createDataFrame([("a", 10), ("b", 20)], "key string, v int")
    got = keyed.lookup(left, right, "k", "key", spread="id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 10), (2, None, None), (3, "z", None),
                                       (4, None, None)]


def test_first_and_last_row_per_key(spark):
    df = spark.createDataFrame(
        [("a", 2, "x", None), ("a", 1, None, "p"), ("a", 3, "y", "q"), ("b", 9, "z", None)],
        "k string, n int, v string, `odd name` string",
    )
    got = df.groupBy("k").agg(
        keyed.first_by(["v", "odd name"], "n").alias("f"),
        keyed.last_by(["v"], "n", F.col("n") < 3).alias("l"),
    ).orderBy("k").collect()
    assert [tuple(r["f"]) for r in got] == [(None, "p"), ("z", None)]
    assert [r["l"] and r["l"]["v"] for r in got] == ["x", None]


def test_product_lists_of_hot_orders_are_cut_but_whole(skewed):
    _, orders, items = skewed
    whole = views.orders_with_product_list(orders, items)
    cut = views.orders_with_product_list(orders, items, piece_rows=50)
    longest = cut.agg(F.max(F.size(F.split("products", ", ")))).first()[0]
    assert longest <= 50
    assert cut.filter("part > 0").count() > 10
    merged = (
        cut.groupBy("order_id", "source_platform")
        .agg(F.sort_array(F.collect_list(F.struct("part", "products"))).alias("p"))
        .select("order_id", "source_platform",
                F.array_join(F.col("p.products"), ", ").alias("products"))
    )
    expected = whole.select("order_id", "source_platform",
                            F.coalesce("products", F.lit("")).alias("products"))
    assert spark_rows(merged)[2] == spark_rows(expected)[2]


def flat(documents):
    orders = documents.select("customer_id", "order_count", F.explode_outer("orders").alias("o"))
    rows = orders.select("customer_id", "order_count", "o.*",
                         F.explode_outer("o.items").alias("i"))
    return rows.select("customer_id", "order_count", "order_id", "i.product_raw", "i.qty_item")


def test_customer_documents_with_hot_keys(skewed):
    whole = views.customer_360(*skewed)
    cut = views.customer_360(*skewed, piece_rows=20, item_piece_rows=20)
    assert cut.agg(F.max(F.size("orders"))).first()[0] <= 20
    inner = cut.select(F.explode("orders").alias("o")).agg(F.max(F.size("o.items")))
    assert inner.first()[0] <= 20
    assert cut.filter("part > 0").count() > 5
    assert spark_rows(flat(cut))[2] == spark_rows(flat(whole))[2]


def test_documents_list_newest_orders_first(skewed):
    rows = views.customer_360(*skewed).select(
        F.expr("transform(orders, o -> o.order_date)").alias("dates")
    ).collect()
    assert all(r["dates"] is None or r["dates"] == sorted(r["dates"], reverse=True) for r in rows)


def test_documents_of_some_customers(skewed):
    ids = ["628000000001", "628000000002"]
    some = views.customer_360(*skewed, customer_ids=ids)
    expected = views.customer_360(*skewed).filter(F.col("customer_id").isin(ids))
    assert spark_rows(flat(some))[2] == spark_rows(flat(expected))[2]


def test_left_join_to_many(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    many = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3), (None, 4)], "k string, w int")
    got = keyed.join_many(one, many, ["k"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, one.join(many, "k", "left").collect()))


def test_pieces_do_not_depend_on_partitions(skewed, spark):
    _, orders, items = skewed
    found = []
    for n in ("2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(spark_rows(views.orders_with_product_list(orders, items, piece_rows=7))[2])
    assert found[0] == found[1]
    parts = [r["part"] for r in views.orders_with_product_list(orders, items, piece_rows=7)
             .filter("order_id = '5' and source_platform = 'mengantar'").select("part").collect()]
    assert sorted(parts) == list(range(len(parts))) and len(parts) > 10


@pytest.mark.parametrize("sort", ["order_date", "customer_name", "net_revenue"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_by_histograms_equal_sorted_rows(skewed, monkeypatch, sort, direction):
    _, orders, _ = skewed
    rows = orders.select("order_id", "source_platform", "order_date", "customer_name", "net_revenue")
    order = paging.sort_columns(sort, [sort], direction, views.ORDER_KEY)
    whole = rows.orderBy(*[k.column for k in order]).collect()
    for page, skip in [(1, 0), (2, 0), (15, 20), (16, 1000), (40, 0)]:
        monkeypatch.setattr(paging, "SKIP_ROWS", skip)
        got = paging.page_of(rows, order, page, 100).collect()
        assert got == whole[100 * page - 100 : 100 * page]


def test_pages_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(paging, "SKIP_ROWS", 2)
    rows = spark.createDataFrame([(None, "a")] * 40 + [("x", "a")] * 40 + [("y", "b")], "s string, k string")
    order = paging.sort_columns("s", ["s"], "desc", ["k"])
    whole = sorted(rows.collect(), key=lambda r: (r.s is None, r.s != "y"))
    for page in (1, 2, 5, 8, 9, 10):
        assert paging.page_of(rows, order, page, 10).collect() == whole[10 * page - 10 : 10 * page]


def test_a_narrowed_cell_is_small(skewed, monkeypatch):
    _, orders, _ = skewed
    monkeypatch.setattr(paging, "SKIP_ROWS", 20)
    order = paging.sort_columns("order_date", ["order_date"], "asc", views.ORDER_KEY)
    cell, skip = paging._cell(orders, order, 700, 10)
    assert skip <= 20 and 10 <= cell.count() < orders.count() / 4


@pytest.mark.parametrize("kind", ["null", "equal", "same row"])
def test_a_hot_list_is_spread_over_tasks(spark, kind):
    value = {"null": "CAST(NULL AS BIGINT)", "equal": "7", "same row": "7"}[kind]
    name = "'same'" if kind == "same row" else "concat('n', id)"
    rows = spark.range(20_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN concat('k', id) ELSE 'hot' END AS k", f"{value} AS o", f"{name} AS v"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = keyed.ordered_lists(rows, ["k"], ["o"], ["v"], "vs", 1000)
        per_task = found.rows.groupBy("_range").count().collect()
        assert len(per_task) == 8 and max(r["count"] for r in per_task) < 20_000 / 4
        parts = found.lists.filter("k = 'hot'").orderBy("part").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["part"] for r in parts] == list(range(14))
    assert [len(r["vs"]) for r in parts] == [1000] * 13 + [333]
    assert sorted(x["v"] for r in parts for x in r["vs"]) == sorted(
        r["v"] for r in rows.filter("k = 'hot'").collect()
    )


def test_page_limits(skewed):
    order = [F.col("order_id").asc()]
    for page, limit in [(0, 10), (1, 0), (1, 5001)]:
        with pytest.raises(ValueError):
            paging.page_of(skewed[1], order, page, limit)
