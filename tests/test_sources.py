"""CSV and Parquet sources and sinks."""

import pytest
from pyspark.sql import functions as F

from leadmill.plans import master_load
from leadmill.schemas import LEADS, TABLES
from leadmill.sources import checks, files
from workload.model import Model


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_is_text_with_nulls(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'b,a,x y\n007,NaN,"say ""hi"", twice"\n,null,n/a\n')
    df = files.read_raw_csv(spark, path)
    assert df.dtypes == [("b", "string"), ("a", "string"), ("x y", "string")]
    assert [tuple(r) for r in df.collect()] == [("007", None, 'say "hi", twice'),
                                                (None, None, None)]
    assert files.read_raw_csv(spark, path, ["x y", "b", "gone"]).columns == ["x y", "b"]


def test_csv_row_numbers_follow_the_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", "v\n" + "".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = files.read_raw_csv(spark, path, row_no=True, multi_line=False)
        assert df.rdd.getNumPartitions() > 3
        rows = [int(r["v"]) for r in df.orderBy("row_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == list(range(5000))


def test_multi_line_cells(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n"two\nlines",x\n')
    row = files.read_raw_csv(spark, path).first()
    assert tuple(row) == ("two\nlines", "x")


def test_files_with_other_column_orders(spark, tmp_path):
    write(tmp_path / "a.csv", "x,y\n1,2\n")
    write(tmp_path / "b.csv", "y,x\n4,3\n")
    write(tmp_path / "c.csv", "y\n6\n")
    df = files.read_raw_csv(spark, str(tmp_path), row_no=True)
    assert df.columns == ["x", "y", "row_no"]
    rows = [(r["x"], r["y"]) for r in df.orderBy("row_no").collect()]
    assert rows == [("1", "2"), ("3", "4"), (None, "6")]


def test_appending_keeps_the_layout(spark, sf_dir, tmp_path):
    path = str(tmp_path / "orders")
    orders = Model(spark, sf_dir).orders
    assert files.layout(spark, path) is None
    files.append_table(orders, path, ["source_platform"])
    assert files.layout(spark, path) == ["source_platform"]
    files.append_table(orders, path)
    assert spark.read.parquet(path).count() == 2 * orders.count()
    with pytest.raises(ValueError):
        files.append_table(orders, path, ["source_month"])


def test_append_reload_and_load(spark, tmp_path):
    folder = str(tmp_path)
    lead = files.conform(spark.range(3).select(F.col("id").cast("string").alias("contact_id")), LEADS)
    files.append_table(lead, f"{folder}/leads")
    files.append_table(lead, f"{folder}/leads")
    for name, schema in TABLES.items():
        if name != "leads":
            files.reload_table(spark.createDataFrame([], schema), f"{folder}/{name}")
    tables = files.load_tables(spark, folder)
    assert tables["leads"].schema.names == LEADS.names
    report = {r["table_name"]: r["rows"] for r in checks.load_report(tables).collect()}
    assert report == {"products": 0, "customers": 0, "orders": 0, "order_items": 0, "leads": 6}
    with pytest.raises(ValueError):
        files.reload_table(tables["leads"].limit(1), f"{folder}/leads")
    files.reload_table(lead.limit(1), f"{folder}/leads")
    assert spark.read.parquet(f"{folder}/leads").count() == 1


def test_partitioned_table(spark, sf_dir, tmp_path):
    path = str(tmp_path / "orders")
    files.reload_table(Model(spark, sf_dir).orders, path, ["source_platform"])
    plan = spark.read.parquet(path).filter("source_platform = 'mengantar'")
    assert "PartitionFilters: [isnotnull(source_platform" in plan._jdf.queryExecution().toString()


def test_missing_columns(spark):
    df = spark.range(4).select(F.col("id").alias("order_id"), F.lit("x").alias("name"))
    row = checks.missing_columns(df).first()
    assert row["rows"] == 4
    assert row["missing"] == "product, phone, status, payment_method, net_revenue, created_at"
    assert checks.missing_columns(df, ["name"]).first()["missing"] is None


def test_master_load_from_csv(spark, tmp_path):
    products = write(tmp_path / "p.csv", "product_id,product_name,product_price,note\n"
                     'P1,Spoon,"Rp277,065",x\n,No id,Rp5,x\n')
    customers = write(tmp_path / "c.csv", "customer_id,segment,total_revenue,first_order_date\n"
                      "007,VIP,12.345,2024-01-02\n008,Loyal,x,never\n")
    orders = write(tmp_path / "o.csv", "order_id,is_hpp,net_revenue,order_date,customer_id\n"
                   "1,True,100,2024-01-02 03:04:05,62812.0\n2,,bad,bad,\n")
    items = write(tmp_path / "i.csv", "order_id,product_id,qty_item,is_parent_row\n"
                  "1,P1,2,1\n1,P9,x,False\n2,,3,0\n")
    raw = [files.read_raw_csv(spark, p) for p in (products, customers, orders, items)]
    tables = master_load.prepare_master_tables(*raw)
    rows = {
        name: sorted([tuple(map(str, r)) for r in df.collect()]) for name, df in tables.items()
    }
    assert rows["products"] == [
        ("EDEQPC01", "Peralatan Cuci Sarang Walet", "None"), ("P1", "Spoon", "277065.00"),
    ]
    assert tables["customers"].columns == [
        "customer_id", "first_order_date", "total_revenue", "segment",
    ]
    assert rows["customers"] == [
        ("007", "2024-01-02 00:00:00", "12.35", "Unknown"), ("008", "None", "None", "Loyal"),
    ]
    assert rows["orders"] == [
        ("1", "2024-01-02 03:04:05", "62812.0", "100.00", "1"), ("2", "None", "None", "None", "0"),
    ]
    assert rows["order_items"] == [
        ("1", "None", "1", "0"), ("1", "P1", "2", "1"), ("2", "None", "3", "0"),
    ]
    again = master_load.reload_orders(raw[2], raw[3])
    assert [r["customer_id"] for r in again["orders"].orderBy("order_id").collect()] == [
        "62812", None,
    ]
    assert {r["product_id"] for r in again["order_items"].collect()} == {"P1", "P9", None}


def test_csv_folders_are_read_with_their_subfolders(spark, tmp_path):
    root = tmp_path / "in"
    for folder in ("2024/05", "2024/06", "_old", ".hidden"):
        (root / folder).mkdir(parents=True)
    write(root / "2024/05/a.csv", "a,b\n1,2\n")
    write(root / "2024/06/b.csv", "b,a\n4,3\n")
    write(root / "top.csv", 'a,"c\nd"\n5,6\n')
    write(root / "_old/x.csv", "a\nold\n")
    write(root / ".hidden/x.csv", "a\nhidden\n")
    df = files.read_raw_csv(spark, str(root))
    assert sorted(map(tuple, df.select("a", "b", "`c\nd`").collect())) == [
        ("1", "2", None), ("3", "4", None), ("5", None, "6"),
    ]
    assert files.read_raw_csv(spark, str(root / "2024")).count() == 2
    for nothing in ("_old/none", "*.txt"):
        with pytest.raises(FileNotFoundError):
            files.read_raw_csv(spark, str(root / nothing))
    (root / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_raw_csv(spark, str(root / "empty"))


def test_csv_compressed(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    write(tmp_path / "b.csv", "b,a\n4,3\n")
    got = files.read_raw_csv(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("a", "b").collect())) == [("1", "2"), ("3", "4")]


def test_a_failed_reload_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    files.reload_table(spark.range(5).toDF("v"), path)
    bad = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("v"))
    with pytest.raises(Exception, match="no"):
        files.reload_table(bad, path)
    assert files.load_table(spark, path).count() == 5
    files.reload_table(spark.range(3).toDF("v"), path)
    assert files.load_table(spark, path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
