import duckdb
import pytest

from leadmill.llm import sharding
from leadmill.llm.queries import ORACLES, QUERIES
from workload.compare import difference


def connect(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    return con


@pytest.mark.parametrize("limit", [3_000, 60_000])
def test_shards_equal_those_of_sql(spark, sf_dir, limit):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sharding.assign_shards(docs, limit)
    assert difference(found, connect(sf_dir), sharding.oracle(limit)) is None
    over = found.where(f"shard_bytes > {limit} and shard_docs > 1")
    assert over.count() == 0


def test_query(spark, sf_dir):
    found = QUERIES["op3_sharding"](spark, sf_dir)
    assert difference(found, connect(sf_dir), ORACLES["op3_sharding"]) is None


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 1)
    docs = spark.createDataFrame(
        [(i, "x" * 100, 1) for i in range(50)] + [(50, "y" * 9000, 1), (51, None, 1), (52, "", 1)]
        + [(None, "z" * 10, 1), (None, None, 1)] + [(53, "w" * 500, 1)] * 3,
        "doc_id long, text string, h int",
    )
    found = sharding.assign_shards(docs, 1000)
    rows = found.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault((r.shard_depth, r.shard_prefix), []).append(r)
    for shard in by.values():
        assert shard[0].shard_docs == len(shard)
        assert shard[0].shard_bytes <= 1000 or len({r.doc_id for r in shard}) == 1
    assert {r.shard_bytes for r in rows if r.doc_id == 50} == {9000}
    assert sharding.assign_shards(docs.limit(0), 1000).count() == 0
    # Rows without an id and repeated rows are written too, whatever columns there are.
    more = docs.selectExpr("*", "'x' AS shard", "1 AS place", "2 AS row")
    sharding.write_shards(more, found, str(tmp_path / "shards"))
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, written.select(more.columns).collect())) == sorted(map(str, more.collect()))
    assert {tuple(map(int, r[0].split("-"))) for r in written.select("shard_").distinct().collect()} == set(by)
