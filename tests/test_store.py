"""Tables that change together."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from leadmill.operators.customer_state import customer_state
from leadmill.plans import jobs, lead_import, lead_patches
from leadmill.plans.courier_import import CourierImport
from leadmill.operators.rules import assign_tracks
from leadmill.schemas import LEAD_HEADINGS, LEADS
from leadmill.sources import store as stores
from leadmill.sources.store import Buckets, Conflict, Merge, TableStore
from tests.test_imports import NOW, courier, export, raw, stored  # noqa: F401
from tests.test_rules import table

BUCKETS = {"leads": Buckets("contact_id", 8)}


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture()
def store(spark, stored, tmp_path):  # noqa: F811
    customers, orders, leads = stored
    s = TableStore(spark, str(tmp_path / "store"), BUCKETS)
    assert jobs.load_store(s, {"customers": customers, "orders": orders, "leads": leads})
    return s


def everything(store):
    return {n: rows(store.read(n, jobs.SCHEMAS[n])) for n in store.snapshot().tables}


def test_courier_import_is_one_change(store, raw, stored):  # noqa: F811
    customers, orders, leads = stored
    want = CourierImport(raw, customers, orders, leads, NOW)
    report = jobs.import_courier(store, raw, NOW, "june")
    assert rows(report) == rows(want.report)
    after = everything(store)
    assert after["customers"] == rows(want.customers)
    assert after["leads"] == rows(want.leads.drop("previous_track"))
    assert after["customer_state"] == rows(customer_state(want.orders.select(orders.columns)))
    assert len(after["orders"]) == 7 and len(after["order_items"]) == 7
    # Again: nothing happens. Under another name, all orders are known.
    assert jobs.import_courier(store, raw, NOW, "june") is None
    assert jobs.import_courier(store, raw, NOW, "again").first().asDict()["inserted"] == 0
    assert everything(store) == after


@pytest.mark.parametrize("step", range(6))
def test_a_failure_between_any_two_writes_changes_nothing(store, raw, monkeypatch, step):  # noqa: F811
    before = everything(store)
    write, publish, done = TableStore._write, TableStore._publish, []

    def failing(real):
        def f(self, *args):
            if len(done) == step:
                raise OSError("lost")
            done.append(1)
            return real(self, *args)

        return f

    monkeypatch.setattr(TableStore, "_write", failing(write))
    monkeypatch.setattr(TableStore, "_publish", failing(publish))
    with pytest.raises(OSError):
        jobs.import_courier(store, raw, NOW, "june")
    assert len(done) == step and everything(store) == before
    monkeypatch.undo()
    jobs.import_courier(store, raw, NOW, "june")
    assert len(everything(store)["orders"]) == 7
    assert len(store.vacuum()) >= (1 if step else 0)
    assert len(everything(store)["orders"]) == 7


def test_the_later_of_two_commits_on_one_snapshot_fails(store, spark):
    base = store.snapshot()
    more = table(spark, LEADS, [{"contact_id": "L9"}])
    store.commit("first", append={"leads": more}, base=base)
    after = everything(store)
    with pytest.raises(Conflict):
        store.commit("second", append={"leads": more}, base=base)
    assert everything(store) == after and len(after["leads"]) == 6


def leads_of(spark, n):
    return table(spark, LEADS, [
        {"contact_id": f"L{i}" if i % 10 else None, "phone": f"62{i}", "converted": 0, "track": "T4-Winback",
         "created_at": NOW - timedelta(days=i)} for i in range(n)
    ])


def test_a_merge_rewrites_only_touched_buckets(spark, stored, tmp_path):  # noqa: F811
    customers, orders, _ = stored
    s = TableStore(spark, str(tmp_path / "store"), {"leads": Buckets("contact_id", 32)})
    leads = leads_of(spark, 400)
    jobs.load_store(s, {"customers": customers, "orders": orders, "leads": leads})
    before = s.snapshot().tables["leads"]
    assert len(before) == 32

    incoming = export(spark, LEAD_HEADINGS, [
        {"contact_id": "L1", "name": "one", "phone": "62811"},
        {"contact_id": "L1", "name": "one again"},
        {"contact_id": "New", "name": "new"},
    ])
    want = lead_import.upsert_leads(incoming, leads, customers, NOW)
    assert jobs.upsert(s, incoming, NOW, "a")
    assert rows(s.read("leads", LEADS)) == rows(want)
    after = s.snapshot().tables["leads"]
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2

    patches = spark.createDataFrame(
        [("L2", 1, {"note": "n"}), ("L2", 2, {"phone": "x"}), ("none", 3, {"note": "n"}), (None, 4, {"note": "n"})],
        "contact_id string, patch_no int, fields map<string,string>",
    )
    patched = lead_patches.apply_lead_patches(want, patches, NOW)
    assert jobs.patch(s, patches, NOW, "b") and not jobs.patch(s, patches, NOW, "b")
    assert rows(s.read("leads", LEADS)) == rows(patched)
    last = s.snapshot().tables["leads"]
    assert sum(last[b] != after.get(b) for b in last) <= 2


def test_lead_import_and_retracking_are_whole_steps(store, spark, stored):  # noqa: F811
    customers, orders, leads = stored
    incoming = export(spark, LEAD_HEADINGS, [
        {"contact_id": "L1", "name": "one", "phone": "62811", "created_at": "2024-06-29"},
        {"contact_id": "L7", "name": "new", "created_at": "2024-06-29"},
    ])
    after = lead_import.upsert_leads(incoming, leads, customers, NOW)
    want = assign_tracks(after, orders, customers, NOW, "lead_import")
    report, tracks = jobs.import_leads(store, incoming, NOW, "leads")
    assert report.first().asDict() == {"inserted": 1, "updated": 1, "total": 2}
    assert rows(store.read("leads", LEADS)) == rows(want.drop("previous_track"))
    assert sum(r["leads"] for r in tracks.collect()) == 6
    assert jobs.import_leads(store, incoming, NOW, "leads") is None

    later = NOW + timedelta(days=60)
    want = assign_tracks(store.read("leads", LEADS), orders, customers, later, "full_sync")
    counts, tracks = jobs.retrack(store, later, "sync")
    assert counts.first()["processed"] == 6
    assert rows(store.read("leads", LEADS)) == rows(want.drop("previous_track"))
    # Nothing changes a second time, and then nothing is written.
    before = store.snapshot().tables
    assert jobs.retrack(store, later, "sync again")[0].first()["updated"] == 0
    assert store.snapshot().tables == before


def test_leads_without_an_id_survive_merges(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "store"), BUCKETS)
    leads = leads_of(spark, 50)
    s.commit("load", {"leads": leads})
    new = leads.filter("contact_id = 'L1'").withColumn("track", F.lit("Arsip"))
    s.commit("one", merge={"leads": Merge(new, LEADS, jobs._with_tracks)})
    got = s.read("leads", LEADS)
    assert got.count() == 50 and got.filter("contact_id IS NULL").count() == 5
    assert [r.contact_id for r in got.filter("track = 'Arsip'").collect()] == ["L1"]


def test_an_unknown_table_is_empty(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "nothing"))
    assert s.read("leads", LEADS).count() == 0 and s.snapshot() == stores.Snapshot()
