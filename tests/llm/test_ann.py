import numpy as np
import pytest

from leadmill.llm import ann
from leadmill.llm.queries import QUERIES


def brute(rows, k=20, every=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = [len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()]
    return np.mean(hits)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op9_nearest_neighbours"](spark, sf_dir)), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_recall_with_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PARTS", 0.4)
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    x[1000:1500] = x[0]  # one very common vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got, want = found(ann.search(df)), brute([r[:2] for r in rows])
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert all(len(g) == 20 for g in got.values())
    for q in got:
        for i, s in got[q]:
            assert s == pytest.approx(float(x[i] @ x[q]), abs=1e-12)


def test_parts_in_use_at_every_size(spark):
    """Also on the given vectors, which are spread evenly, so that most parts are searched."""
    for sf, least in (("sf0.01", 5), ("sf0.1", 10)):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        parts, share = ann.share_searched(df)
        print(f"{sf}: {parts} parts, {share:.0%} searched")
        assert parts >= least
        got, want = found(ann.search(df)), brute([(r.vec_id, r.embedding) for r in df.collect()])
        print(f"recall {recall(got, want):.3f}")
        assert set(got) == set(want) and recall(got, want) >= 0.9


def test_clear_neighbourhoods_need_few_parts(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 3
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    parts, share = ann.share_searched(df)
    assert parts >= 15 and share < 0.4


def test_lengths_are_searched_among_themselves(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4 + i % 2).tolist()) for i in range(200)]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=5))
    for n in (4, 5):
        own = [r for r in rows if len(r[1]) == n]
        want = brute(own, 5, 5)
        assert recall({q: got[q] for q in want}, want) >= 0.9 and all(len(got[q]) == 5 for q in want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [-1.0, 0.0]), (20, [2.0, 0.0]),
            (None, [9.0, 9.0]), (40, [1.0, 2.0, 3.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(df, k=3))
    assert got == {0: [(1, 2.0), (2, 2.0), (20, 2.0)], 20: [(1, 4.0), (2, 4.0), (0, 2.0)]}
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 0")).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    graph = rng.integers(0, 500, (500, 5))
    part = ann.balanced_parts(graph, 7)
    assert part.min() >= 0 and np.bincount(part, minlength=7).max() <= np.ceil(1.1 * 500 / 7)
