import hashlib

import duckdb
import numpy as np
import pytest

from leadmill.llm import vector_codes
from leadmill.llm.queries import ORACLES, QUERIES
from workload.compare import difference


def by_hand(x, parts, entries, rounds):
    """Codes, errors and codebooks of integer vectors in ascending order of their ids."""
    cuts = [c for c in np.array_split(np.arange(x.shape[1]), parts)]
    books = [x[:entries, c].copy() for c in cuts]

    def assign():
        d = [((x[:, None, c] - b[None]) ** 2).sum(2) for c, b in zip(cuts, books)]
        return [q.argmin(1) for q in d], sum(q.min(1) for q in d)

    for _ in range(rounds):
        for c, b, at in zip(cuts, books, assign()[0]):
            for k in range(len(b)):
                if (at == k).any():
                    b[k] = x[at == k][:, c].sum(0) // (at == k).sum()
    at, error = assign()
    return list(zip(*at)), error, books


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    found = QUERIES["op12_vector_codes"](spark, sf_dir)
    assert difference(found, con, ORACLES["op12_vector_codes"]) is None


@pytest.mark.parametrize("spread, n, entries, rounds", [(3, 900, 40, 6), (400, 700, 256, 4), (1, 50, 9, 3)])
def test_bounds_change_nothing(spark, spread, n, entries, rounds):
    """Small spreads give many ties and repeated parts."""
    x = np.random.default_rng(5).integers(-spread, spread + 1, (n, 8))
    got = vector_codes.encode(
        table(spark, [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)]),
        entries=entries, rounds=rounds, scale=1,
    )
    code, error, books = by_hand(x, 4, entries, rounds)
    rows = {r.vec_id: (tuple(r.code), r.error) for r in got.df.collect()}
    assert rows == {i: (tuple(map(int, code[i])), int(error[i])) for i in range(n)}
    assert vector_codes.digest(got.codebooks[8]) == vector_codes.digest(books)
    # All passes but the first are spared most comparisons with all entries.
    assert all(beyond <= 4 * n for _, _, beyond in got.work[8])


def test_a_bound_that_holds_settles_parts(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-10_000, 10_000, (20, 8))
    x = centres[rng.integers(0, 20, 800)] + rng.integers(-20, 20, (800, 8))
    x[:20] = centres
    rows = [(i, [float(v) for v in row], None) for i, row in enumerate(x)]
    got = vector_codes.encode(table(spark, rows), entries=20, scale=1)
    assert got.work[8][0] == (0, 0, 3200)
    assert all(settled > 3000 for settled, _, _ in got.work[8][1:])


def test_bounds_are_on_the_safe_side():
    rng = np.random.default_rng(3)
    x, entries = rng.integers(-9, 9, (300, 3)), rng.integers(-9, 9, (30, 3))
    s = vector_codes.search_all(x, entries, 5)
    moved = entries + rng.integers(-1, 2, entries.shape)
    far = np.nextafter(np.sqrt(((moved - entries) ** 2).sum(1).astype(float)), np.inf)
    for b in (5, 3, 0):
        t = vector_codes.loosen(s, far, b)
        d = np.sqrt(vector_codes.distances(x, moved).astype(float))
        at = np.arange(len(x))
        assert (t.upper >= d[at, t.code]).all()
        others = np.ones_like(d, bool)
        others[at, t.code] = False
        for k in range(b):
            rest = np.where(others, d, np.inf)
            assert (t.low[:, k] <= rest.min(1)).all()
            others[at, t.listed[:, k]] = False
        assert (t.outer <= np.where(others, d, np.inf).min(1)).all()
        new, _ = vector_codes.reassign(x, moved, t)
        assert (new.code == vector_codes.distances(x, moved).argmin(1)).all()


def test_large_components_are_exact():
    x = np.array([[1 << 26, -(1 << 26)]] * 2, np.int64)
    assert vector_codes.distances(x, -x[:1])[0, 0] == 2 * (1 << 27) ** 2


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(9, [1.5, -0.5, 2.0, 0.0], 1), (9, [1.5, -0.5, 2.0, 0.0], 1), (3, [0.0] * 4, None),
            (None, [7.0, 1.0, 1.0, 1.0], None), (4, [-3.1, 2.0, 2.0, 9.0], 2)]
    bad = [(1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (5, [nan] * 4, 1), (6, [1.0, inf, 0.0, 0.0], 2)]
    other = [(20, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (21, [1.0, 2.0, 3.0, 4.0, 6.0], 1), (22, [], 1)]
    df = table(spark, good + bad + other)
    got = vector_codes.encode(df, entries=2, scale=10)
    rows = vector_codes.label_errors(got.df).collect()
    assert sorted(r.vec_id or 0 for r in rows) == [0, 3, 4, 9, 9, 20, 21, 22]
    # Smallest ids first, those without an id last.
    x = np.floor(10 * np.array([[0.0] * 4, [-3.1, 2, 2, 9], *[[1.5, -0.5, 2, 0]] * 2, [7, 1, 1, 1]])).astype(int)
    code, error, books = by_hand(x, 4, 2, 4)
    assert {(r.vec_id, tuple(r.code), r.error) for r in rows if r.length == 4} == {
        (i, tuple(map(int, c)), int(e)) for i, c, e in zip([3, 4, 9, 9, None], code, error)
    }
    assert [len(b[0]) for b in got.codebooks[5]] == [2, 1, 1, 1] and set(got.codebooks) == {0, 4, 5}
    per_label = {}
    for r in rows:
        per_label[r.label] = per_label.get(r.label, 0) + r.error
    assert all(r.label_error == per_label[r.label] for r in rows)
    for empty in (df.limit(0), table(spark, bad)):
        assert vector_codes.encode(empty).df.count() == 0
    with pytest.raises(Exception, match="must stay within"):
        vector_codes.encode(table(spark, [(1, [1e9], 1)]))
    more = df.selectExpr("*", "1 AS id", "'x' AS code", "2 AS x")
    assert vector_codes.encode(more, entries=2).df.count() == len(rows)


def test_digest_is_of_decimals():
    books = [np.array([[1, -2], [3, 4]]), np.array([[5]])]
    assert vector_codes.digest(books) == hashlib.sha256(b"1,-2,3,4,5").hexdigest()
