"""Product codes of vectors by integer k-means with adaptive distance bounds.

Vectors become integers and are cut into equal parts. For each part position, k-means runs on
exact integers. A pass over the vectors is one Spark stage that writes, beside each vector,
what the next pass needs: for each part its entry, an upper bound of the distance to it, its b
closest other entries with lower bounds in ascending order, and one outer bound for all the
rest. When entries have moved, bounds are loosened by how far; a part whose upper bound stays
below its first lower bound keeps its entry without any distance. Otherwise the entries whose
bounds are not beyond the upper one are compared by exact integer distances, and only if the
outer bound is reached, all entries. b starts at LISTED and shrinks to what the parts needed.

Bounds are single-precision and always rounded away from the claim they make, so they decide
only what is certain; ties and near ties are always settled by integers.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from leadmill.llm.staging import Staged, stage

#: Closest entries that a part keeps bounds of, at first and at least.
LISTED, LEAST_LISTED = 16, 2
#: Share of the parts that may have to look beyond the list when it is shortened.
BEYOND = 0.01
#: Larger integer components would not give distances that fit a long.
MAX_COMPONENT = 1 << 26

_UP, _DOWN = np.float32(np.inf), np.float32(-np.inf)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), _UP)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), _DOWN)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each entry.

    Matrix products in doubles are exact while every sum stays below 2^53.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, c = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * (a @ c.T)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for k, c in enumerate(entries):
        out[:, k] = ((x - c) ** 2).sum(1)
    return out


def _own(x: np.ndarray, entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to the entries named in its row of `at`."""
    return ((x[:, None, :] - entries[at]) ** 2).sum(2)


@dataclass
class Bounds:
    """Of n parts at one position: entry, upper bound, listed entries, their bounds, outer."""

    code: np.ndarray
    upper: np.ndarray
    listed: np.ndarray
    low: np.ndarray
    outer: np.ndarray

    def pack(self) -> np.ndarray:
        fields = (self.code[:, None], self.upper[:, None], self.listed, self.low, self.outer[:, None])
        return np.concatenate([np.ascontiguousarray(f).view(np.uint8) for f in fields], 1)

    @classmethod
    def unpack(cls, rows: np.ndarray, b: int) -> "Bounds":
        cut = np.cumsum([1, 4, b, 4 * b, 4])
        code, upper, listed, low, outer = (
            np.ascontiguousarray(part) for part in np.split(rows, cut[:-1], 1)
        )
        n = len(rows)
        single = np.float32
        return cls(
            code[:, 0], upper.view(single).reshape(n), listed,
            low.view(single).reshape(n, b), outer.view(single).reshape(n),
        )


def search_all(x: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
    """Nearest entries and bounds from all distances; ties go to the lower index."""
    d = distances(x, entries)
    at = np.arange(len(x))
    code = d.argmin(1)
    upper = _up(np.sqrt(d[at, code].astype(np.float64)))
    d[at, code] = np.iinfo(np.int64).max
    if b + 1 < d.shape[1]:
        near = np.argpartition(d, b, 1)[:, : b + 1]
    else:
        near = np.tile(np.arange(d.shape[1]), (len(x), 1))
    far = np.take_along_axis(d, near, 1)
    by = np.argsort(far, 1, kind="stable")
    near, far = np.take_along_axis(near, by, 1), np.take_along_axis(far, by, 1)
    low = _down(np.sqrt(far.astype(np.float64)))
    # The next one beyond the list bounds all the rest; of k entries, k - 1 are others.
    outer = low[:, b].copy() if b < len(entries) - 1 else np.full(len(x), _UP)
    return Bounds(code.astype(np.uint8), upper, near[:, :b].astype(np.uint8), low[:, :b], outer)


def loosen(s: Bounds, moved: np.ndarray, b: int) -> Bounds:
    """Bounds after entries moved by at most `moved`, for a list of the first b.

    Each lower bound also holds for all that come after it in the list and beyond.
    """
    if b < s.low.shape[1]:
        s = Bounds(s.code, s.upper, s.listed[:, :b], s.low[:, :b], np.minimum(s.outer, s.low[:, b]))
    double = np.float64
    upper = _up(s.upper.astype(double) + moved[s.code])
    outer = _down(s.outer.astype(double) - moved.max(initial=0))
    low = _down(s.low.astype(double) - moved[s.listed])
    both = np.concatenate([low, outer[:, None]], 1)[:, ::-1]
    low = np.minimum.accumulate(both, 1)[:, ::-1][:, :-1]
    return Bounds(s.code, upper, s.listed, np.ascontiguousarray(low), outer)


def reassign(x: np.ndarray, entries: np.ndarray, s: Bounds) -> tuple[Bounds, np.ndarray]:
    """Nearest entries under loosened bounds, and how many listed entries each part needed;
    one more than the list has where all entries were compared."""
    b = s.low.shape[1]
    code, upper, listed, low, outer = (
        a.copy() for a in (s.code, s.upper, s.listed, s.low, s.outer)
    )
    needed = np.zeros(len(x), np.int64)

    def first(rows):
        return low[rows, 0] if b else outer[rows]

    at = np.flatnonzero(np.minimum(first(slice(None)), outer) <= upper)
    if len(at):
        # Tighten the upper bound first.
        own = _own(x[at], entries, code[at][:, None])[:, 0]
        upper[at] = _up(np.sqrt(own.astype(np.float64)))
        still = np.minimum(first(at), outer[at]) <= upper[at]
        at, own = at[still], own[still]
    if len(at):
        needed[at] = (low[at] <= upper[at][:, None]).sum(1)
        among = np.concatenate([code[at][:, None], listed[at]], 1)
        d = np.concatenate([own[:, None], _own(x[at], entries, listed[at])], 1)
        by = np.lexsort((among, d), axis=1)
        among, d = np.take_along_axis(among, by, 1), np.take_along_axis(d, by, 1)
        root = np.sqrt(d.astype(np.float64))
        code[at], upper[at] = among[:, 0], _up(root[:, 0])
        listed[at] = among[:, 1:]
        low[at] = np.minimum(_down(root[:, 1:]), outer[at][:, None])
        rest = at[outer[at] <= upper[at]]
        if len(rest):
            needed[rest] = b + 1
            new = search_all(x[rest], entries, b)
            code[rest], upper[rest], outer[rest] = new.code, new.upper, new.outer
            listed[rest], low[rest] = new.listed, new.low
    return Bounds(code, upper, listed, low, outer), needed


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one width as an Arrow binary column."""
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape
    ends = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _bytes(column: pa.Array, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


@dataclass(frozen=True)
class Grid:
    """How vectors of `length` components are cut."""

    length: int
    parts: int

    @property
    def cuts(self) -> list[slice]:
        """Consecutive and equal; where the length is no multiple, the first are longer by one."""
        sizes = [len(p) for p in np.array_split(np.arange(self.length), self.parts)]
        ends = np.cumsum([0, *sizes])
        return [slice(a, b) for a, b in zip(ends, ends[1:])]


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(values.astype(np.float64) * scale)
    if len(x) and np.abs(x).max(initial=0) > MAX_COMPONENT:
        raise ValueError(f"components times {scale} must stay within {MAX_COMPONENT}")
    return x.astype(np.int32)


_STATE = ["id", "label", "x", "bounds"]
_SUMS = ["part", "entry", "n", "sums", "needed"]


def _pass(rows: DataFrame, kinds: str, grid: Grid, assign) -> DataFrame:
    """One pass over the vectors: rows of the next state, and then each task's sums per entry.

    `assign` gives for the batch x and the packed bounds, per part, new bounds and needs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        sums: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _bytes(batch.column("x"), np.int32, n).astype(np.int64) if grid.length else np.zeros((n, 0), np.int64)
            packed = []
            for p, cut in enumerate(grid.cuts):
                bounds, needed = assign(p, x[:, cut], batch)
                packed.append(bounds.pack())
                groups, at, counts = np.unique(bounds.code, return_inverse=True, return_counts=True)
                total = np.zeros((len(groups), cut.stop - cut.start), np.int64)
                np.add.at(total, at, x[:, cut])
                for g, c, t in zip(groups.tolist(), counts.tolist(), total):
                    entry = sums.setdefault((p, g, -1), [0, 0])
                    entry[0] += c
                    entry[1] = entry[1] + t
                for depth, c in zip(*(v.tolist() for v in np.unique(needed, return_counts=True))):
                    sums.setdefault((p, -1, depth), [0, np.zeros(0, np.int64)])[0] += c
            state = [batch.column("id"), batch.column("label"), batch.column("x"),
                     _binary(np.concatenate(packed, 1))]
            out = pa.RecordBatch.from_arrays(
                [*state, *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32()))],
                [*_STATE, *_SUMS],
            )
            schema = out.schema
            yield out
        if sums:
            n = len(sums)
            nothing = [pa.nulls(n, schema.field(c).type) for c in _STATE]
            part, entry, depth = zip(*sums)
            yield pa.RecordBatch.from_arrays(
                [*nothing, pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
                 pa.array([v[0] for v in sums.values()], pa.int64()),
                 pa.array([v[1].tolist() for v in sums.values()], pa.list_(pa.int64())),
                 pa.array(depth, pa.int32())],
                [*_STATE, *_SUMS],
            )

    return rows.mapInArrow(
        work, f"{kinds}, x binary, bounds binary, part int, entry int, n long, sums array<long>, needed int"
    )


class _Fit:
    """Codebooks of the vectors of one length, pass by pass."""

    def __init__(self, rows: DataFrame, grid: Grid, entries: int):
        self.grid, self.entries = grid, entries
        self.kinds = ", ".join(
            f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label")
        )
        first = rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
        x = np.stack([np.frombuffer(r.x, np.int32) for r in first]).astype(np.int64)
        self.books = [np.ascontiguousarray(x[:, cut]) for cut in grid.cuts]
        self.listed = min(LISTED, len(x) - 1)
        self.state: Staged | None = None
        self.rows, self.moved = rows, None
        #: Of each pass: parts that needed no listed entry, some, all entries.
        self.work: list[tuple[int, int, int]] = []

    def assign(self) -> None:
        """Every part to its nearest entry; the state of this pass replaces the last."""
        books, moved, b, grid = self.books, self.moved, self.listed, self.grid
        if moved is None:

            def assign(p, x, batch):
                return search_all(x, books[p], b), np.full(len(x), b + 1)

            rows = self.rows
        else:
            old = self.old_listed
            width = 1 + 4 + old + 4 * old + 4

            def assign(p, x, batch):
                packed = _bytes(batch.column("bounds"), np.uint8, len(x))
                state = Bounds.unpack(packed[:, p * width : (p + 1) * width], old)
                return reassign(x, books[p], loosen(state, moved[p], b))

            rows = self.state.df.where("part is null").select(*_STATE)
        new = stage(_pass(rows, self.kinds, grid, assign), "codes")
        if self.state is not None:
            self.state.drop()
        self.state, self.old_listed = new, b

    def update(self) -> None:
        """Entries to the floored means of their parts, and b to what this pass needed."""
        totals = (
            self.state.df.where("part is not null")
            .select("part", "entry", "needed", "n", F.posexplode_outer("sums").alias("at", "s"))
            .groupBy("part", "entry", "needed", "at")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            .collect()
        )
        new = [b.copy() for b in self.books]
        depth: dict[int, int] = {}
        for r in totals:
            if r.entry < 0:
                depth[r.needed] = depth.get(r.needed, 0) + r.n
            elif r["at"] is not None:
                new[r.part][r.entry, r["at"]] = r.s // r.n
        self.moved = [
            np.nextafter(np.sqrt(((a - c) ** 2).sum(1).astype(np.float64)), np.inf) * (np.any(a != c, axis=1))
            for a, c in zip(self.books, new)
        ]
        self.books = new
        none, beyond = depth.get(0, 0), depth.get(self.listed + 1, 0)
        self.work.append((none, sum(depth.values()) - none - beyond, beyond))
        if len(self.work) > 1:
            left = BEYOND * sum(depth.values()) + beyond
            b = self.listed
            while b > min(LEAST_LISTED, self.listed) and depth.get(b, 0) <= left:
                left -= depth.get(b, 0)
                b -= 1
            self.listed = b

    def codes(self) -> DataFrame:
        """id, label, code (bytes) and exact error under the last assignment."""
        books, cuts, width = self.books, self.grid.cuts, 9 + 5 * self.old_listed
        length = self.grid.length

        def work(batches):
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = _bytes(batch.column("x"), np.int32, n).astype(np.int64) if length else np.zeros((n, 0), np.int64)
                packed = _bytes(batch.column("bounds"), np.uint8, n)
                code = packed[:, ::width]
                error = sum(_own(x[:, c], books[p], code[:, p : p + 1])[:, 0] for p, c in enumerate(cuts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), _binary(code), pa.array(error)],
                    ["id", "label", "code", "error"],
                )

        rows = self.state.df.where("part is null").select(*_STATE)
        return rows.mapInArrow(work, f"{self.kinds}, code binary, error long")


@dataclass
class Codes:
    """Coded rows, and per vector length the codebooks: one array (entries, components) a part."""

    df: DataFrame
    codebooks: dict[int, list[np.ndarray]]
    #: Per length and pass: parts settled by bounds, by listed entries, by all entries.
    work: dict[int, list[tuple[int, int, int]]]


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> Codes:
    """Codes of all vectors after `rounds` rounds of k-means: id, label, length, code, error.

    Left out are vectors that are null or hold a null or non-finite component. A component x
    becomes floor(scale * x); beyond MAX_COMPONENT that raises ValueError. The codebook of each
    part position starts with the parts of the `entries` rows of the smallest ids (at most 256;
    rows without an id come last, rows that share an id in the order of their vectors), fewer
    if there are fewer rows. Means are floored; an entry without parts stays. Repeated rows
    count each. Vectors of another length are coded among themselves, with codebooks of their
    own; where a length is no multiple of `parts`, the first parts are longer by one. An empty
    table gives no rows. Columns beyond id, vector and label are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: entries must be from 1 to 256")
    rows = (
        vectors.select(
            F.col(id_col).alias("id"), F.col(label_col).alias("label"),
            F.col(vector_col).cast("array<double>").alias("v"),
        )
        .where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    )
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))

    def integers(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v")
                flat = v.flatten().to_numpy(zero_copy_only=False)
                x = _integers(flat, scale)
                ends = np.cumsum(np.concatenate([[0], v.value_lengths().to_numpy()]))
                data = [x[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), pa.array(data, pa.binary())],
                    ["id", "label", "x"],
                )

    whole = stage(rows.mapInArrow(integers, f"{kinds}, x binary"), "integers")
    lengths = [r[0] for r in whole.df.select(F.octet_length("x") / 4).distinct().collect()]
    out, books, work = None, {}, {}
    for length in sorted(map(int, lengths)):
        fit = _Fit(whole.df.where(F.octet_length("x") == 4 * length), Grid(length, parts), entries)
        for _ in range(rounds):
            fit.assign()
            fit.update()
        fit.assign()
        coded = stage(fit.codes(), "coded").df.withColumn("length", F.lit(length))
        fit.state.drop()
        out = coded if out is None else out.unionByName(coded)
        books[length], work[length] = fit.books, fit.work
    if out is None:
        spark = vectors.sparkSession
        schema = StructType.fromDDL(f"{kinds}, code binary, error long, length int")
        out = spark.createDataFrame([], schema)
    whole.drop()
    out = out.select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "length", "code", "error"
    )
    return Codes(out, books, work)


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error, the sum of errors over rows of equal labels; nulls are one group."""
    total = coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """DuckDB SQL for the codes of `embeddings` whose vectors have one length."""
    width = f"(len(v) // {parts})"
    sql = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS rn,
         list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT rn, p, v[{width} * p + 1 : {width} * (p + 1)] AS x
  FROM kept, (SELECT unnest(range({parts})) AS p) AS numbers
), book0 AS MATERIALIZED (SELECT p, rn AS k, x AS c FROM parts WHERE rn < {entries})"""]
    for r in range(rounds + 1):
        sql.append(f"""
, near{r} AS MATERIALIZED (
  SELECT rn, a.p AS p,
         min(CAST(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c)
                  AS BIGINT) * 256 + k) AS m
  FROM parts AS a JOIN book{r} AS b ON a.p = b.p GROUP BY rn, a.p
)""")
        if r < rounds:
            sql.append(f"""
, sums{r} AS (
  SELECT a.p AS p, m % 256 AS k, i, floor(sum(x[i + 1]) / count(*)) AS value
  FROM near{r} AS a JOIN parts AS b ON a.rn = b.rn AND a.p = b.p, unnest(range(len(x))) AS t(i)
  GROUP BY a.p, m % 256, i
), book{r + 1} AS MATERIALIZED (
  SELECT b.p AS p, b.k AS k, coalesce(new, c) AS c
  FROM book{r} AS b
  LEFT JOIN (SELECT p, k, list(value ORDER BY i) AS new FROM sums{r} GROUP BY p, k) AS s
    ON b.p = s.p AND b.k = s.k
)""")
    sql.append(f"""
, coded AS (
  SELECT rn, string_agg(format('{{:02x}}', m % 256), '' ORDER BY p) AS code,
         CAST(sum(m // 256) AS BIGINT) AS error
  FROM near{rounds} GROUP BY rn
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(c[i + 1] AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, i)) AS sha
  FROM book{rounds}, unnest(range(len(c))) AS t(i)
)
SELECT vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM kept JOIN coded ON kept.rn = coded.rn, digest""")
    return "".join(sql)
