"""Nearest neighbours by largest inner product, with learned partitions.

A bounded sample of the vectors is joined to a neighbour graph. The graph is cut into balanced
parts with few edges between them, and a softmax classifier learns which part a vector is in.
It then places every vector in its most probable part, and sends a query to its most probable
parts, as many as hold a certain mass of the probability. That mass is measured on vectors of
the sample that the classifier was not trained on: it reaches RECALL of their neighbours. Within
these parts all inner products are computed in double precision. Where neighbourhoods are clear,
few parts do; where vectors are spread evenly, many are searched, at the worst all.

The number of parts grows with the square root of the number of vectors, at every size, so that
neither the classifier's work nor that within parts dominates. Queries of one most probable part
go in blocks. A block meets the parts of its queries one by one; what it finds is packed in one
row for each part, and merged in one stream, so only a query's nearest leave a task as rows.
"""

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from leadmill.llm.staging import stage

#: The graph and the classifier are made from about so many distinct vectors, or so many for
#: each part, if that is more.
MAX_SAMPLE, PART_SAMPLE = 8000, 20
NEIGHBOURS = 20
#: Parts for the square root of the number of distinct vectors.
PARTS = 0.25
#: Share of neighbours that the searched parts hold, for vectors of the sample.
RECALL = 0.94
#: Vectors, and queries, that meet in one block of inner products.
BLOCK = 2048
QUERY_BLOCK = 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (array of doubles) and key (for equal vectors) of the rows that take part.

    Left out are rows without an id, and vectors that are null, zero, or hold a null or non-finite
    component. Repeated rows count once.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")
    ).where("vec_id is not null and vec is not null")
    rows = rows.where(
        "not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
        " and exists(vec, x -> x <> 0)"
    )
    return rows.withColumn("key", F.xxhash64("vec")).dropDuplicates(["vec_id", "key"])


def neighbour_graph(spark, sample: np.ndarray) -> np.ndarray:
    """The NEIGHBOURS nearest others of each vector of the sample, fewer if there are no more."""
    if len(sample) < 2:
        return np.zeros((len(sample), 0), np.int32)
    shared = spark.sparkContext.broadcast(sample)
    k, n = min(NEIGHBOURS, len(sample) - 1), len(sample)

    def work(batches):
        x = shared.value
        for pdf in batches:
            for a in pdf["id"]:
                near = x[a : a + 500] @ x.T
                near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
                top = np.argpartition(-near, k - 1, 1)[:, :k].astype(np.int32)
                yield pd.DataFrame({"a": [a], "top": [top.tobytes()]})

    blocks = spark.range(0, n, 500, numPartitions=-(-n // 500))
    rows = sorted(blocks.mapInPandas(work, "a long, top binary").collect())
    shared.unpersist()
    return np.concatenate([np.frombuffer(r.top, np.int32).reshape(-1, k) for r in rows])


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A part for each vertex: parts grow along edges, then vertices move to where most of
    their neighbours are, as long as no part exceeds its share by a tenth."""
    rng, n = np.random.default_rng(seed), len(graph)
    both = [list(row) for row in graph]
    for v, row in enumerate(graph):
        for u in row:
            both[u].append(v)
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    p = 0
    for start in rng.permutation(n):
        queue = deque([start])
        while queue:
            v = queue.popleft()
            if part[v] >= 0:
                continue
            if p < parts - 1 and size[p] >= n / parts:
                p += 1
                queue = deque([v])
                continue
            part[v] = p
            size[p] += 1
            queue.extend(both[v])
    most = int(np.ceil(1.1 * n / parts))
    for _ in range(8):
        moved = 0
        for v in rng.permutation(n):
            near = np.bincount(part[both[v]], minlength=parts)
            open_ = np.where((size < most) | (np.arange(parts) == part[v]), near, -1)
            to = int(open_.argmax())
            if open_[to] > near[part[v]]:
                size[part[v]] -= 1
                size[to] += 1
                part[v] = to
                moved += 1
        if moved < n / 100:
            break
    return part


class Router:
    """Softmax classifier from vectors to parts."""

    def __init__(self, vectors: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int):
        self.scale = float(np.sqrt((vectors**2).sum(1).mean())) or 1.0
        tried = np.arange(len(vectors)) % 5 == 0
        x = (vectors[~tried] / self.scale).astype(np.float32)
        part = part[~tried]
        goal = np.eye(parts, dtype=np.float32)[part]
        w = np.zeros((x.shape[1] + 1, parts), np.float32)
        one = np.hstack([x, np.ones((len(x), 1), np.float32)])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 151 if parts > 1 else 1):
            d = (self._softmax(one @ w) - goal) / len(x)
            g = one.T @ d + 1e-6 * w
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.w = w
        # Probability before the part of each neighbour, in the order in which parts are searched.
        best, p = self.best(vectors), self.probabilities(vectors[tried])
        self.mass = 1.0
        if not graph.shape[1]:
            return
        theirs = np.take_along_axis(p, best[graph[tried]], 1)
        before = (p[:, None, :] * (p[:, None, :] > theirs[:, :, None])).sum(2)
        self.mass = float(np.quantile(before, RECALL)) + 1e-6

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax((x / self.scale) @ self.w[:-1] + self.w[-1])

    def best(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(1)

    def probes(self, x: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Parts to search: those of the mass, and on until they hold `least` vectors."""
        p = self.probabilities(x)
        order = np.argsort(-p, 1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        before = np.cumsum(p, 1) - p
        enough = (np.cumsum(sizes[order], 1) < least).sum(1) + 1
        mass = (before <= self.mass).sum(1)
        return [o[: max(a, b)] for o, a, b in zip(order, mass, enough)]


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def fit(distinct: DataFrame, count: int) -> Router:
    """The router for distinct vectors of one length."""
    parts = max(1, round(PARTS * count**0.5))
    grain, size = 1 << 30, max(MAX_SAMPLE, PART_SAMPLE * parts)
    rows = distinct.select("key", "vec").where(
        F.pmod(F.xxhash64(F.col("key") + 0), F.lit(grain)) < int(grain * min(1, size / count))
    )
    sample = _stack([r.vec for r in sorted(rows.collect(), key=lambda r: r.key)]).astype(np.float32)
    parts = max(1, min(parts, len(sample) // PART_SAMPLE))
    graph = neighbour_graph(distinct.sparkSession, sample)
    return Router(sample, graph, balanced_parts(graph, parts), parts)


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest rows of each query row: query_id, rank (from 1), vec_id, score.

    Queries are the usable rows whose vec_id is divisible by `every`, candidates all usable rows
    but the query's own id. Nearest is the largest inner product, ties go to the smaller vec_id.
    Inner products are of vectors of one length: those of another length are searched among
    themselves. Other columns are not carried. Each distinct vector is indexed once, with the
    k + 1 smallest of its ids: no other can be among a query's k nearest.
    """
    rows = stage(usable(vectors), "vectors").df
    out = None
    for length in sorted(r[0] for r in rows.select(F.size("vec")).distinct().collect()):
        found = _search(rows.where(F.size("vec") == length), k, every)[0]
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double"
        )
    return out


def share_searched(vectors: DataFrame, k: int = 20, every: int = 20) -> tuple[int, float]:
    """Parts, and the share of all vectors that a query is compared with, of the most frequent
    length."""
    rows = stage(usable(vectors), "vectors").df
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count")).first().n
    return _search(rows.where(F.size("vec") == length), k, every)[1:]


def _search(rows: DataFrame, k: int, every: int) -> tuple[DataFrame, int, float]:
    by_id = Window.partitionBy("key").orderBy("vec_id")
    few = stage(rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1), "copies").df
    distinct = few.where("n = 1").select("key", F.col("vec_id").alias("first_id"), "vec")
    count = distinct.count()
    router = fit(distinct, count)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["vec"])
                yield pd.DataFrame(
                    {"key": pdf["key"], "first_id": pdf["first_id"], "part": router.best(x), "x": [v.tobytes() for v in x]}
                )

    placed = stage(
        distinct.mapInPandas(place, "key long, first_id long, part long, x binary"), "placed"
    ).df
    sizes = np.zeros(router.w.shape[1], np.int64)
    for r in placed.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]

    def route(batches):
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["vec"])
                to = router.probes(x, sizes, 4 * (k + 1))
                yield pd.DataFrame(
                    {"query": pdf["key"], "best": [int(t[0]) for t in to], "parts": to,
                     "searched": [int(sizes[t].sum()) for t in to], "x": [v.tobytes() for v in x]}
                )

    queries = stage(
        rows.where(F.col("vec_id") % every == 0).select("key", "vec").dropDuplicates(["key"])
        .mapInPandas(route, "query long, best long, parts array<long>, searched long, x binary"),
        "queries",
    ).df

    def sub_block(df: DataFrame, part: str, key: str, size: int) -> DataFrame:
        """Rows with the block, by a hash, among as many as the part's size asks for."""
        sizes = df.groupBy(part).agg(F.ceil(F.count("*") / size).alias("blocks"))
        return df.join(sizes, part).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks"))).drop("blocks")

    asked = (
        sub_block(queries, "best", "query", QUERY_BLOCK)
        .select(F.struct("best", "block").alias("block"), F.explode("parts").alias("part"), "query", "x")
        .groupBy("block", "part").agg(F.collect_list(F.struct("query", "x")).alias("q"))
    )
    held = (
        sub_block(placed, "part", "key", BLOCK).groupBy("part", "block")
        .agg(F.collect_list(F.struct("key", "first_id", "x")).alias("c")).drop("block")
    )

    def product(batches):
        for pdf in batches:
            out = []
            for best, block, q, c in zip(pdf["best"], pdf["block"], pdf["q"], pdf["c"]):
                a = np.stack([np.frombuffer(r["x"]) for r in q])
                b = np.stack([np.frombuffer(r["x"]) for r in c])
                first = np.array([r["first_id"] for r in c], np.int64)
                key = np.array([r["key"] for r in c], np.int64)
                score = a @ b.T
                top = _nearest(score, np.broadcast_to(first, score.shape), k + 1)
                score = np.take_along_axis(score, top, 1)
                query = np.array([r["query"] for r in q], np.int64)
                out.append((best, block, *(v.tobytes() for v in (query, key[top], first[top], score))))
            yield pd.DataFrame(out, columns=["best", "block", "query", "key", "first_id", "score"])

    def merge(batches):
        """Rows of a block come one after another; the best of each of its queries are kept."""
        now, best = None, {}

        def found():
            for query, (key, first, score) in best.items():
                yield pd.DataFrame({"query": query, "key": key, "first_id": first, "score": score})

        for pdf in batches:
            out = []
            for at, row in zip(zip(pdf["best"], pdf["block"]), pdf.itertuples()):
                if at != now:
                    out += found()
                    now, best = at, {}
                query = np.frombuffer(row.query, np.int64)
                key, first, score = (
                    np.frombuffer(v, t).reshape(len(query), -1)
                    for v, t in ((row.key, np.int64), (row.first_id, np.int64), (row.score, np.float64))
                )
                for i, q in enumerate(query.tolist()):
                    new = key[i], first[i], score[i]
                    if q in best:
                        new = tuple(map(np.concatenate, zip(best[q], new)))
                        top = _nearest(new[2][None], new[1][None], k + 1)[0]
                        new = tuple(v[top] for v in new)
                    best[q] = new
            if out:
                yield pd.concat(out)
        yield from found()

    packed = (
        asked.join(held, "part").select("block.best", "block.block", "q", "c")
        .mapInPandas(product, "best long, block long, query binary, key binary, first_id binary, score binary")
    )
    near = stage(
        packed.repartition("best", "block").sortWithinPartitions("best", "block")
        .mapInPandas(merge, "query long, key long, first_id long, score double"),
        "near",
    ).df
    # Copies come back: of the vectors found, and of the queries.
    ids = near.join(few.select("key", "vec_id"), "key").select("query", "vec_id", "score")
    ask = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.col("key").alias("query")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    result = (
        ask.join(ids, "query")
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
    searched, asking = queries.agg(F.sum("searched"), F.count("*")).first()
    return result, len(sizes), (searched or 0) / max(1, asking * count)


def _nearest(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, largest first, ties to the smaller first id."""
    return np.lexsort((first, -score), axis=1)[:, :k]
