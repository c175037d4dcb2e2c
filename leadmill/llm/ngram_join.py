"""Jaccard self-join of documents on word shingles, filtered under several global orders.

If two sets are similar enough, then under any one order of all shingles the first few of each
set, its prefix, share a shingle. Here shingles are ordered by how common they are, in coarse
classes, and within a class by a random order. Candidates share a prefix shingle under the
first order, by an inverted index; of them, those stay that also share one under each of the
other orders; what stays is verified on the whole sets. Where the first common shingle stands
far back in the order, too few can follow, so such candidates aren't made.

Equal sets are joined by a digest and go on as one representative. Large groups of near copies
would still give all their pairs. Therefore each representative is first compared with one
other only, a hub: the one that comes first in a random ranking of those it shares a prefix
shingle with. Those that share one with another component are then compared with HUBS further
ones. Pairs that are then in one component need no comparison; all others are compared.

A set's profile counts its shingles by ranges of their hash. Two sets share in each range at most
the smaller of their counts, so the join itself drops pairs whose profiles leave too little room.
"""

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from leadmill.llm.components import connected
from leadmill.llm.shingles import mix, shingle_set
from leadmill.llm.staging import Staged, stage, to_texts

#: Places of the table that counts shingles by hash; it has this fixed size at any scale.
SKETCH_BITS = 22
_BLOCKS = 64
#: Hubs of each round, the most rounds, and ranges of a profile in the index.
HUBS, ROUNDS = 8, 2
PLACES = 64
#: Partial counts of one block that are added up by one task.
_FAN_IN = 64
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)


@dataclass(frozen=True)
class Similarity:
    """Shingles of `words` words; linked if 100 * intersection >= percent * union."""

    words: int = 4
    percent: int = 85

    def prefix(self, n: int) -> int:
        return n - -(-n * self.percent // 100) + 1

    def room(self, n: str, pos: str, n2: str, pos2: str):
        """Whether sets of these sizes, whose first common shingle has these positions in the
        order, can be similar enough: all common ones stand there or later. A pair that is
        similar passes at its first common shingle."""
        most = F.least(F.col(n) - F.col(pos), F.col(n2) - F.col(pos2))
        return (100 + self.percent) * most >= self.percent * (F.col(n) + F.col(n2))


    def fits(self, n: str, profile: str, n2: str, profile2: str):
        """Whether profiles leave room for enough common shingles; a clipped count always does."""
        a, b = F.col(profile), F.col(profile2)
        most = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        clipped = F.greatest(F.array_max(a), F.array_max(b)) == 32767
        return clipped | ((100 + self.percent) * most >= self.percent * (F.col(n) + F.col(n2)))


def _signatures(docs: DataFrame, how: Similarity) -> DataFrame:
    """Per document: n, digests s1 and s2 and the profile of its set; per task: the blocks of its
    counts."""

    def work(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        shift = np.uint64(64 - SKETCH_BITS)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                h = shingle_set(text, how.words)
                np.add.at(counts, (h >> shift).astype(np.int64), 1)
                s1, s2 = (int(mix(h ^ s).sum(dtype=np.uint64).view(np.int64)) for s in _SEEDS[:2])
                at = (h >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
                profile = np.minimum(np.bincount(at, minlength=PLACES), 32767).astype(np.int16)
                rows.append((i, len(h), s1, s2, profile))
            out = pd.DataFrame(rows, columns=["id", "n", "s1", "s2", "profile"])
            yield out.astype({"id": "Int64"}).assign(block=pd.array([None] * len(out), "Int64"), counts=None)
        if counts.any():
            parts = np.split(counts, _BLOCKS)
            none = pd.array([None] * _BLOCKS, "Int64")
            yield pd.DataFrame(
                {"id": none, "n": none, "s1": none, "s2": none, "profile": None,
                 "block": pd.array(range(_BLOCKS), "Int64"), "counts": [p.tobytes() for p in parts]}
            )

    return docs.mapInPandas(
        work,
        "id long, n long, s1 long, s2 long, profile array<smallint>, block long, counts binary",
    )


def _classes(counts: DataFrame) -> np.ndarray:
    """How common the shingles of each place of the table are: 0 for about the mean or less.

    Partial counts are added up in a tree, so that no task gets those of all tasks.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // _BLOCKS, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.int32 if len(c) == 4 * len(total) else np.int64)
        return pd.DataFrame({"block": pdf["block"][:1], "part": pdf["part"][:1], "counts": [total.tobytes()]})

    now = stage(counts.withColumn("part", F.spark_partition_id()).select("block", "part", "counts"), "counts")
    while (top := now.df.agg(F.max("part"), F.count("*")).first())[0] is not None:
        added = stage(
            now.df.withColumn("part", F.floor(F.col("part") / _FAN_IN).cast("int"))
            .groupBy("block", "part")
            .applyInPandas(add, "block long, part int, counts binary"),
            "counts",
        )
        now.drop()
        now = added
        if top[0] < _FAN_IN:
            break
    table = np.zeros((_BLOCKS, (1 << SKETCH_BITS) // _BLOCKS), np.int64)
    for r in now.df.toLocalIterator():
        table[r.block] += np.frombuffer(r.counts, np.int64)
    now.drop()
    mean = table.mean()
    usual = mean + 3 * np.sqrt(mean) + 2
    out = np.empty(table.shape, np.uint8)
    for block, counts_ in zip(out, table):
        block[:] = np.ceil(np.log2(np.maximum(counts_ / usual, 1)))
    return out.reshape(-1)


def _prefix(h: np.ndarray, classes: np.ndarray, order: int, how: Similarity) -> np.ndarray:
    """The first shingles of a set under an order, in that order."""
    k = how.prefix(len(h))
    common = classes[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    rank = (common << np.uint64(58)) | (mix(h ^ _SEEDS[order]) >> np.uint64(6))
    first = np.argpartition(rank, k - 1)[:k] if k < len(h) else np.arange(len(h))
    return h[first[np.argsort(rank[first])]]


def _postings(docs: DataFrame, classes, how: Similarity) -> DataFrame:
    """token, id, n and pos for each shingle of each document's prefix under the first order."""

    def frame(block):
        sizes = [len(p) for p, _, _ in block]
        return pd.DataFrame(
            {
                "token": np.concatenate([p.view(np.int64) for p, _, _ in block]),
                "id": np.repeat([i for _, i, _ in block], sizes),
                "n": np.repeat([n for _, _, n in block], sizes),
                "pos": np.concatenate([np.arange(k) for k in sizes]),
            }
        )

    def work(batches):
        table = classes.value
        for pdf in batches:
            block, held = [], 0
            for i, text in zip(pdf["id"], pdf["text"]):
                h = shingle_set(text, how.words)
                if not len(h):
                    continue
                block.append((_prefix(h, table, 0, how), i, len(h)))
                held += len(block[-1][0])
                if held > 200_000:
                    yield frame(block)
                    block, held = [], 0
            if block:
                yield frame(block)

    return docs.where("id is not null").mapInPandas(work, "token long, id long, n long, pos long")


def _possible(pairs: DataFrame, profiles: DataFrame, how: Similarity) -> DataFrame:
    """The pairs whose profiles leave room for enough common shingles; this loses no link."""
    side = lambda c: profiles.select(*[F.col(x).alias(f"{x}_{c}") for x in profiles.columns])
    return (
        pairs.join(side("a"), F.col("a") == F.col("rep_a"))
        .join(side("b"), F.col("b") == F.col("rep_b"))
        .where(how.fits("n_a", "profile_a", "n_b", "profile_b"))
        .select("a", "b").distinct()
    )


def _links(pairs: DataFrame, texts: DataFrame, classes, how: Similarity) -> DataFrame:
    """The pairs (a, b) whose sets pass the other orders' filters and are similar enough."""
    pairs = stage(pairs, "pairs").df

    def work(batches):
        table, known = classes.value, OrderedDict()

        def of(i, text):
            if (i, text) not in known:
                h = shingle_set(text, how.words)
                known[i, text] = h, [np.sort(_prefix(h, table, k, how)) for k in range(1, len(_SEEDS))]
                if len(known) > 64:
                    known.popitem(last=False)
            return known[i, text]

        for pdf in batches:
            keep = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
                (x, px), (y, py) = of(a, ta), of(b, tb)
                good = all(len(np.intersect1d(p, q, True)) for p, q in zip(px, py))
                if good:
                    both = len(np.intersect1d(x, y, True))
                    good = 100 * both >= how.percent * (len(x) + len(y) - both)
                keep.append(good)
            yield pdf.loc[keep, ["a", "b"]]

    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(work, "a long, b long").distinct()


def _several(index: DataFrame, column: str) -> DataFrame:
    """The rows of index whose token has at least two values of the column."""
    tokens = index.groupBy("token").agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return index.join(tokens.where("low < high").select("token"), "token")


_SIDE = ["rep", "n", "pos", "comp", "profile"]


def _labelled(index: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of index with the component of their representative."""
    joined = index.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return joined.withColumn("comp", F.coalesce("root", "rep")).drop("root")


def _between(index: DataFrame, roots: DataFrame) -> Staged:
    """The rows of index, with component, whose token several components have."""
    labelled = stage(_labelled(index, roots), "index")
    rest = stage(_several(labelled.df, "comp"), "index")
    labelled.drop()
    return rest


def _met(x: DataFrame, y: DataFrame, how: Similarity, order: Column | None = None) -> DataFrame:
    """Pairs (a, b), a before b, of different components that share a token and may be similar;
    of both directions of a pair, those that are in `order`."""
    return (
        x.join(y, "token")
        .where(
            (F.col("comp_x") != F.col("comp_y"))
            & (F.lit(True) if order is None else order)
            & how.room("n_x", "pos_x", "n_y", "pos_y")
            & how.fits("n_x", "profile_x", "n_y", "profile_y")
        )
        .select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: its id, n_shingles, component_id and the class of equal sets.

    component_id is the smallest id that links lead to, class_id the smallest id with an equal
    set. Texts that are null or without words have no shingles and no links. Rows that share an
    id are one document, linked by whichever of their texts. Rows without an id have no links
    and null as component. Other columns are not carried; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = stage(_signatures(docs, how), "signatures")
    sets = made.df.where("block is null").select("id", "n", "s1", "s2")
    classes = spark.sparkContext.broadcast(_classes(made.df.where("block is not null")))

    first = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    whole = stage(
        sets.where("n > 0 and id is not null").join(first, ["n", "s1", "s2"]).select("id", "n", "rep")
        .unionByName(sets.where("n = 0 or id is null").select("id", "n", F.col("id").alias("rep"))),
        "classes",
    )
    # A representative's profile; one whose rows have several sets has room for all.
    own = made.df.where("block is null and n > 0").join(first, ["n", "s1", "s2"]).where("id = rep")
    low, high = F.min("profile"), F.max("profile")
    profiles = stage(
        own.groupBy("rep").agg(
            F.max("n").alias("n"),
            F.when(low == high, low).otherwise(
                F.array_repeat(F.lit(32767).cast("smallint"), PLACES)
            ).alias("profile"),
        ),
        "profiles",
    )
    made.drop()

    # The index: prefix shingles that at least two representatives have.
    postings = stage(_postings(docs, classes, how), "postings")
    shared = postings.df.groupBy("token").count().where("count > 1").select("token")
    members = whole.df.where("n > 0 and id is not null").select("id", "rep").distinct()
    index = postings.df.join(shared, "token").join(members, "id").select("token", "rep", "n", "pos").distinct()
    index = stage(_several(stage(index, "index").df, "rep").withColumn("comp", F.col("rep")), "index")
    postings.drop()
    needed = to_texts(index.df.select(F.col("rep").alias("id")).distinct(), "needed")
    wanted = docs.where("id is not null").join(needed, "id", "left_semi")
    again = to_texts(whole.df.groupBy("id").count().where("count > 1").select("id"), "again")
    if not again.isEmpty():
        # Rows that repeat an id are brought together; all other texts stay where they are.
        wanted = wanted.join(again, "id", "left_anti").unionByName(
            wanted.join(again, "id", "left_semi").distinct()
        )
    texts = stage(wanted, "texts")

    # One comparison for each representative.
    rank = F.struct(F.xxhash64("rep").alias("k"), "rep", "n", "pos")
    best = index.df.groupBy("token").agg(F.min(rank).alias("hub"))
    hubs = (
        index.df.join(best, "token")
        .where((F.col("rep") != F.col("hub.rep")) & how.room("n", "pos", "hub.n", "hub.pos"))
        .groupBy("rep").agg(F.min("hub").alias("hub"))
        .select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"))
    )
    links = stage(_links(_possible(hubs, profiles.df, how), texts.df, classes, how), "links")
    roots = stage(connected(links.df), "roots")
    rest = _between(index.df.drop("comp"), roots.df)
    index.drop()

    # In large groups, those that may have links to other components are compared with a few more
    # each, once again if that finds many links: few pairs of such groups are left then.
    often = rest.df.groupBy("token").count().where(F.col("count") > HUBS).select("token")
    big = stage(rest.df.join(often, "token").join(profiles.df.select("rep", "profile"), "rep"), "index")
    linked = links.df
    many = big.df.select("rep").distinct().count() // 20
    for turn in range(ROUNDS if many else 0):
        ranks = [
            F.min(F.struct(F.xxhash64("rep", F.lit(turn * HUBS + k)).alias("k"), "rep", "n", "pos", "comp", "profile"))
            for k in range(HUBS)
        ]
        few = (
            big.df.groupBy("token").agg(F.array(*ranks).alias("hubs"))
            .select("token", F.explode("hubs").alias("hub")).select("token", "hub.*").drop("k").distinct()
            .select("token", *[F.col(c).alias(f"{c}_y") for c in _SIDE])
        )
        side = big.df.select("token", *[F.col(c).alias(f"{c}_x") for c in _SIDE])
        more = stage(_links(_met(side, few, how), texts.df, classes, how), "links")
        linked = linked.unionByName(more.df)
        roots = stage(connected(linked), "roots")
        if more.df.count() < many:
            break
        left = stage(_labelled(big.df.drop("comp"), roots.df), "index")
        big.drop()
        big = left
    big.drop()
    last = _between(rest.df.drop("comp"), roots.df)
    rest.drop()
    rest = stage(last.df.join(profiles.df.select("rep", "profile"), "rep"), "index")
    last.drop()

    # All pairs that are not yet in one component.
    x, y = (rest.df.select("token", *[F.col(c).alias(f"{c}_{s}") for c in _SIDE]) for s in "xy")
    pairs = _met(x, y, how, F.col("rep_x") < F.col("rep_y"))
    every = stage(_links(pairs, texts.df, classes, how), "links")
    rest.drop()
    texts.drop()
    final = connected(linked.unionByName(every.df))
    return whole.df.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "rep").alias("component_id"),
        F.col("rep").alias("class_id"),
    )


def deduplicate(
    docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs that are first in their component, with all their columns.

    Rows that share an id stay or go together; rows without an id or without words all stay.
    """
    found = near_duplicates(docs, how, id_col, text_col)
    later = found.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("later"))
    later = to_texts(later.distinct(), "later")
    # Within a struct, the columns of docs can't clash with the helper's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(later, F.col(f"row.`{id_col}`") == F.col("later"), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
