"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from leadmill.llm.staging import stage


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the smallest node of its component, for all nodes with an edge but roots.

    Each round joins edges to the least neighbour of a node, which is found with partial sums
    on the map side; so a node with very many edges is no single task's work. The number of
    rounds grows with the logarithm of the number of nodes.
    """
    now = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(first, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        new = stage(small, "edges")
        now.drop()
        now = new
        last, mark = mark, now.df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == last or mark[0] == 0:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
