"""Shards by extendible hashing, with DataFrame functions only.

Documents have a 60-bit hash. A directory is indexed by the hash's first bits; a bucket whose
documents exceed the byte limit, and only such a bucket, is split on its next bit until every
bucket fits or holds a single hash value. The directory is computed from sums of bytes per
prefix, not by moving documents, and several bits at a time.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.llm.staging import stage

BITS = 60
#: Bits by which buckets are split further where the first directory doesn't do.
STEP = 8


def _hash(id_col: str, text_col: str) -> Column:
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.col(text_col)), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash and bytes of each document; documents without an id are hashed by their text."""
    return docs.select(
        F.col(id_col).alias("id"),
        _hash(id_col, text_col).alias("h"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"),
    )


def _prefix(bits: int):
    return F.shiftright("h", BITS - bits)


def directory(sizes: DataFrame, max_bytes: int, first: int, last: int) -> DataFrame:
    """For each prefix of `last` bits: the shallowest bucket of at least `first` bits that fits.

    prefix, depth, bucket (the bucket's own bits), shard_bytes, shard_docs; depth is null if
    the prefix itself must be split.
    """
    leaves = sizes.groupBy(_prefix(last).alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("docs"),
        F.min("h").alias("low"), F.max("h").alias("high"),
    )
    levels = leaves.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn(
        "bucket", F.expr(f"shiftright(prefix, {last} - depth)")
    )
    fits = (
        levels.groupBy("depth", "bucket")
        .agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
        .where((F.col("shard_bytes") <= max_bytes) | (F.col("low") == F.col("high")))
    )
    found = (
        levels.select("prefix", "depth", "bucket")
        .join(fits, ["depth", "bucket"])
        .groupBy("prefix")
        .agg(F.min(F.struct("depth", "bucket", "shard_bytes", "shard_docs")).alias("b"))
    )
    return leaves.select("prefix").join(found, "prefix", "left").select("prefix", "b.*")


def assign_shards(
    docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A shard for each row of docs.

    Columns: the id, shard_depth (bits), shard_prefix (their value), shard_bytes, shard_docs.
    Every shard has at most max_bytes of text, unless it holds one hash value only: a longer
    document alone, or repeated rows of one id. Null and empty texts have 0 bytes. Other
    columns aren't carried. An empty table has no shards.
    """
    # Without the texts, a row is a few bytes; the rounds below read this table only.
    sizes = stage(hashed(docs, id_col, text_col), "sizes").df
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    first, last = 0, min(BITS, 2 + max(0, math.ceil(math.log2(max(1, total / max_bytes)))))
    rest, done = sizes, None
    while True:
        found = stage(directory(rest, max_bytes, first, last), "directory").df
        placed = rest.withColumn("prefix", _prefix(last)).join(found, "prefix")
        out = placed.where("depth is not null").select(
            F.col("id").alias(id_col),
            F.col("depth").cast("int").alias("shard_depth"),
            F.col("bucket").alias("shard_prefix"),
            "shard_bytes",
            "shard_docs",
        )
        done = out if done is None else done.unionByName(out)
        if last == BITS or found.where("depth is null").isEmpty():
            return done
        rest = placed.where("depth is null").select("id", "h", "bytes")
        first, last = last + 1, min(BITS, last + STEP)


def write_shards(
    docs: DataFrame, shards: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write docs as Parquet, a folder per shard of assign_shards(docs, ...).

    A row's shard follows from its own hash, so rows without an id and repeated rows are all
    written. Folders are named by a column `shard`, with as many underscores behind it as needed
    to differ from the columns of docs. Rows of other tables than docs, whose hash is in no
    shard, are not written.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    places = shards.select("shard_depth", "shard_prefix").distinct()
    # At most BITS + 1 depths; each hash is in one bucket of one of them.
    depths = sorted(r[0] for r in places.select("shard_depth").distinct().collect())
    hashes = hashed(docs, id_col, text_col).select("h").distinct()
    levels = hashes.select("h", F.explode(F.array(*map(F.lit, depths)).cast("array<int>")).alias("shard_depth"))
    levels = levels.withColumn("shard_prefix", F.expr(f"shiftright(h, {BITS} - shard_depth)"))
    found = levels.join(places, ["shard_depth", "shard_prefix"]).select(
        "h", F.concat_ws("-", "shard_depth", "shard_prefix").alias("place")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), _hash(id_col, text_col).alias("h"))
    placed = rows.join(found, "h").select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("place").alias(name)
    )
    placed.repartition(name).write.partitionBy(name).parquet(folder)


def oracle(max_bytes: int) -> str:
    """The result in DuckDB's SQL: each document's shallowest prefix that fits."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS b,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents
), levels AS (
  SELECT doc_id, b, h, k, h >> (60 - k) AS q FROM d, (SELECT unnest(range(0, 61)) AS k)
), buckets AS (
  SELECT k, q, sum(b) AS bytes, count(*) AS docs FROM levels
  GROUP BY k, q HAVING sum(b) <= {max_bytes} OR min(h) = max(h)
), found AS (
  SELECT doc_id, min(k) AS k FROM levels JOIN buckets USING (k, q) GROUP BY doc_id
)
SELECT doc_id, CAST(k AS INTEGER) AS shard_depth, CAST(q AS BIGINT) AS shard_prefix,
       CAST(bytes AS BIGINT) AS shard_bytes, CAST(docs AS BIGINT) AS shard_docs
FROM found JOIN levels USING (doc_id, k) JOIN buckets USING (k, q)
"""
