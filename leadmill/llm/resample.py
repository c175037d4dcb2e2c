"""Importance resampling towards a target distribution, on hashed word n-grams.

Separators are collapsed to single spaces; one overlapped regex scan then emits, at every word,
the spans of the runs of 1 to N words that begin there. Their CRC-32 modulo the number of
buckets is counted over the raw and the target texts. A bucket's gain is the logarithm of the
ratio of its smoothed shares, a document's weight the sum of its features' gains. Gumbel noise
from a hash of the id turns the highest weights into a weighted draw without replacement.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from leadmill.llm.positions import in_order
from leadmill.llm.staging import stage

#: Matches that are counted at once, at least as many as words in the longest run.
BLOCK = 50_000

#: Each byte of a text after lower-casing A-Z; separators are spaces. Bytes beyond ASCII are
#: parts of words, so words of the UTF-8 bytes are words of the characters.
_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_SPACES = re.compile(rb"  +")


@dataclass(frozen=True)
class Features:
    """Runs of 1 to `longest` words, hashed to `buckets` values."""

    longest: int = 3
    buckets: int = 10_000

    def pattern(self):
        """Groups are the runs from a word's start, the longest first; fewer words at the end."""
        runs = rb"([^ ]+)"
        for _ in range(self.longest - 1):
            runs = rb"(" + runs + rb"(?: [^ ]+)?)"
        return regex.compile(rb"(?<![^ ])" + runs + rb"(?![^ ])")

    def scan(self, pattern, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """Number of words and buckets of the features, block by block."""
        clean = _SPACES.sub(b" ", (text or "").encode().translate(_CLEAN)).strip(b" ")
        found = pattern.finditer(clean, overlapped=True)
        rows = [m.groups() for m in islice(found, BLOCK)]
        while rows:
            coming = [m.groups() for m in islice(found, BLOCK)]
            # Runs that reach beyond the end aren't there; blocks before the last look on.
            total = []
            for n, runs in zip(range(self.longest, 0, -1), zip(*rows)):
                missing = max(0, n - 1 - len(coming))
                total.extend(map(crc32, runs[: max(0, len(runs) - missing)]))
            yield len(rows), (np.array(total, np.int64) % self.buckets).astype(np.uint16)
            rows = coming


def scanned(
    docs: DataFrame, features: Features, id_col: str | None = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: id (null without an id_col), n_words and buckets, two bytes a feature."""
    if features.buckets > 1 << 16:
        raise ValueError("a bucket is two bytes")

    def work(batches):
        pattern = features.pattern()
        for batch in batches:
            words, buckets = [], []
            for text in batch.column("text"):
                blocks = list(features.scan(pattern, text.as_py()))
                words.append(sum(n for n, _ in blocks))
                buckets.append(b"".join(at.tobytes() for _, at in blocks))
            columns = [batch.column("id"), pa.array(words, pa.int64()), pa.array(buckets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "buckets"])

    key = F.col(id_col) if id_col else F.lit(None).cast("long")
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n_words long, buckets binary")


def counts(rows: DataFrame, features: Features) -> np.ndarray:
    """Occurrences per bucket over all `scanned` rows: summed per task, then by Spark."""

    def work(batches):
        n = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for at in batch.column("buckets"):
                n += np.bincount(np.frombuffer(at.as_buffer(), np.uint16), minlength=features.buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    found = rows.select("buckets").mapInArrow(work, "bucket long, n long")
    total = np.zeros(features.buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the target's smoothed share to the raw one, per bucket."""
    k = len(raw)
    s_all, t_all = int(raw.sum()) + k, int(target.sum()) + k
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all)))
            for s, t in zip(raw.tolist(), target.tolist())
        ],
        np.int64,
    )


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per `scanned` row: its id, n_words, n_features and weight."""

    def work(batches):
        for batch in batches:
            sums = []
            for at in batch.column("buckets"):
                at = np.frombuffer(at.as_buffer(), np.uint16)
                sums.append((len(at), int(gain[at].sum())))
            columns = np.array(sums, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), *map(pa.array, columns)],
                ["id", "n_words", "n_features", "weight"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 times a Gumbel value), from SHA-256 of seed and id; null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    features: Features = Features(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row of docs: its id, n_words, n_features, weight, score and rank.

    Of the N rows with an id and at least `min_words` words, floor(percent * N / 100) are drawn,
    those of the highest score; ties go to the smaller id. They are ranked from 1, others have
    no rank. Null and empty texts have no features and weigh 0. Rows without an id have neither
    score nor rank. Repeated rows are drawn one by one, each with a rank of its own. An empty
    target or no documents give the same shares everywhere and thus gains of the smoothed raw
    counts alone. Columns of docs and target beyond id and text are not read.
    """
    # Texts are scanned once; their buckets, about as many bytes as the texts, are read twice.
    found = stage(scanned(docs, features, id_col, text_col), "features")
    gain = gains(counts(found.df, features), counts(scanned(target, features, None, text_col), features))
    scored = weigh(found.df, gain).withColumnRenamed("id", id_col)
    scored = stage(scored.withColumn("score", F.col("weight") + noise(id_col, seed)), "weights").df
    found.drop()
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    drawn = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.asc(id_col)]
    placed = in_order(scored.where(able), order, "drawn").df
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    none = F.lit(None).cast("long")
    return (
        placed.withColumn("rank", rank)
        .drop("place")
        .unionByName(scored.where(~able).withColumn("rank", none))
    )
