"""A training corpus from `documents`: stages that each apply one operator of leadmill.llm.

Toxic documents go, one document of each near-duplicate group stays, passages that an earlier
document has are cut out, documents with benchmark items go, and what is left is encoded.
"""

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadmill.llm import bpe, decontaminate, ngram_join, passages, toxicity
from leadmill.llm.queries import VOCABULARY
from leadmill.llm.staging import stage
from leadmill.llm.tables import table

#: The same ids with less memory: the stages before have filled the executors' Python workers.
ENCODING = replace(VOCABULARY, cache=0.4)
#: Near-duplicate documents: five words, similarity of 0.8.
NEAR = ngram_join.Similarity(words=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs, NEAR)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; one that repeats others as a whole ends with an empty text."""
    kept = passages.remove(docs, passages.repeated(docs))
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, ENCODING)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Learning, min-hashes and the encoder are beyond SQL; tests hold the stages to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
