"""Substring search by posting lists of trigrams.

A text that contains a pattern contains every run of three characters of the pattern's literal
parts. For each column and trigram, the index lists the buckets of a stored table in which some
value has it. A search intersects the lists of its trigrams, reads the buckets that are left, and
tests their rows with the same LIKE as without an index. Patterns without a literal run of three
characters read all buckets.
"""

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.functions.phones import normalize_phone

WIDTH = 3


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a text in lower case, as an array."""
    text = F.lower(c)
    count = F.length(text) - (WIDTH - 1)
    places = F.when(count > 0, F.sequence(F.lit(1), count))
    return F.array_distinct(F.transform(places, lambda k: F.substring(text, k, F.lit(WIDTH))))


def trigram_index(df: DataFrame, columns: Sequence[str], bucket: Column) -> DataFrame:
    """column, gram and bucket: one row for each bucket with such a value in such a column."""
    lists = F.array(
        *[F.struct(F.lit(c).alias("column"), trigrams(F.col(c)).alias("grams")) for c in columns]
    )
    rows = df.select(bucket.alias("bucket"), F.explode(lists).alias("l"))
    return rows.select("l.column", F.explode("l.grams").alias("gram"), "bucket").distinct()


def pattern_grams(text: str) -> list[str]:
    """Trigrams that every text like %text% has; % and _ in it are wildcards."""
    runs = [r.lower() for r in re.split("[%_]", text)]
    return sorted({r[k : k + WIDTH] for r in runs for k in range(len(r) - WIDTH + 1)})


def candidate_buckets(index: DataFrame, wanted: Mapping[str, str]) -> set[int] | None:
    """Buckets that can hold a row with wanted[column] in each column; None: any bucket.

    A text and its lower case may differ in length in few scripts, so a run is looked up as its
    lower case is.
    """
    found = None
    for column, text in wanted.items():
        grams = pattern_grams(text)
        if not grams:
            continue
        lists = index.filter((F.col("column") == column) & F.col("gram").isin(grams))
        full = lists.groupBy("bucket").agg(F.count_distinct("gram").alias("n"))
        # As many as there are buckets at most.
        here = {r["bucket"] for r in full.filter(F.col("n") == len(grams)).collect()}
        found = here if found is None else found & here
    return found


def customer_patterns(
    df: DataFrame, search: str | None = None, province: str | None = None
) -> dict[str, str]:
    """The texts by column that filter_customers(search=..., province=...) looks for."""
    wanted = {}
    if search:
        one = df.sparkSession.range(1).select(normalize_phone(F.lit(search)).alias("phone"))
        phone = one.first()["phone"]
        wanted["customer_id" if phone else "name"] = phone or search
    if province:
        wanted["province"] = province
    return wanted
