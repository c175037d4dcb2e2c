"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Words keep their lower-case form; numbers, units (after a number) and names (capitalised words
within a sentence) become typed placeholders. Windows of this template are joined by hash, so a
question is found although its values were exchanged. The values then have to be consistent:
along one alignment of a document with an item, equal values of the item must stand for equal
values of the document.
"""


from pyspark.sql import Column, DataFrame, functions as F

from leadmill.llm.staging import stage, to_texts

#: Tokens of a window, and how many of them must be words.
WINDOW = 6
MIN_WORDS = 3
#: Share of an item's windows that a document must have.
COVERAGE = 0.6
#: A benchmark of up to so many windows (some 150 bytes each) is broadcast.
MAX_BROADCAST = 500_000

#: Units of measure and of money.
UNITS = (
    "%", "$", "€", "£", "°", "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches",
    "foot", "feet", "mile", "miles", "meter", "meters", "metre", "metres", "mg", "g", "kg", "t",
    "oz", "lb", "lbs", "gram", "grams", "kilogram", "kilograms", "ml", "cl", "l", "liter",
    "liters", "litre", "litres", "s", "sec", "min", "h", "hr", "second", "seconds", "minute",
    "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year",
    "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "kmh", "mph",
    "w", "kw", "v", "hz", "kb", "mb", "gb", "tb", "c", "f", "k",
)

_TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+[.!?]?|[%$€£°]"


def _templates(rows: DataFrame, text: str) -> DataFrame:
    """Replace the text by hs, the hashes of its template's tokens, and slots: at placeholders
    the hash of the value that stands there, else 0. A null or empty text has no tokens."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    number = "({0} >= '0' AND {0} < ':')"
    before = "tokens[greatest(i - 1, 0)]"
    word = "lower(trim(TRAILING '.!?' FROM t))"
    template = f"""transform(tokens, (t, i) -> CASE
        WHEN {number.format("t")} THEN '<num>'
        WHEN i > 0 AND {number.format(before)} AND {word} IN ({units}) THEN '<unit>'
        WHEN i > 0 AND substr(t, 1, 1) <> lower(substr(t, 1, 1))
             AND right({before}, 1) NOT IN ('.', '!', '?') THEN '<name>'
        ELSE {word} END)"""
    placeholder = "IN ('<num>', '<unit>', '<name>')"
    return (
        rows.withColumn("tokens", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), 0))
        .drop(text)
        .withColumn("template", F.expr(template))
        .withColumn("hs", F.expr("transform(template, x -> xxhash64(x))"))
        .withColumn(
            "slots",
            F.expr(f"transform(tokens, (t, i) -> if(template[i] {placeholder}, xxhash64({word}), 0L))"),
        )
        .drop("tokens", "template")
    )


def _windows(rows: DataFrame, *keep: str) -> DataFrame:
    """pos, hash and slots of each window of the template; none, if the template is short.

    Short ones are not filtered out: Spark would move such a filter below the tokens, and read
    the tokens anew for each word.
    """
    starts = f"sequence(1, greatest(size(hs) - {WINDOW - 1}, 1))"
    windows = F.expr(
        f"if(size(hs) < {WINDOW}, array(), transform({starts}, "
        f"i -> struct(i AS pos, xxhash64(slice(hs, i, {WINDOW})) AS h, slice(slots, i, {WINDOW}) AS slots)))"
    )
    return rows.select(*keep, F.explode(windows).alias("w")).select(*keep, "w.*")


def row_key(id_col: str, text_col: str) -> Column:
    """Stands for a document, with or without an id; repeated rows share it."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The items that documents contain, exactly or with other values.

    One row per document and item: row_key, the document's id, item_id, windows_found,
    item_windows, and values_kept (whether all values are the item's own). Documents repeated
    with id and text count once; texts that are null, empty or shorter than a window contain
    nothing. Items (item_id, text) without a window of enough words are never found; repeated
    items count once.
    """
    items = _templates(benchmark.select("item_id", F.col("text").alias("t")).distinct(), "t")
    wanted = (
        _windows(items.where("item_id is not null"), "item_id")
        .withColumnsRenamed({"pos": "item_pos", "slots": "wanted"})
        .where(F.size(F.filter("wanted", lambda x: x == 0)) >= MIN_WORDS)
    )
    wanted = stage(wanted, "items").df
    few = wanted.count() <= MAX_BROADCAST
    rows = docs.select(
        row_key(id_col, text_col).alias("row_key"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("t"),
    )
    hits = _windows(_templates(rows, "t"), "row_key", "id").join(
        F.broadcast(wanted) if few else wanted, "h"
    )
    pairs = stage(
        hits.select(
            "row_key", "id", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"),
            F.expr("filter(arrays_zip(wanted, slots), s -> s.wanted <> 0)").alias("slots"),
        ).distinct(),
        "pairs",
    ).df
    alignment = ["row_key", "item_id", "shift"]
    slots = (
        pairs.select(*alignment, F.explode("slots").alias("s"))
        .groupBy(*alignment, "s.wanted")
        .agg(F.min("s.slots").alias("low"), F.max("s.slots").alias("high"))
        .groupBy(*alignment)
        .agg(
            F.max(F.col("low") != F.col("high")).alias("torn"),
            F.min((F.col("low") == F.col("wanted")) & (F.col("high") == F.col("wanted"))).alias("kept"),
        )
    )
    total = wanted.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows"))
    return (
        pairs.join(slots, alignment, "left")
        .where(F.coalesce(~F.col("torn"), F.lit(True)))
        .groupBy("row_key", "id", "item_id", "item_pos")
        .agg(F.max(F.coalesce("kept", F.lit(True))).alias("kept"))
        .groupBy("row_key", "id", "item_id")
        .agg(F.count("*").alias("windows_found"), F.min("kept").alias("values_kept"))
        .join(total, "item_id")
        .where(F.col("windows_found") >= COVERAGE * F.col("item_windows"))
        .select(
            "row_key", F.col("id").alias(id_col), "item_id", "windows_found", "item_windows",
            "values_kept",
        )
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    found = find(docs, benchmark, id_col, text_col)
    bad = to_texts(found.select(F.col("row_key").alias("bad")).distinct(), "contaminated")
    # Within a struct, the columns of docs can't clash with the helper's.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, row_key(id_col, text_col).alias("key"))
    kept = rows.join(bad, F.col("key") == F.col("bad"), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
