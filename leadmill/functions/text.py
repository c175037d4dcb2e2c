"""Text cleaning, code mapping and text search."""

from functools import reduce

from pyspark.sql import Column, functions as F

from leadmill.schemas import COURIER_NAMES, SEGMENTS

# The characters that count as surrounding white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Texts the exports use for "empty".
COURIER_BLANKS = ["", "nan", "NaN"]
LEAD_BLANKS = ["", "nan", "NaN", "None"]


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def null_if_in(c: Column, values: list[str]) -> Column:
    """NULL for the given texts. Spark computes c once, which a CASE over c would not do."""
    return reduce(lambda x, value: F.nullif(x, F.lit(value)), values, c)


def strip_quote(c: Column) -> Column:
    """Strip, then drop the leading apostrophes spreadsheets add to force text."""
    return F.ltrim(strip(c), F.lit("'"))


def courier_text(c: Column) -> Column:
    return null_if_in(strip_quote(c), COURIER_BLANKS)


def lead_text(c: Column) -> Column:
    return null_if_in(strip(c), LEAD_BLANKS)


def truncate_text(c: Column, n: int) -> Column:
    """First n characters; empty becomes NULL."""
    return null_if_in(F.substring(c, 1, n), [""])


def valid_segment(c: Column) -> Column:
    return F.when(c.isin(SEGMENTS), c).otherwise("Unknown")


def courier_status(c: Column) -> Column:
    """Order status from the courier's free-form last status.

    CANCELLED means the parcel came back, CANCELED that it was never sent.
    """
    s = F.upper(strip(F.coalesce(c, F.lit(""))))
    return (
        F.when(s.contains("DELIVERED") & ~s.contains("UN"), "completed")
        .when(s.isin("RTS", "CANCELLED", "UNDELIVERED"), "rts")
        .when(s.contains("CANCEL"), "cancelled")
        .otherwise("processing_unpaid")
    )


def courier_name(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    names = F.create_map(*[F.lit(x) for pair in COURIER_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, s), s)


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive search; % and _ in the text are wildcards, a backslash is itself."""
    return c.ilike("%" + text.replace("\\", "\\\\") + "%")


def goods_list(c: Column) -> Column:
    """Comma-separated goods as an array that is never empty."""
    goods = courier_text(c)
    parts = F.filter(F.transform(F.split(goods, ","), strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.coalesce(F.nullif(parts, none), F.array(F.coalesce(goods, F.lit("Unknown"))))
