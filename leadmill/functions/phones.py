"""Phone numbers: one rule per source of the number."""

from pyspark.sql import Column, functions as F

from leadmill.functions.numbers import integer_text
from leadmill.functions.text import null_if_in, strip_quote


def normalize_phone(c: Column) -> Column:
    """Digits in country form 62..., at most 13 of them; NULL if it cannot be a phone."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    local = F.regexp_replace(digits, "^(?:0|(?=8))", "62")
    return F.when(local.startswith("62") & (F.length(local) >= 10), F.substring(local, 1, 13))


def courier_phone(c: Column) -> Column:
    """Phone of the courier export: country code added, no check of the rest."""
    s = null_if_in(F.translate(strip_quote(c), " -", ""), ["", "nan"])
    return F.regexp_replace(s, "^(?:0|(?!62))", "62")


def lead_phone(c: Column) -> Column:
    """Phone of the lead export, where it arrives as a number such as 628123.0."""
    return integer_text(c)
