"""Numbers from text. Text that is no finite number gives NULL, never an error."""

from pyspark.sql import Column, functions as F

from leadmill.functions.text import strip
from leadmill.schemas import MONEY

# Plain and exponent notation. A cast alone would also take "12d", "inf" and "nan".
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number_text(c: Column) -> Column:
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER), s)


def to_num(c: Column, type_name: str = "double") -> Column:
    """Number of the given type; fractions are rounded for whole-number types."""
    s = number_text(c)
    if type_name in ("int", "bigint"):
        return F.round(s.try_cast("double")).try_cast(type_name)
    return s.try_cast(type_name)


def parse_rupiah(c: Column) -> Column:
    """'Rp277,065' -> 277065.00"""
    return to_num(F.replace(F.replace(c, F.lit("Rp"), F.lit("")), F.lit(","), F.lit("")), MONEY)


def integer_text(c: Column) -> Column:
    """'123.0' -> '123': the whole part of a number, as text."""
    return number_text(c).try_cast("double").try_cast("bigint").cast("string")


def id_text(c: Column) -> Column:
    """Ids that were exported as floats: '123.0' -> '123'. Text that is no number stays as it
    is, but for '' and 'nan', which give NULL."""
    s = strip(c.cast("string"))
    return F.coalesce(integer_text(c), F.when(~F.lower(s).isin("", "nan"), s))


def null_if_nan(c: Column) -> Column:
    """Floating-point NaN -> NULL."""
    return F.when(~F.isnan(c), c)


def to_flag(c: Column, true_values: tuple[str, ...] = ("True", "1")) -> Column:
    return F.when(c.isin(*true_values), 1).otherwise(0)


def default_qty(c: Column) -> Column:
    return F.coalesce(to_num(c, "bigint"), F.lit(1).cast("bigint"))


def whole_amount(c: Column, default: int) -> Column:
    """Number cut to its whole part; missing, unreadable or zero gives the default."""
    x = F.nullif(to_num(c), F.lit(0.0))
    return F.coalesce(x, F.lit(float(default))).try_cast("bigint")


def payment_from_cod(c: Column) -> Column:
    return F.when(to_num(c) > 0, "COD").otherwise("Bank Transfer")


def mean(total: Column, count: Column, scale: int = 4) -> Column:
    """Average of exact money, rounded half up as a decimal; NULL for no rows."""
    return F.round(F.try_divide(total, count), scale).cast("double")
