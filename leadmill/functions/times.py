"""Timestamps (UTC wall clock), calendar labels and ages relative to an explicit as_of."""

from datetime import datetime

from pyspark.sql import Column, functions as F

from leadmill.functions.text import strip

ISO_START = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T]|$)"
ISO_WITH_ZONE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T].*[0-9]\s*(Z|UTC|[+-][0-9]{2}(:?[0-9]{2})?)$"
MINUTES_THEN_ZONE = r"([ T][0-9]{1,2}:[0-9]{1,2})\s*(Z|UTC|[+-])"
SLASHES = r"^[0-9]+/[0-9]+/[0-9]+"
# Month first; day first only where that cannot be a month.
SLASH_FORMATS = [
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm",
    "d/M/yyyy", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
]
# Other spellings: what a text looks like, and how it is read.
OTHER_FORMATS = [
    (r"^[0-9]{8}$", "yyyyMMdd"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}( |$)", "d-M-yyyy[ H:mm[:ss]]"),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}( |$)", "d MMM yyyy[ H:mm[:ss]]"),
]
HALF_DAY = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}(:[0-9]{2})? ?[AaPp][Mm]$"


def as_timestamp(value: str | datetime | Column) -> Column:
    """A timestamp argument such as as_of; Spark folds it to a literal."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def to_ts(c: Column) -> Column:
    """ISO text (also with AM or PM), or one of a few other formats; anything else gives NULL."""
    return _wall_clock(strip(c))


def _wall_clock(s: Column) -> Column:
    # A failed parse is slow, so the slash formats are only tried on text with slashes.
    slashes = [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in SLASH_FORMATS]
    half = F.regexp_replace(F.upper(s), " ?([AP]M)$", " $1")
    read = F.when(s.rlike(HALF_DAY), _parsed(half, "yyyy-M-d h:mm[:ss] a"))
    read = read.when(s.rlike(ISO_START), s.try_cast("timestamp_ntz"))
    read = read.when(s.rlike(SLASHES), F.coalesce(*slashes))
    for looks, form in OTHER_FORMATS:
        read = read.when(s.rlike(looks), _parsed(s, form))
    return read


def _parsed(s: Column, form: str) -> Column:
    return F.try_to_timestamp(s, F.lit(form)).cast("timestamp_ntz")


def courier_date(c: Column) -> Column:
    """dd-MM-yyyy HH:mm; anything else gives NULL."""
    return F.try_to_timestamp(strip(c), F.lit("d-M-yyyy H:mm")).cast("timestamp_ntz")


def utc_ts(c: Column) -> Column:
    """Like to_ts, but a time that names its zone is converted to UTC."""
    s = strip(c)
    # With a zone, Spark wants seconds too.
    full = F.regexp_replace(s, MINUTES_THEN_ZONE, "$1:00$2")
    zoned = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), full.try_cast("timestamp").cast("timestamp_ntz")
    )
    return F.when(s.rlike(ISO_WITH_ZONE), zoned).otherwise(_wall_clock(s))


def months_before(as_of: str | datetime | Column, months: int) -> Column:
    return as_timestamp(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))


def days_before(as_of: str | datetime | Column, days: int) -> Column:
    return as_timestamp(as_of) - F.make_dt_interval(F.lit(days))


def days_since(as_of: str | datetime | Column, c: Column, missing: int = 999) -> Column:
    """Completed 24-hour days between c and as_of, rounded down (a future c is negative)."""
    now = as_timestamp(as_of)
    dates = F.datediff(now, c)
    days = F.when(c + F.make_dt_interval(dates) > now, dates - 1).otherwise(dates)
    return F.coalesce(days, F.lit(missing))


def week_label(c: Column) -> Column:
    """Calendar year and Monday-based week 00-53; week 1 has at least four days in the year."""
    week1 = F.trunc(F.make_date(F.year(c), F.lit(1), F.lit(4)), "week")
    week = (F.floor(F.datediff(c, week1) / 7) + 1).cast("string")
    return F.concat(F.year(c).cast("string"), F.lit("-"), F.lpad(week, 2, "0"))


def period_label(c: Column, group_by: str) -> Column:
    """Label of the month, week or day of c; an unknown period means month."""
    if group_by == "week":
        return week_label(c)
    return F.date_format(c, "yyyy-MM-dd" if group_by == "day" else "yyyy-MM")
