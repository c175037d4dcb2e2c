"""Edge values of the cleansing expressions."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leadmill.functions import numbers, phones, text, times
from workload.model import AS_OF


def evaluate(spark, f, values, type_name="string"):
    """f applied to each value, as a list."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def check(spark, f, cases, type_name="string"):
    assert evaluate(spark, f, list(cases), type_name) == list(cases.values())


def test_normalize_phone(spark):
    check(spark, phones.normalize_phone, {
        "081234567890": "6281234567890", "81234567890": "6281234567890",
        "+62 812-3456-7890": "6281234567890", "6281234567890123": "6281234567890",
        "0812": None, "4412345678901": None, "": None, None: None, "12": None,
        "08123456": None, "081234567": "6281234567", "0812345678": "62812345678",
    })


def test_courier_phone(spark):
    check(spark, phones.courier_phone, {
        "'0812-345 6": "628123456", "812": "62812", "62812": "62812", " '62 812 ": "62812",
        "0": "62", "": None, "nan": None, "'": None, " - ": None, None: None, "+62812": "62+62812",
        "0062": "62062",
    })


def test_lead_phone(spark):
    check(spark, phones.lead_phone, {
        "628123456789.0": "628123456789", "0812": "812", "+62812": "62812", "1e3": "1000",
        "-5.9": "-5", "62-812": None, "inf": None, "nan": None, "12d": None, "": None, None: None,
        " 12 ": "12",
    })


def test_numbers(spark):
    check(spark, numbers.to_num, {
        "12": 12.0, " -1.5 ": -1.5, ".5": 0.5, "5.": 5.0, "1e2": 100.0, "1,5": None, "x": None,
        "": None, "nan": None, "inf": None, "12f": None, "0x10": None, None: None,
    })
    check(spark, lambda c: numbers.to_num(c, "bigint"), {"3.9": 4, "2.0": 2, "two": None})
    check(spark, numbers.parse_rupiah, {
        "Rp277,065": Decimal("277065.00"), " Rp 1,000,000 ": Decimal("1000000.00"),
        "Rp": None, "12.345": Decimal("12.35"), "free": None, None: None,
    })
    check(spark, numbers.integer_text, {"123.0": "123", "": None, "nan": None, "7": "7"})
    check(spark, numbers.default_qty, {"3": 3, "x": 1, None: 1, "0": 0})
    check(spark, lambda c: numbers.whole_amount(c, 1), {
        "": 1, "0": 1, "2.7": 2, "x": 1, "0.5": 0, None: 1, "-2.7": -2, "5": 5,
    })
    check(spark, numbers.payment_from_cod, {
        "1": "COD", "0": "Bank Transfer", "x": "Bank Transfer", "": "Bank Transfer",
        "-1": "Bank Transfer", None: "Bank Transfer",
    })
    check(spark, numbers.to_flag, {"True": 1, "1": 1, "False": 0, "0": 0, "true": 0, None: 0})
    check(spark, numbers.null_if_nan, {1.5: 1.5, None: None}, "double")
    assert evaluate(spark, numbers.null_if_nan, [float("nan")], "double") == [None]


def test_texts(spark):
    check(spark, text.courier_text, {
        " 'abc ": "abc", "''x": "x", "": None, "nan": None, "NaN": None, "' x": " x",
        "\t y\n": "y", None: None, "None": "None",
    })
    check(spark, text.lead_text, {" a ": "a", "None": None, "NaN": None, "'a": "'a", " ": None})
    check(spark, lambda c: text.truncate_text(c, 3), {"abcd": "abc", "": None, None: None})
    check(spark, text.valid_segment, {"New": "New", "new": "Unknown", None: "Unknown"})


def test_courier_codes(spark):
    check(spark, text.courier_status, {
        "Delivered": "completed", " delivered to owner": "completed", "UNDELIVERED": "rts",
        "RTS": "rts", "CANCELLED": "rts", "Canceled": "cancelled", "CANCELLED BY SELLER":
        "cancelled", "Undelivered again": "processing_unpaid", "": "processing_unpaid",
        None: "processing_unpaid",
    })
    check(spark, text.courier_name, {
        "JT": "J&T", " jt ": "J&T", "lion": "Lion Parcel", "Lion": "Lion", "sap": "SAP",
        "": "", None: "",
    })
    check(spark, text.goods_list, {
        "a, b,,c": ["a", "b", "c"], ",": [","], "": ["Unknown"], None: ["Unknown"],
        "'x, y ": ["x", "y"], "nan": ["Unknown"],
    })


def test_times(spark):
    check(spark, times.courier_date, {
        "05-03-2024 07:08": datetime(2024, 3, 5, 7, 8), "5-3-2024 7:08": datetime(2024, 3, 5, 7, 8),
        "31-02-2024 00:00": None, "2024-03-05 07:08": None, "bad": None, "": None, None: None,
    })
    check(spark, times.to_ts, {
        "2024-03-05": datetime(2024, 3, 5), "2024-03-05 07:08:09": datetime(2024, 3, 5, 7, 8, 9),
        "2024-03-05T07:08:09.25": datetime(2024, 3, 5, 7, 8, 9, 250000),
        "3/5/2024": datetime(2024, 3, 5), "25/3/2024 1:02": datetime(2024, 3, 25, 1, 2),
        "2024": None, "soon": None, "2024-13-01": None, "": None, None: None,
    })
    check(spark, times.utc_ts, {
        "2024-03-05T07:00:00+07:00": datetime(2024, 3, 5), "2024-03-05T07:00:00Z":
        datetime(2024, 3, 5, 7), "2024-03-05 07:00:00-0130": datetime(2024, 3, 5, 8, 30),
        "2024-03-05T07:00+07:00": datetime(2024, 3, 5), "2024-03-05 7:05Z":
        datetime(2024, 3, 5, 7, 5), "2024-03-05 7:05": datetime(2024, 3, 5, 7, 5),
        "2024-03-05": datetime(2024, 3, 5), "bad": None, None: None,
    })


def test_utc_ts_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Jakarta")
    try:
        got = evaluate(spark, times.utc_ts, ["2024-03-05T07:00:00+07:00", "2024-03-05 07:00:00"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime(2024, 3, 5), datetime(2024, 3, 5, 7)]


def mysql_week(d: date) -> str:
    """Monday-based weeks 00-53; week 1 is the first with four days in the year."""
    jan1 = date(d.year, 1, 1)
    first_monday = jan1 - timedelta(days=jan1.weekday())
    if jan1.weekday() > 3:
        first_monday += timedelta(days=7)
    return f"{d.year}-{(d - first_monday).days // 7 + 1:02d}"


def test_week_label_on_every_day_of_fifty_years(spark):
    start, days = date(1990, 1, 1), 365 * 50 + 12
    rows = spark.range(days).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("d")
    ).select("d", times.week_label(F.col("d"))).collect()
    assert len(rows) == days
    assert all(label == mysql_week(d) for d, label in rows)
    assert mysql_week(date(2024, 12, 30)) == "2024-53" and mysql_week(date(2023, 1, 1)) == "2023-00"


@pytest.mark.parametrize("ago, expected", [
    (timedelta(days=90), 90), (timedelta(days=90, seconds=1), 90),
    (timedelta(days=89, hours=23), 89), (timedelta(seconds=-1), -1), (timedelta(days=-1), -1),
    (timedelta(days=-1, seconds=-1), -2), (timedelta(0), 0),
])
def test_days_since(spark, ago, expected):
    now = datetime(2001, 8, 2, 6, 30)
    row = spark.range(1).select(times.days_since(now, times.as_timestamp(now - ago))).first()
    assert row[0] == expected


def test_days_since_missing(spark):
    missing = F.lit(None).cast("timestamp_ntz")
    assert spark.range(1).select(times.days_since(AS_OF, missing)).first()[0] == 999


def test_contains_text_takes_wildcards_and_ignores_case(spark):
    assert evaluate(spark, lambda c: text.contains_text(c, "b_d"), ["aBcDe", "abd", None]) == [
        True, False, None,
    ]


def test_ids_that_are_no_numbers_stay(spark):
    check(spark, numbers.id_text, {"123.0": "123", "": None, "NaN": None, "C12": "C12", " 8 ": "8",
                                   None: None})


def test_contains_text_takes_a_backslash_as_itself(spark):
    values = ["a\\b", "ab", "x\\", None]
    assert evaluate(spark, lambda c: text.contains_text(c, "a\\b"), values) == [True, False, False, None]
    assert evaluate(spark, lambda c: text.contains_text(c, "\\"), values) == [True, False, True, None]


def test_other_date_spellings(spark):
    cases = {
        "20240105": "2024-01-05 00:00:00", "31-12-2023": "2023-12-31 00:00:00",
        "31-12-2023 7:05": "2023-12-31 07:05:00", "12 Jan 2024": "2024-01-12 00:00:00",
        "2024-01-05 10:00 PM": "2024-01-05 22:00:00", "2024-01-05 12:00:01 am": "2024-01-05 00:00:01",
        "20241305": None, "99-99-2023": None,
    }
    got = evaluate(spark, times.to_ts, list(cases))
    assert [None if x is None else str(x) for x in got] == list(cases.values())
