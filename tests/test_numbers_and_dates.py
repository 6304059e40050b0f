from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates, numbers, text
from plumbline.operators.expressions import parse_datetime


def values(spark, items, function, kind="string"):
    frame = spark.createDataFrame([(i, item) for i, item in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(function(F.col("x"))).collect()]


def test_number_text(spark):
    given = ["123.45", "(100)", "123", "1,234.56", "$500", "75%", "invalid", None, "", "12d", "NaN", "inf", "1e3"]
    given += [" 7 ", "(5%)", "£1 000", "-3", "($1,000.50)", "()", "%", "1.2.3", "(8", "(100) "]
    expected = [123.45, -100.0, 123.0, 1234.56, 500.0, 0.75, None, None, None, None, None, None, 1000.0]
    expected += [7.0, -0.05, 1000.0, -3.0, -1000.5, None, None, None, None, None]
    assert values(spark, given, numbers.parse_number) == expected


def test_number_text_rounded(spark):
    assert values(spark, ["2.675", "33.333%"], lambda c: numbers.parse_number(c, 2)) == [2.68, 0.33]


def test_flags(spark):
    given = ["true", "YES", " y ", "1", "t", "no", "2", None, ""]
    assert values(spark, given, numbers.parse_flag) == [1, 1, 1, 1, 1, 0, 0, 0, 0]


def test_known_time_formats(spark):
    given = {
        "2024-03-05": datetime(2024, 3, 5),
        "2024-3-5 06:07": datetime(2024, 3, 5, 6, 7),
        "2024-03-05T06:07:08.5": datetime(2024, 3, 5, 6, 7, 8, 500000),
        "2024/3/5": datetime(2024, 3, 5),
        "3/5/2024": datetime(2024, 3, 5),
        "25/3/2024": datetime(2024, 3, 25),
        "3/5/2024 6:07": datetime(2024, 3, 5, 6, 7),
        "5.3.2024": datetime(2024, 3, 5),
        "5-Mar-2024": datetime(2024, 3, 5),
        "5 March 2024": datetime(2024, 3, 5),
        "Mar 5, 2024": datetime(2024, 3, 5),
        "20240305": datetime(2024, 3, 5),
        "2024-02-30": None,
        "soon": None,
        "12": None,
    }
    assert values(spark, list(given), dates.parse_time) == list(given.values())


def test_serial_days_and_zone_words(spark):
    given = ["45292", "45292.5", "2024-01-02 03:04:05 UTC", "GMT 2024-01-02", "1234", "9999999"]
    expected = [datetime(2024, 1, 1), datetime(2024, 1, 1, 12), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), None, None]
    assert values(spark, given, dates.parse_time_or_serial) == expected


@pytest.mark.parametrize(("fits", "strict"), [(2, True), (1, False)])
def test_format_gives_way_when_most_rows_fail(spark, fits, strict):
    given = ["05/03/2024"] * fits + ["2024-03-06", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    parsed = [r[0] for r in frame.orderBy("i").select(parse_datetime(frame, "t", "%d/%m/%Y")).collect()]
    # in format: the day first; by the known formats: the month first, and the other row is read too
    first, other = (datetime(2024, 3, 5), None) if strict else (datetime(2024, 5, 3), datetime(2024, 3, 6))
    assert parsed == [first] * fits + [other, None]


def test_formats(spark):
    with pytest.raises(ValueError, match="%Q"):
        dates.to_pattern("%Q")
    expected = datetime(2024, 3, 5, 6, 7, 8)
    for text, date_format in {
        "5/3/2024 6:07:08": "%d/%m/%Y %H:%M:%S",
        "05/03/2024 06:07:08": "%d/%m/%Y %H:%M:%S",
        "20240305T060708": "%Y%m%dT%H%M%S",
        "Mar 05, 24 06:07:08 AM": "%b %d, %y %I:%M:%S %p",
        "5 March 2024 at 6:07:08.5": "%d %B %Y at %H:%M:%S.%f",
        "2024-03-05 06:07:08": "yyyy-MM-dd HH:mm:ss",
    }.items():
        (found,) = values(spark, [text], lambda c, f=date_format: dates.parse_with(c, f))
        assert found is not None and found.replace(microsecond=0) == expected, (text, found)
    assert values(spark, ["2024-03-05", "05/03/2024x", "45/03/2024", None], lambda c: dates.parse_with(c, "%d/%m/%Y")) == [None] * 4


def test_epoch_rounds_down(spark):
    frame = spark.sql(
        "select timestamp_ntz'1969-12-31 23:59:59.5' a, timestamp_ntz'2024-01-01 00:00:01.9' b, date'1970-01-02' c"
    )
    assert list(frame.select(*[dates.epoch_seconds(F.col(c)) for c in "abc"]).first()) == [-1, 1704067201, 86400]


def test_text_signs(spark):
    given = ["ABC", "abc", "Abc", "12", "", "A1", "ÄÖ", "äö", "STRASSE", "straße"]
    assert values(spark, given, text.is_all_upper) == [w.isupper() for w in given]
    assert values(spark, given, text.is_all_lower) == [w.islower() for w in given]
    assert values(spark, ["-1.5", ".5", "5.", "1e3", "x"], text.is_number_like) == [True, True, False, False, False]
    assert values(spark, ["a b", "a-b", "ä", "a b"], text.has_special_character) == [False, True, True, False]
    assert values(spark, ["  A \t B\n", "x"], text.clean_text) == ["a b", "x"]


def test_bad_utf8_is_null(spark):
    assert values(spark, [b"ok", b"\xff\xfe"], text.from_utf8, "binary") == ["ok", None]
