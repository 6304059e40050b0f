"""Times held as text or as spreadsheet day numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SHAPE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][0-9]{1,9})?)?)?$"

# How every known format starts; tells other text apart at the cost of one match.
TIME_START = r"^([0-9]{1,4}[-/. ]|[0-9]{8}$|[A-Za-z]{3,9} [0-9]{1,2}, )"

# The shape decides which pattern is tried, so a value costs one parse and not one per pattern.
# Month-first is tried before day-first.
SHAPED_PATTERNS = (
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$", "M/d/yyyy H:mm"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "M/d/yyyy H:mm:ss"),
    (r"^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$", "d.M.yyyy"),
    (r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", "d-MMM-yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMM yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
    (r"^[0-9]{8}$", "yyyyMMdd"),
)

# The C-style date directives a rule may use, the Spark pattern of each, and its look.
DIRECTIVES = {
    "%Y": ("yyyy", "[0-9]{4}"),
    "%y": ("yy", "[0-9]{2}"),
    "%m": ("MM", "[0-9]{1,2}"),
    "%d": ("dd", "[0-9]{1,2}"),
    "%b": ("MMM", "[A-Za-z]{3}"),
    "%B": ("MMMM", "[A-Za-z]{3,9}"),
    "%H": ("HH", "[0-9]{1,2}"),
    "%I": ("hh", "[0-9]{1,2}"),
    "%M": ("mm", "[0-9]{1,2}"),
    "%S": ("ss", "[0-9]{1,2}"),
    "%f": ("SSSSSS", "[0-9]{1,6}"),
    "%p": ("a", "[AaPp][Mm]"),
    "%j": ("DDD", "[0-9]{1,3}"),
}
# These take one digit as well as two, unless digits follow on directly.
SHORT = {"MM": "M", "dd": "d", "HH": "H", "hh": "h", "mm": "m", "ss": "s", "DDD": "D"}

# Day numbers count from here, and look like this.
SERIAL_ORIGIN = "1899-12-30 00:00:00"
SERIAL_SHAPE = r"^[0-9]{5,6}([.][0-9]+)?$"


def to_pattern(date_format: str) -> tuple[str, str | None]:
    """The Spark pattern of a format with C-style directives, and the look of text in it.

    A format without directives is taken for a Spark pattern.
    """
    if "%" not in date_format:
        return date_format, None
    pieces = re.findall("%.|[^%]+", date_format)
    pattern, shape = "", ""
    for i, piece in enumerate(pieces):
        if not piece.startswith("%"):
            pattern += "'" + piece.replace("'", "''") + "'"
            shape += re.escape(piece)
            continue
        if piece not in DIRECTIVES:
            raise ValueError(f"unknown date directive {piece!r} in {date_format!r}")
        letters, look = DIRECTIVES[piece]
        beside = pieces[max(i - 1, 0) : i] + pieces[i + 1 : i + 2]
        alone = not any(other.startswith("%") for other in beside)
        pattern += SHORT.get(letters, letters) if alone else letters
        shape += look
    return pattern, f"^{shape}$"


def parse_with(text: Column, date_format: str) -> Column:
    """Text in exactly one format to a time without zone; NULL where it does not fit."""
    pattern, shape = to_pattern(date_format)
    parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    # A parse that fails is costly, a look that does not match is not.
    return parsed if shape is None else F.when(text.rlike(shape), parsed)


def parse_time(text: Column) -> Column:
    """Text in any of the known formats to a time without zone; NULL where none fits."""
    bare = F.trim(text)
    tries = [F.when(bare.rlike(ISO_SHAPE), bare.try_cast("timestamp_ntz"))]
    tries += [F.when(bare.rlike(shape), parse_with(bare, pattern)) for shape, pattern in SHAPED_PATTERNS]
    return F.when(bare.rlike(TIME_START), F.coalesce(*tries))


def drop_zone_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "UTC|GMT", ""))


def from_serial_days(days: Column) -> Column:
    """Spreadsheet day numbers (days since 1899-12-30, fractions are times of day) to a time."""
    micros = F.round(days * 86_400_000_000).cast("long")
    return F.timestamp_add("MICROSECOND", micros, F.expr(f"timestamp_ntz'{SERIAL_ORIGIN}'"))


def parse_time_or_serial(text: Column) -> Column:
    """Like :func:`parse_time`, after dropping zone words; five- and six-digit numbers are day numbers."""
    bare = drop_zone_words(text)
    serial = F.when(bare.rlike(SERIAL_SHAPE), from_serial_days(bare.try_cast("double")))
    return F.coalesce(serial, parse_time(bare))


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970 by the clock shown, rounded down."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), time.cast("timestamp_ntz"))
    return ((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("long")


def is_midnight(time: Column) -> Column:
    return F.date_trunc("DAY", time) == time
