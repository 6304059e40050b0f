"""What type a column's content has, what type would hold it, and renaming and rendering by type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.dates import is_midnight, parse_time
from plumbline.functions.numbers import to_double
from plumbline.operators.columns import (
    INTEGRAL,
    LONG_TEXT,
    NUMERIC,
    TEMPORAL,
    TEXT,
    WITH_TIME,
    as_text,
    bounded,
    col,
    of_kind,
    one_row_each,
    pick,
    stack,
    type_of,
    value,
)
from plumbline.operators.frequencies import distinct_counts, frequency

# Words that make a column boolean, and the limits of a categorical column.
BOOLEAN_WORDS = ["true", "false", "t", "f", "yes", "no", "y", "n", "1", "0"]
CATEGORY_RATIO = 0.1
CATEGORY_VALUES = 50

# The narrow types, their bounds, and the Spark type that holds each.
UNSIGNED = [("uint8", 255, "smallint"), ("uint16", 65535, "int"), ("uint32", 4294967295, "bigint")]
SIGNED = [
    ("int8", -128, 127, "tinyint"),
    ("int16", -32768, 32767, "smallint"),
    ("int32", -2147483648, 2147483647, "int"),
]
FLOAT_TOLERANCE = 1e-6
CATEGORY_BELOW = 0.5


def date_or_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, kind`` of date and time columns: ``date`` if every value is at midnight."""
    structs = []
    for name in of_kind(df, TEMPORAL, columns):
        kind = F.lit("date")
        if isinstance(type_of(df, name), WITH_TIME):
            kind = F.when(F.coalesce(F.bool_and(is_midnight(col(name))), F.lit(True)), "date").otherwise("datetime")
        structs.append(F.struct(F.lit(name), kind))
    return one_row_each(df, structs, "column string, kind string")


def narrow_dates(df: DataFrame) -> DataFrame:
    """Cast time columns that only hold midnights to dates. Reads those columns once to find out."""
    timed = of_kind(df, WITH_TIME)
    if not timed:
        return df
    dates = [row["column"] for row in date_or_datetime(df, timed).where("kind = 'date'").collect()]
    return df.withColumns({name: col(name).cast("date") for name in dates})


def schema_buckets(df: DataFrame) -> DataFrame:
    """``column, bucket``: numeric, string, date, datetime, nested or array."""
    structs = []
    for name in df.columns:
        kind = type_of(df, name)
        if isinstance(kind, WITH_TIME):
            all_midnight = F.coalesce(F.bool_and(is_midnight(col(name))), F.lit(True))
            bucket = F.when(all_midnight, "date").otherwise("datetime")
        elif isinstance(kind, T.DateType):
            bucket = F.lit("date")
        elif isinstance(kind, NUMERIC):
            bucket = F.lit("numeric")
        elif isinstance(kind, T.ArrayType):
            bucket = F.lit("array")
        elif isinstance(kind, (T.StructType, T.MapType, T.VariantType)):
            bucket = F.lit("nested")
        else:
            bucket = F.lit("string")
        structs.append(F.struct(F.lit(name), bucket))
    return one_row_each(df, structs, "column string, bucket string")


def _fixed(x: Column, decimals: Column) -> Column:
    return F.call_function("format_string", F.concat(F.lit("%."), decimals.cast("string"), F.lit("f")), x)


def _decimals(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"[.]([0-9]*)", 1))


def _text_groups(df: DataFrame, name: str) -> DataFrame:
    """``value, n, number, decimals, time`` of the different texts, each parsed once however often it occurs.

    Texts too long to group by themselves are no times or flags; what number they hold, if any, is
    read before they give way to their digest.
    """
    c, v = col(name), F.col("value")
    long = F.octet_length(c) > LONG_TEXT
    read_ahead = F.when(long, F.struct(to_double(c).alias("number"), _decimals(c).alias("decimals")))
    rows = df.select(bounded(df, name).alias("value"), read_ahead.alias("long")).where("value is not null")
    groups = rows.groupBy("value", "long").agg(F.count(F.lit(1)).alias("n"))
    return groups.select(
        "value",
        "n",
        F.when(F.col("long").isNull(), to_double(v)).otherwise(F.col("long.number")).alias("number"),
        F.when(F.col("long").isNull(), _decimals(v)).otherwise(F.col("long.decimals")).alias("decimals"),
        F.when(F.col("long").isNull(), parse_time(v)).alias("time"),
    )


def _detect(df: DataFrame, name: str) -> DataFrame:
    kind = type_of(df, name)
    v, n = F.col("value"), F.col("n")
    shown = as_text(kind, v)
    never = F.lit(False)
    all_words = all_numbers = all_whole = all_times = never
    smallest, decimals, earliest = F.lit(None).cast("double"), F.lit(0), F.lit(None).cast("timestamp_ntz")
    if isinstance(kind, TEMPORAL):
        all_times, earliest = F.lit(True), F.min(v.cast("timestamp_ntz"))
    elif isinstance(kind, (T.BooleanType,) + TEXT):
        all_words = F.bool_and(F.lower(shown).isin(BOOLEAN_WORDS))
    if isinstance(kind, NUMERIC + TEXT):
        number = v.cast("double") if isinstance(kind, NUMERIC) else F.col("number")
        all_numbers = F.bool_and(number.isNotNull())
        all_whole = F.bool_and(number == F.rint(number))
        smallest = F.min(number)
        decimals = F.max(_decimals(shown) if isinstance(kind, NUMERIC) else F.col("decimals"))
    groups = frequency(df, name).where("value is not null")
    if isinstance(kind, TEXT):
        groups = _text_groups(df, name)
        all_times, earliest = F.bool_and(F.col("time").isNotNull()), F.min("time")
    found = groups.agg(
        F.count(v).alias("distinct"),
        F.sum(n).alias("present"),
        all_words.alias("words"),
        all_numbers.alias("numbers"),
        all_whole.alias("whole"),
        all_times.alias("times"),
        smallest.alias("smallest"),
        decimals.alias("decimals"),
        earliest.alias("earliest"),
    )
    empty = F.col("distinct") == 0
    ratio = F.coalesce(F.try_divide(F.col("distinct"), F.col("present")), F.lit(0.0))
    declared_time = F.lit(isinstance(kind, TEMPORAL))

    def ladder(unknown, time, boolean, whole, fraction, parsed, category, other):
        return (
            F.when(empty, unknown)
            .when(declared_time, time)
            .when(F.col("words"), boolean)
            .when(F.col("numbers") & F.col("whole"), whole)
            .when(F.col("numbers"), fraction)
            .when(F.col("times"), parsed)
            .when((ratio < CATEGORY_RATIO) & (F.col("distinct") < CATEGORY_VALUES), category)
            .otherwise(other)
        )

    as_time = F.date_format("earliest", "yyyy-MM-dd HH:mm:ss")
    nothing = F.lit(None).cast("string")
    return found.select(
        F.lit(name).alias("column"),
        ladder("unknown", "datetime", "boolean", "numeric", "numeric", "datetime", "categorical", "string").alias("base_type"),
        ladder("unknown", "datetime64", "boolean", "integer", "float", "datetime", "categorical", "string").alias("specific_type"),
        ladder(
            nothing,
            as_time,
            nothing,
            _fixed(F.col("smallest"), F.lit(0)),
            _fixed(F.col("smallest"), F.col("decimals")),
            as_time,
            nothing,
            nothing,
        ).alias("sample_format"),
        ratio.alias("unique_ratio"),
    )


def detect_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, base_type, specific_type, sample_format, unique_ratio``, decided on all values.

    Declared times are times. Else, in this order: boolean words, numbers, times, categories, text.
    The tests run on distinct values, so a text is parsed once however often it occurs. The sample is
    the smallest value in the detected format.
    """
    return stack([_detect(df, name) for name in pick(df, columns)])


def type_advice(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, type, advice, spark_type``: the narrowest type that holds a column's values.

    Whole numbers without gaps get the narrowest integer, other numbers float32 where nothing is
    lost, and text that repeats enough ``category``. Advice only: no data is changed.
    """
    names = pick(df, columns)
    schema = "column string, type string, advice string, spark_type string"
    structs, texts = [], []
    for name in names:
        kind = type_of(df, name)
        declared = F.lit(kind.simpleString())
        if isinstance(kind, TEXT):
            texts.append(name)
            continue
        if not isinstance(kind, NUMERIC):
            structs.append(F.struct(F.lit(name), declared, declared, declared))
            continue
        c = value(df, name)
        whole_type = isinstance(kind, INTEGRAL)
        low, high = F.min(c), F.max(c)
        no_gap = (F.count(c) == F.count(F.lit(1))) & (F.count(c) > 0)
        whole = F.lit(True) if whole_type else F.bool_and(c == F.rint(c.cast("double"))) & (high < 2.0**64)
        fits_float = F.max(F.abs(c.cast("double") - c.cast("float").cast("double"))) < FLOAT_TOLERANCE
        options = [(no_gap & whole & (low >= 0) & (high <= top), word, holds) for word, top, holds in UNSIGNED]
        options += [(no_gap & whole & (low >= 0), "uint64", "decimal(20,0)")]
        options += [(no_gap & whole & (low >= a) & (high <= b), word, holds) for word, a, b, holds in SIGNED]
        options += [(no_gap & whole & (low >= -(2.0**63)) & (high < 2.0**63), "int64", "bigint")]
        if not whole_type:
            options += [(no_gap & fits_float, "float32", "float")]
        word, holds = declared, declared
        for test, advice, spark_type in reversed(options):
            word, holds = F.when(test, advice).otherwise(word), F.when(test, spark_type).otherwise(holds)
        structs.append(F.struct(F.lit(name), declared, word, holds))
    parts = [one_row_each(df, structs, schema)] if structs else []
    if texts:
        few = F.try_divide(F.col("distinct"), F.col("rows")) < CATEGORY_BELOW
        parts.append(
            distinct_counts(df, texts).select(
                "column",
                F.lit("string").alias("type"),
                F.when((F.col("distinct") > 0) & few, "category").otherwise("string").alias("advice"),
                F.lit("string").alias("spark_type"),
            )
        )
    return stack(parts)


def apply_advice(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The frame with its columns in the types that :func:`type_advice` finds for them.

    The advice is found when the frame is built, a row per column. Every cast is checked: a value that its column's new type would
    not hold (beyond the rounding that the advice allows a float) is an error, as when the rows have changed since.
    """
    names = pick(df, columns)
    kinds = {row["column"]: row["spark_type"] for row in type_advice(df, names).collect()}
    new = {}
    for name in names:
        if kinds[name] == type_of(df, name).simpleString():
            continue
        c = value(df, name)
        cast = c.try_cast(kinds[name])
        exact = F.abs(c.cast("double") - cast.cast("double")) < FLOAT_TOLERANCE if kinds[name] == "float" else cast.cast(type_of(df, name)) == c
        lost = F.raise_error(F.concat(F.lit(f"{name} as {kinds[name]} loses "), c.cast("string"))).cast(kinds[name])
        new[name] = F.when(c.isNull() | F.coalesce(exact, F.lit(False)), cast).otherwise(lost)
    return df.select(*[new[n].alias(n) if n in new else col(n) for n in df.columns])


def underscored(name: str) -> str:
    return name.replace(" ", "_")


def rename_spaces(df: DataFrame) -> DataFrame:
    """Blanks in column names become underscores."""
    return df.withColumnsRenamed({n: underscored(n) for n in df.columns if " " in n})


def _iso(df: DataFrame, name: str) -> Column:
    c = value(df, name)
    if isinstance(type_of(df, name), WITH_TIME):
        fraction = F.date_format(c, ".SSSSSS")
        return F.concat(
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != ".000000", fraction).otherwise("")
        )
    if isinstance(type_of(df, name), T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c


def json_rows(df: DataFrame) -> DataFrame:
    """``json``: each row as a JSON object with ISO times, plain dates, and null for NaN."""
    fields = F.struct(*[_iso(df, n).alias(n) for n in df.columns])
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))
