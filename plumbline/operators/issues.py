"""Quality issues read off a column's profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.columns import numeric_columns, pick, stack, text_columns, value
from plumbline.operators.frequencies import kind_counts

# Percentages above which an issue is raised.
MANY_NULLS = 20
MOST_NULLS = 50
MANY_DISTINCT = 90

SIGNS = ("seen", "number_like", "upper", "lower", "special")


def _text_signs(shown: Column) -> list[Column]:
    """Counts over text values: how many, number-like, all upper, all lower, with special characters."""
    return [
        F.count(shown).alias("seen"),
        F.count_if(text.is_number_like(shown)).alias("number_like"),
        F.count_if(text.is_all_upper(shown)).alias("upper"),
        F.count_if(text.is_all_lower(shown)).alias("lower"),
        F.count_if(text.has_special_character(shown)).alias("special"),
    ]


def quality_signs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column the counts the issues are decided on.

    The text signs look at every row, in an aggregate of their own that moves no text.
    """
    texts, numbers = text_columns(df, columns), numeric_columns(df, columns)
    n = F.col("n")
    parts = []
    for name in pick(df, columns):
        counts = [
            F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("nulls"),
            F.count("value").alias("distinct"),
        ]
        if name not in texts:
            part = kind_counts(df, name).agg(*counts).select("*", *[F.lit(0).cast("long").alias(s) for s in SIGNS])
        else:
            signs = df.agg(F.struct(*_text_signs(value(df, name))).alias("signs")).scalar()
            part = kind_counts(df, name).agg(*counts).withColumn("signs", signs).select("*", "signs.*").drop("signs")
        parts.append(
            part.select(
                F.lit(name).alias("column"), F.lit(name in texts).alias("is_text"), F.lit(name in numbers).alias("is_number"), "*"
            )
        )
    return stack(parts)


def _issue(holds: Column, kind: str, description: Column | str, severity: Column | str) -> Column:
    as_column = [F.lit(x) if isinstance(x, str) else x for x in (kind, description, severity)]
    names = ("issue_type", "description", "severity")
    return F.when(holds, F.struct(*[c.alias(n) for c, n in zip(as_column, names)]))


def quality_issues(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, issue_type, description, severity``, at most one row per column and type."""
    signs = quality_signs(df, columns)
    null_share = F.try_divide(F.col("nulls") * 100.0, F.col("rows"))
    kinds = F.col("distinct") + F.when(F.col("nulls") > 0, 1).otherwise(0)
    kind_share = F.try_divide(kinds * 100.0, F.col("rows") - F.col("nulls"))
    is_text, seen = F.col("is_text"), F.col("seen")
    number_like = F.col("number_like")
    found = F.array(
        _issue(
            null_share > MANY_NULLS,
            "high_null_percentage",
            F.concat(F.format_string("%.1f", null_share), F.lit("% of the rows have no value")),
            F.when(null_share > MOST_NULLS, "high").otherwise("medium"),
        ),
        _issue(
            is_text & (number_like > 0) & (number_like < seen),
            "mixed_data_types",
            "some values read as numbers, others do not",
            "medium",
        ),
        _issue(
            is_text & (F.col("upper") > 0) & (F.col("lower") > 0),
            "inconsistent_casing",
            "some values are in capitals, others in small letters",
            "low",
        ),
        _issue(is_text & (F.col("special") > 0), "special_characters", "values hold signs beyond letters, digits and blanks", "low"),
        _issue(
            ~F.col("is_number") & (F.col("distinct") > 0) & (kind_share > MANY_DISTINCT),
            "high_cardinality",
            F.concat(F.lit("different values for "), F.format_string("%.1f", kind_share), F.lit("% of the rows")),
            "medium",
        ),
    )
    return signs.select("column", F.inline(F.array_compact(found)))
