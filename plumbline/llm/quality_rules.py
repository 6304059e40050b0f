"""Quality rules: a table of thresholds, compiled into one projection of Spark functions.

Every measure is a Spark expression over one row, so the operator neither shuffles nor leaves the JVM.
A null text is the empty text: no words, no lines, and it fails the base rules. Rows are treated one by
one: ties and repeated rows cannot matter, texts of any length are measured whole, an empty table gives an empty table. Other columns of the
table are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import blank_words

#: Words of one window of the repetition measure: a power of two, see ``measures``.
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from have he in is it not of on or that the this to was what when with you "
    "als auch auf aus bei das dem den der des die ein eine er es im ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al como con del el en es la las lo los más no para pero por que se su un una y"
).split()

#: (rule, measure, comparison, threshold). A document is kept if it is not ``base_failed`` and all hold.
RULES = (
    ("mean_word_length_low", "mean_word_length", ">=", 1.5),
    ("mean_word_length_high", "mean_word_length", "<=", 30.0),
    ("symbols_per_word", "symbols_per_word", "<=", 0.3),
    ("exclamations_per_word", "exclamations_per_word", "<=", 0.5),
    ("stop_word_ratio", "stop_word_ratio", ">=", 0.01),
    ("duplicate_line_ratio", "duplicate_line_ratio", "<=", 0.5),
    ("ellipsis_line_ratio", "ellipsis_line_ratio", "<=", 0.5),
    ("adjacent_repeat_ratio", "adjacent_repeat_ratio", "<=", 0.3),
)


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that the pattern covers."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, F.lit("")))).cast("long")


def _per(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def measures(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns and the measures that RULES name.

    ``n_repeat_words`` is exact up to the chance that two different windows of one text share a 64-bit
    hash. Only texts with a repeated window go on to the sorting that finds which words these cover.
    """
    keep = keep or []
    row = df.select(F.struct(*[df[c] for c in keep]).alias("kept_columns"), F.coalesce(df[text], F.lit("")).alias("text"))
    row = row.withColumn("words", blank_words(F.col("text")))
    row = row.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words").cast("long")
    row = row.select(
        "*",
        n.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), r"[#*$%&|<>]+").alias("n_symbols"),
        _count(F.col("text"), "!+").alias("n_exclamations"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(
            n > 1,
            F.size(F.filter(F.zip_with(F.expr("slice(words, 2, size(words))"), "words", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)),
        ).otherwise(0).cast("long").alias("n_adjacent_repeats"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("windows"),
    )
    # Hashes of 1, 2, 4 and 8 words from a position on: each from two of the half length.
    for step in (1, 2, 4):
        row = row.withColumn("windows", F.expr(f"zip_with(windows, slice(windows, {step + 1}, size(windows)), (a, b) -> xxhash64(a, b))"))
    row = row.withColumn("windows", F.expr(f"slice(windows, 1, greatest(0, CAST(n_words AS INT) - {WINDOW - 1}))"))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    # Windows of texts with repeats, as (hash, position) in order; neighbours with equal hashes are repeats.
    row = row.withColumn("ordered", F.when(repeats, F.expr("array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i)))")))
    row = row.withColumn(
        "starts",
        F.when(
            F.size("ordered") > 0,
            F.expr(
                "array_sort(transform(filter(sequence(0, size(ordered) - 1), k ->"
                " (k > 0 AND ordered[k].h = get(ordered, k - 1).h)"
                " OR (k < size(ordered) - 1 AND ordered[k].h = get(ordered, k + 1).h)), k -> ordered[k].i))"
            ),
        ),
    )
    covered = F.expr(f"aggregate(transform(starts, (s, k) -> CAST(least({WINDOW}, coalesce(get(starts, k + 1), s + {WINDOW}) - s) AS BIGINT)), 0L, (a, b) -> a + b)")
    row = row.withColumn("n_repeat_words", F.when(F.size("starts") > 0, covered).otherwise(F.lit(0).cast("long")))
    return row.select(
        *[F.col(f"kept_columns.`{c}`").alias(c) for c in keep],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        _per(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        _per(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _per(F.col("n_exclamations"), F.col("n_words")).alias("exclamations_per_word"),
        _per(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        _per(F.col("n_dup_lines"), F.col("n_lines")).alias("duplicate_line_ratio"),
        _per(F.col("n_ellipsis_lines"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        _per(F.col("n_adjacent_repeats"), F.col("n_words")).alias("adjacent_repeat_ratio"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def verdict(rules=RULES) -> Column:
    """The table of thresholds as one expression over the measures."""
    holds = F.lit(True)
    for _, measure, comparison, threshold in rules:
        value = F.col(measure)
        holds = holds & (value >= threshold if comparison == ">=" else value <= threshold)
    return holds


def failed_rules(rules=RULES) -> Column:
    """The names of the rules that a row breaks, in the table's order."""
    value = {">=": lambda c, t: c < t, "<=": lambda c, t: c > t}
    return F.array_compact(F.array(*[F.when(value[op](F.col(m), t), F.lit(name)) for name, m, op, t in rules]))


def base_failed() -> Column:
    """Under 20 words, or over 30 words in 100 within repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def apply_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None, rules=RULES) -> DataFrame:
    """The ``keep`` columns, all measures, the failed rules, ``base_failed`` and ``kept``."""
    measured = measures(df, text, keep)
    # A row number is not deterministic, so a filter on ``kept`` stays above the measures. Pushed down, it
    # would hold each measure's whole definition, and that of the arrays under it, many times over.
    kept = (F.col("row_no") >= 0) & ~base_failed() & verdict(rules)
    return measured.withColumns({"failed_rules": failed_rules(rules), "base_failed": base_failed(), "kept": kept}).drop("row_no")
