"""Quality score of extracted text as one Spark expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

# fixed values: limits and penalties of the score
GOOD, SUSPICIOUS = 70, 45
LONG_TOKEN, VERY_LONG_TOKEN = 45, 80
MIN_CHARS, MIN_ALNUM = 20, 8
LOW_WHITESPACE, REPLACEMENT_SHARE, PRINTABLE_SHARE = 0.055, 0.01, 0.95
SINGLE_LINES, HARD_SINGLE_LINES = 0.25, 0.50
SCRIPT, SEVERE_SCRIPT, HARD_SCRIPT = 0.08, 0.20, 0.50


def with_metrics(df: DataFrame, column: str = "text", language: str = "eng") -> DataFrame:
    """Adds ``cleaned`` and the figures the score needs.  Columns of these names are replaced."""
    cleaned = F.col("cleaned")
    out = df.withColumn("cleaned", X.clean_text(F.col(column))).withColumn("letters_", X.letters_only(cleaned))
    scripts = X.script_counts(F.col("letters_"))
    out = out.withColumns(
        {
            "char_count": F.length(cleaned),
            "alnum_count": X.count_of(cleaned, r"[\p{L}\p{N}]"),
            "space_count": X.count_of(cleaned, f"[{X.BLANK}]"),
            "hidden_count": X.count_of(cleaned, r"[[\p{Cc}\p{Cf}\p{Co}\p{Z}]&&[^ \n\t]]"),
            "replacement_count": X.count_of(cleaned, r"\x{FFFD}"),
            "tokens_": X.token_lengths(cleaned),
            "lines_": X.filled_lines(cleaned),
            **{f"{k}_count": v for k, v in scripts.items()},
        }
    )
    total = F.greatest(F.col("char_count"), F.lit(1))
    letters = F.col("letters_count")
    share = lambda n: F.when(letters > 0, F.round(n / letters, 4)).otherwise(0.0)
    expected = sum((F.col(f"{s}_count") for s in X.expected_scripts(language)), F.lit(0))
    long_tokens = F.size(F.filter("tokens_", lambda x: x >= LONG_TOKEN))
    singles = F.size(F.filter("lines_", lambda x: F.regexp_replace(x, f"[{X.BLANK}]+", "").rlike(r"^\p{L}$")))
    out = out.withColumns(
        {
            "alnum_ratio": F.col("alnum_count") / total,
            "whitespace_ratio": F.col("space_count") / total,
            "printable_ratio": 1 - F.col("hidden_count") / total,
            "replacement_ratio": F.col("replacement_count") / total,
            "token_count": F.size("tokens_"),
            "max_token_length": F.coalesce(F.array_max("tokens_"), F.lit(0)),
            "average_token_length": F.coalesce(F.round(F.try_divide(F.aggregate("tokens_", F.lit(0), lambda a, x: a + x), F.size("tokens_")), 2), F.lit(0.0)),
            "long_token_ratio": F.coalesce(F.round(F.try_divide(long_tokens, F.size("tokens_")), 4), F.lit(0.0)),
            "line_count": F.size("lines_"),
            "single_line_ratio": F.coalesce(F.try_divide(singles, F.size("lines_")), F.lit(0.0)),
            **{f"{s}_ratio": share(F.col(f"{s}_count")) for s in (*X.SCRIPTS, "other")},
            "unexpected_ratio": F.when(letters > 0, F.round(1 - expected / letters, 4)).otherwise(0.0),
        }
    )
    return out.drop("tokens_", "lines_", "letters_")


def score_columns() -> dict[str, Column]:
    """Columns ``score``, ``quality`` and ``reasons`` over the figures of ``with_metrics``."""
    c = F.col
    empty = c("cleaned") == ""
    low_space = (c("char_count") >= 120) & (c("whitespace_ratio") < LOW_WHITESPACE)
    very_long = c("max_token_length") >= VERY_LONG_TOKEN
    long = ~very_long & (c("max_token_length") >= LONG_TOKEN)
    many_lines = c("line_count") >= 5
    rules = [  # (condition, points, reason)
        ((c("char_count") < MIN_CHARS) | (c("alnum_count") < MIN_ALNUM), 50, "very_short_text"),
        (c("printable_ratio") < PRINTABLE_SHARE, 20, "low_printable_ratio"),
        (c("replacement_ratio") > REPLACEMENT_SHARE, 30, "replacement_characters"),
        (low_space, 25, "low_whitespace"),
        (very_long, 10, "very_long_token"),
        (very_long & low_space, 20, None),
        (long, 5, "long_token"),
        (c("long_token_ratio") >= 0.05, 5, None),
        (many_lines & (c("single_line_ratio") >= SINGLE_LINES), 60, "single_char_lines"),
        (c("unexpected_ratio") >= SCRIPT, 30, "unexpected_script"),
        (c("unexpected_ratio") >= SEVERE_SCRIPT, 30, None),
        ((c("char_count") >= 50) & (c("alnum_ratio") < 0.30), 20, "low_alnum_ratio"),
    ]
    points = F.lit(100)
    for condition, lost, _ in rules:
        points = points - F.when(condition, lost).otherwise(0)
    points = F.greatest(points, F.lit(0))
    hard = (many_lines & (c("single_line_ratio") >= HARD_SINGLE_LINES)) | (c("unexpected_ratio") >= HARD_SCRIPT)
    reasons = F.filter(F.array(*(F.when(condition, F.lit(reason)) for condition, _, reason in rules if reason)), lambda x: x.isNotNull())
    return {
        "score": F.when(empty, 0).otherwise(points).cast("int"),
        "quality": F.when(empty, "empty").when(hard, "rejected").when(points >= GOOD, "good").when(points >= SUSPICIOUS, "suspicious").otherwise("rejected"),
        "reasons": F.when(empty, F.array(F.lit("empty_text"))).otherwise(reasons),
        "hard_reject": ~empty & hard,
    }


def text_quality(df: DataFrame, column: str = "text", language: str = "eng") -> DataFrame:
    """Adds the figures, ``score`` (0-100), ``quality`` (good, suspicious, rejected or empty), ``reasons`` in the
    order of the rules and ``hard_reject``.  Null and blank texts are empty with score 0."""
    return with_metrics(df, column, language).withColumns(score_columns())
