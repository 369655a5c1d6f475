import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.functions.quality import text_quality
from paperloom.functions.stemming import stem


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"text {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, ""), ("", ""), ("a\r\nb\rc", "a\nb\nc"), ("a b​c﻿", "a bc"), ("a  \t b", "a b"), ("a\tb", "a\tb"),
        ("a   \n\n\n\n\nb", "a\n\n\nb"), ("  x \n", "x"), ("a\n\n\nb", "a\n\n\nb"),
    ],
)
def test_clean_text(spark, text, want):
    assert one(spark, X.clean_text(F.col("text")), text) == want


def quality(spark, text):
    return text_quality(spark.createDataFrame([(text,)], "text string")).select("score", "quality", "reasons").first()


def test_quality_boundaries(spark):
    assert tuple(quality(spark, None)) == (0, "empty", ["empty_text"])
    assert tuple(quality(spark, "a" * 10 + " " + "b" * 8)) == (50, "suspicious", ["very_short_text"])
    assert tuple(quality(spark, "a" * 10 + " " + "b" * 9)) == (100, "good", [])
    for n, points, reasons in ((44, 100, []), (45, 90, ["long_token"]), (79, 90, ["long_token"]), (80, 85, ["very_long_token"])):
        # one long token among two is above a twentieth of the tokens
        assert tuple(quality(spark, "word " + "x" * n))[::2] == (points, reasons)
    assert quality(spark, "мир " * 20)["quality"] == "rejected"
    assert quality(spark, "\n".join("abcdefghijkl"))["reasons"] == ["single_char_lines"]
    assert quality(spark, "x" * 130)["reasons"] == ["low_whitespace", "very_long_token"]


def test_arabic_predicates_and_numbers(spark):
    assert one(spark, X.is_arabic(F.col("text")), "٣")
    assert not one(spark, X.has_arabic_letter(F.col("text")), "٣")
    assert one(spark, X.has_arabic_letter(F.col("text")), "ﺏ")
    assert one(spark, X.numbers(F.col("text")), "9001:2015 and ٩.٢ and 9.2") == ["9.2", "9001:2015"]


def test_short_text_and_shown(spark):
    assert one(spark, X.short_text(F.col("text"), 10), "a  b") == "a b"
    assert one(spark, X.short_text(F.col("text"), 10), "abcdefghijk") == "abcdefghi…"
    assert one(spark, X.shown(F.col("text"), 2, " s"), 1.005, "double") in ("1.00 s", "1.01 s")
    for bad in (None, float("nan"), float("inf"), -1.0):
        assert one(spark, X.shown(F.col("text"), 2), bad, "double") == "—"


def test_citations(spark):
    assert one(spark, X.citation_groups(F.col("text")), "a [1] b [1, 4] [2](x) [1234]") == ["1", "1, 4"]
    linked = X.linked_answer(F.col("text"), F.array(F.lit("1"), F.lit("2")), F.lit("k 1"))
    assert one(spark, linked, "a [1, 2] b [1, 9] [1](u)") == "a [[1]](#source-k-1-1) [[2]](#source-k-1-2) b [1, 9] [1](u)"


def test_direction_and_fold(spark):
    assert one(spark, X.first_strong_direction(F.col("text")), "12 سجل a") == "rtl"
    assert one(spark, X.first_strong_direction(F.col("text")), "12 ") == "ltr"
    assert one(spark, X.contains_caseless(F.col("text"), "STRASSE"), "Die Straße")


def test_stems():
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "hopping": "hop", "relational": "relat", "hopeful": "hope", "calibration": "calibr", "audits": "audit", "generously": "generous", "skies": "sky"}.items():
        assert stem(word) == want, word
