"""Text functions as Spark expressions: cleaning, line and token figures, scripts, numbers, citations.

All of them are built-in expressions, so they stay inside the JVM and inside code generation where Spark has
it.  A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, for use inside a character class.
BLANK = r"\s\p{Z}\x{1C}-\x{1F}\x{85}"
_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze(text: Column) -> Column:
    """White space at the ends removed, each run of it inside made one space."""
    return strip(F.regexp_replace(text, f"[{BLANK}]+", " "))


def clean_text(text: Column) -> Column:
    """Conservative cleaning of extracted text; null becomes the empty text.

    Line ends become LF, no-break spaces spaces; zero-width spaces and byte-order marks go; lines lose trailing
    blanks, then runs of two or more spaces or tabs become one space; at most two empty lines stay in a row.
    """
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    out = F.translate(out, "\u00a0\u200b\ufeff", " ")
    out = F.regexp_replace(out, r"[\t\x{0B}\x{0C}\x{1C}-\x{1F}\x{85}\p{Z}]+(\n|$)", "$1")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(out, r"\n{4,}", "\n\n\n"))


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of the text the class in ``pattern`` matches; runs of them are taken out at once."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("int")


def filled_lines(text: Column) -> Column:
    """The lines of a text that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, _BREAK), strip), lambda x: x != "")


def token_lengths(text: Column) -> Column:
    """Lengths of the runs of characters other than white space."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[^{BLANK}]+"), F.lit(0)), F.length)


# scripts in the order in which they are tested; Han, kana and Hangul count as one
SCRIPTS = {
    "latin": r"[\p{IsLatin}]",
    "arabic": r"[\p{IsArabic}]",
    "cyrillic": r"[\p{IsCyrillic}]",
    "cjk": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]",
    "greek": r"[\p{IsGreek}]",
}


def letters_only(text: Column) -> Column:
    """The letters of a text."""
    return F.regexp_replace(text, r"\P{L}+", "")


def script_counts(letters: Column) -> dict[str, Column]:
    """Letters of each script among ``letters_only`` of a text, ``letters`` of them all and the rest as ``other``."""
    counts = {name: count_of(letters, pattern) for name, pattern in SCRIPTS.items()}
    counts["letters"] = F.length(letters)
    known = sum((counts[n] for n in SCRIPTS), F.lit(0))
    return counts | {"other": counts["letters"] - known}


def expected_scripts(language: str) -> tuple[str, ...]:
    """Scripts that a language setting allows.  The first matching prefix decides; unknown languages allow all."""
    language = (language or "eng").lower()
    if language.startswith("en"):
        return ("latin",)
    if language.startswith("ar"):
        return ("arabic",)
    return (*SCRIPTS, "other")


def is_arabic(text: Column) -> Column:
    """Whether a text has any character of the Arabic block, digits and punctuation included."""
    return text.rlike(r"[\x{0600}-\x{06FF}]")


def has_arabic_letter(text: Column) -> Column:
    """Whether a text has an Arabic letter, presentation forms included, digits not."""
    return text.rlike(r"[\p{IsArabic}&&\p{L}]")


# fixed values: decimal digits of the scripts met in queries, each list from zero to nine
_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९０１２３４５６７８９"


def ascii_digits(text: Column) -> Column:
    """Decimal digits of other scripts as 0-9."""
    return F.translate(text, _DIGITS, "0123456789" * 4)


def numbers(text: Column) -> Column:
    """Sorted distinct numbers of a text, clause and standard references like 9.2 or 9001:2015 whole."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(ascii_digits(text), F.lit(r"[0-9]+(?:[.:][0-9]+)*"), F.lit(0))))


def fold(text: Column) -> Column:
    """Caseless form for substring search; sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def contains_caseless(text: Column, needle: str) -> Column:
    """Whether a text contains ``needle`` whatever the case; a blank needle is in every text."""
    return F.contains(fold(F.coalesce(text, F.lit(""))), fold(F.lit(needle.strip())))


def short_text(text: Column, limit: int = 62) -> Column:
    """White space collapsed; longer texts cut to ``limit`` characters with an ellipsis."""
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), f"[{BLANK}]+$", ""), F.lit("…")))


def citation_groups(answer: Column) -> Column:
    """Citation groups such as [1] or [1, 4] that are not the text of a Markdown link."""
    return F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,3}(?:\s*,\s*[0-9]{1,3})*)\](?!\()"), F.lit(1))


def group_numbers(group: Column) -> Column:
    """The numbers of one citation group."""
    return F.transform(F.split(group, ","), lambda x: F.trim(x))


def citation_anchor(context: Column, number: Column) -> Column:
    """Stable anchor id of one cited source."""
    digits = F.regexp_replace(number.cast("string"), "[^0-9]", "")
    return F.concat(F.lit("source-"), F.regexp_replace(context.cast("string"), "[^a-zA-Z0-9_-]", "-"), F.lit("-"), F.when(digits == "", "0").otherwise(digits))


def linked_answer(answer: Column, valid: Column, context: Column) -> Column:
    """The answer with each citation group whose numbers are all valid turned into links.

    ``valid`` is an array of numbers as strings.  The text is cut at its groups, so each is judged on its own.
    """
    mark = "\u0001"
    cut = F.split(F.regexp_replace(answer, r"(\[[0-9]{1,3}(?:\s*,\s*[0-9]{1,3})*\])(?!\()", f"{mark}$1{mark}"), mark)

    def link(piece: Column) -> Column:
        group = F.regexp_extract(piece, r"^\[([0-9]{1,3}(?:\s*,\s*[0-9]{1,3})*)\]$", 1)
        many = group_numbers(group)
        links = F.transform(many, lambda n: F.concat(F.lit("[["), n, F.lit("]](#"), citation_anchor(context, n), F.lit(")")))
        return F.when((group != "") & F.forall(many, lambda n: F.array_contains(valid, n)), F.array_join(links, " ")).otherwise(piece)

    return F.array_join(F.transform(cut, link), "")


def finite(number: Column) -> Column:
    """A non-negative finite number, else null."""
    return F.when(~F.isnan(number) & (number >= 0) & (number != float("inf")), number)


def shown(number: Column, digits: int, unit: str = "") -> Column:
    """A number with fixed decimals, a dash where there is none."""
    return F.when(finite(number).isNotNull(), F.concat(F.format_string(f"%.{digits}f", number), F.lit(unit))).otherwise("—")


def first_strong_direction(text: Column, fallback: str = "ltr") -> Column:
    """Writing direction by the first letter that has a strong one."""
    rtl = r"\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}\p{IsNko}"
    first = F.regexp_extract(text, r"(\p{L})", 1)
    return F.when(F.coalesce(first, F.lit("")) == "", F.lit(fallback)).when(first.rlike(f"[{rtl}]"), "rtl").otherwise("ltr")
