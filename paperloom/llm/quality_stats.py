"""Per-document text statistics and structural profiles (problem 6).

Every line of a page becomes three distributions: over character classes, over kinds of words (function words, short,
middle, long and run-together ones), and, from basic counts, over the marks of layout that it carries (list markers
and entries in a row, leaders before a trailing number, cells, unreadable characters, or none of them).  The
Jensen-Shannon divergence to the profiles of prose in five languages, of list entries, contents entries, table rows
and of four kinds of unreadable text assigns each line its nearest structural profile; a page takes the profile that
most of its lines have.  Lines are worked on by the slice in NumPy, never one at a time.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V

CHAR_CLASSES = ("vowel", "consonant", "upper", "accented", "arabic", "other letter", "digit", "space", "punctuation", "dash", "mark", "symbol", "broken")
WORD_CLASSES = ("function", "short", "middle", "long", "run-together")

# --- fixed values: shares of character and word classes per structural profile ------------------------
PROFILES = {
    "prose-en": ((0.320, 0.490, 0.012, 0.003, 0.0, 0.0, 0.004, 0.150, 0.017, 0.004, 0.0, 0.0, 0.0), (0.33, 0.12, 0.42, 0.13, 0.00)),
    "prose-de": ((0.305, 0.480, 0.040, 0.018, 0.0, 0.0, 0.004, 0.128, 0.022, 0.003, 0.0, 0.0, 0.0), (0.33, 0.10, 0.33, 0.24, 0.00)),
    "prose-fr": ((0.345, 0.430, 0.008, 0.025, 0.0, 0.0, 0.004, 0.160, 0.022, 0.003, 0.0, 0.003, 0.0), (0.38, 0.12, 0.38, 0.12, 0.00)),
    "prose-es": ((0.385, 0.410, 0.008, 0.020, 0.0, 0.0, 0.004, 0.155, 0.016, 0.002, 0.0, 0.0, 0.0), (0.42, 0.08, 0.38, 0.12, 0.00)),
    "prose-ar": ((0.0, 0.0, 0.0, 0.0, 0.820, 0.0, 0.012, 0.150, 0.018, 0.0, 0.0, 0.0, 0.0), (0.18, 0.17, 0.63, 0.02, 0.00)),
    "signs": ((0.020, 0.030, 0.030, 0.0, 0.0, 0.0, 0.060, 0.010, 0.280, 0.030, 0.140, 0.400, 0.0), (0.00, 0.95, 0.05, 0.00, 0.00)),
    "letters": ((0.190, 0.650, 0.0, 0.0, 0.0, 0.0, 0.0, 0.155, 0.0, 0.0, 0.0, 0.0, 0.0), (0.02, 0.26, 0.44, 0.28, 0.00)),
    "run-together": ((0.370, 0.580, 0.0, 0.0, 0.0, 0.0, 0.0, 0.005, 0.0, 0.005, 0.010, 0.030, 0.0), (0.00, 0.00, 0.02, 0.08, 0.90)),
    "mojibake": ((0.0, 0.0, 0.010, 0.560, 0.0, 0.020, 0.0, 0.120, 0.0, 0.0, 0.0, 0.190, 0.100), (0.00, 0.55, 0.35, 0.10, 0.00)),
    "list": ((0.270, 0.430, 0.045, 0.005, 0.0, 0.0, 0.070, 0.120, 0.008, 0.024, 0.026, 0.0, 0.0), (0.10, 0.20, 0.50, 0.20, 0.00)),
    "contents": ((0.157, 0.246, 0.008, 0.0, 0.0, 0.0, 0.212, 0.120, 0.256, 0.001, 0.0, 0.0, 0.0), (0.10, 0.45, 0.30, 0.15, 0.00)),
    "table": ((0.157, 0.261, 0.058, 0.004, 0.0, 0.0, 0.232, 0.174, 0.041, 0.020, 0.029, 0.025, 0.0), (0.05, 0.55, 0.30, 0.10, 0.00)),
}
#: Shares of the layout marks (none, list, contents, table, unreadable) that lines of each kind carry.
LAYOUTS = ((1.0, 0.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0, 1.0))
#: Weights of the divergences of characters, words and layout in the choice of the nearest profile.
WEIGHTS = (0.12, 0.08, 0.8)
# --- end of fixed values ------------------------------------------------------------------------------

PROSE, UNREADABLE, STRUCTURED = slice(0, 5), slice(5, 9), (9, 10, 11)
#: Bits of divergence from the nearest prose profile from which a line without function words is unreadable.
FAR = 0.06


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Number of the character class of each code point."""
    out = np.full(V._TABLE, 11, np.int8)
    for i in range(V._TABLE):
        c = chr(i)
        if c.isspace():
            out[i] = 7
        elif c.isdigit():
            out[i] = 6
        elif c.isalpha():
            if i < 128:
                out[i] = 2 if c.isupper() else 0 if c in "aeiou" else 1
            elif i < 0x250 or 0x1E00 <= i < 0x1F00:
                out[i] = 3
            elif 0x600 <= i < 0x780 or 0xFB50 <= i < 0xFF00:
                out[i] = 4
            else:
                out[i] = 5
        elif c in ".,;:!?'\"()،؛؟…’‘“”«»„":
            out[i] = 8
        elif c in "-‐‑–—­":
            out[i] = 9
        elif c in "|•·●▪*[]{}":
            out[i] = 10
        elif i == 0xFFFD or unicodedata.category(c) in ("Cc", "Cn", "Co"):
            out[i] = 12
    return out


@lru_cache(maxsize=1)
def _profiles() -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    names = tuple(PROFILES)
    chars = np.array([PROFILES[n][0] for n in names])
    words = np.array([PROFILES[n][1] for n in names])
    return names, (chars / chars.sum(axis=1, keepdims=True)).astype(np.float32), (words / words.sum(axis=1, keepdims=True)).astype(np.float32)


def entropy(rows: np.ndarray) -> np.ndarray:
    """Entropy in bits of each row of shares."""
    return -(rows * np.log2(np.where(rows > 0, rows, 1.0))).sum(axis=-1)


def divergence(rows: np.ndarray, profile: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of shares to one profile; ``own`` is the rows' entropy if known."""
    return np.maximum(entropy((rows + profile) / 2) - ((entropy(rows) if own is None else own) + entropy(profile)) / 2, 0.0)


def word_keys(words: list[str]) -> np.ndarray:
    """Sorted hashes of a list of words, for telling function words in text."""
    codes, offsets = V.code_points(pa.array(words, pa.string()))
    return np.unique(V.words(codes, offsets)[0])


@dataclass
class Lines:
    """The non-empty lines of the pages of one slice.  Kinds: 0 prose, 1 list, 2 contents, 3 table, 4 unreadable."""

    codes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    pages: np.ndarray
    from_top: np.ndarray
    from_bottom: np.ndarray
    words: np.ndarray
    function_words: np.ndarray
    word_chars: np.ndarray
    chars: np.ndarray
    kinds: np.ndarray
    full_stop: np.ndarray
    running: np.ndarray

    def text(self, i: int) -> str:
        """The i-th line as stored, trimmed."""
        return self._stored[self.starts[i] : self.ends[i]]

    @cached_property
    def _stored(self) -> str:
        return self.codes.tobytes().decode("utf-32-le", "replace")


KINDS = ("prose", "list", "contents", "table", "unreadable")


def _in_rows(flags: np.ndarray, pages: np.ndarray, least: int) -> np.ndarray:
    """Flags that stand in a row of at least ``least`` flagged lines of one page."""
    first = np.flatnonzero(np.r_[True, pages[1:] != pages[:-1]]) if len(pages) else np.zeros(0, np.int64)
    starts, ends, _ = V.runs(flags, np.r_[first, len(flags)])
    out = np.zeros(len(flags) + 1, np.int64)
    long = ends - starts >= least
    np.add.at(out, starts[long], 1)
    np.add.at(out, ends[long], -1)
    return np.cumsum(out)[: len(flags)] > 0


def _whole_page(flags: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Whether more than half of the lines of a line's page are flagged."""
    if not len(pages):
        return flags
    return (np.bincount(pages, weights=flags) * 2 > np.bincount(pages))[pages]


def read_lines(texts: pa.Array, function_words: np.ndarray) -> Lines:
    """Cuts texts into lines (at LF, CR LF or CR) and gives each its structural kind."""
    codes, offsets = V.code_points(texts)
    n = len(codes)
    classes = V.look_up(char_classes(), codes)
    newline = (codes == 10) | (codes == 13) | (codes == 0x85) | (codes == 0x2028)
    space = classes == 7
    starts, ends, pages = V.runs(~newline, offsets)
    where = np.flatnonzero(~space)
    left, right = np.searchsorted(where, starts), np.searchsorted(where, ends)
    keep = right > left
    starts, ends, pages = where[left[keep]], where[right[keep] - 1] + 1, pages[keep]  # trimmed
    lines = len(starts)
    length = ends - starts
    at = np.repeat(starts - np.cumsum(length) + length, length)
    at += np.arange(len(at))
    k = len(CHAR_CLASSES)
    chars = np.bincount(np.repeat(np.arange(lines) * k, length) + classes[at], minlength=lines * k).reshape(lines, k).astype(float) if lines else np.zeros((0, k))
    hashes, _, word_starts, word_ends = V.words(codes, offsets)
    word_line = np.repeat(np.arange(lines), np.diff(np.searchsorted(word_starts, starts), append=len(word_starts)))
    size = word_ends - word_starts
    is_function = V.is_in(hashes, function_words)
    kind = np.where(is_function, 0, np.where(size <= 3, 1, np.where(size <= 9, 2, np.where(size <= 18, 3, 4))))
    m = len(WORD_CLASSES)
    words = np.bincount(word_line * m + kind, minlength=lines * m).reshape(lines, m).astype(float) if lines else np.zeros((0, m))
    word_chars = np.bincount(word_line, weights=size, minlength=lines) if lines else np.zeros(0)
    first_of_page = np.searchsorted(pages, pages, side="left")
    last_of_page = np.searchsorted(pages, pages, side="right")
    from_top, from_bottom = np.arange(lines) - first_of_page, last_of_page - 1 - np.arange(lines)
    _, char_profiles, word_profiles = _profiles()
    char_shares = (chars / np.maximum(chars.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    word_total = words.sum(axis=1)
    word_shares = (words / np.maximum(word_total[:, None], 1)).astype(np.float32)

    def apart(which, at: np.ndarray):
        """Divergences of the characters and of the words of lines to profiles; lines without words are far from any."""
        own_chars, own_words, some = char_shares[at], word_shares[at], word_total[at] > 0
        of_chars, of_words = entropy(own_chars), entropy(own_words)
        for k in which:
            yield divergence(own_chars, char_profiles[k], of_chars), np.where(some, divergence(own_words, word_profiles[k], of_words), 1.0)

    def nearest(at: np.ndarray) -> None:
        """Fills in how far lines are from prose and from unreadable text."""
        both = [0.6 * c + 0.4 * w for c, w in apart(range(PROSE.start, UNREADABLE.stop), at)]
        prose[at], junk[at] = np.min(both[: PROSE.stop], axis=0), np.min(both[PROSE.stop :], axis=0)

    # lines with function words are asked only where they carry a mark of layout
    prose, junk = np.full(lines, np.inf), np.full(lines, np.inf)
    bare_words = (words[:, 0] <= 1) | (words[:, 0] <= 0.08 * word_total)
    if bare_words.any():
        nearest(np.flatnonzero(bare_words))
    last = codes[ends - 1] if lines else np.zeros(0, np.uint32)
    full_stop = np.isin(last, [ord(c) for c in ".!?؟。:"])
    # basic counts
    initial = codes[starts] if lines else np.zeros(0, np.uint32)
    second = codes[np.minimum(starts + 1, n - 1)] if lines else np.zeros(0, np.uint32)
    marker = np.isin(initial, [ord(c) for c in "-–—*•·▪●○◦■□☐☑✓"]) & ((second == 32) | (second == 9)) | (initial == ord("[")) & np.isin(second, [32, ord("x"), ord("X"), ord("]")]) | np.isin(initial, [0x2610, 0x2611])
    gap = np.zeros(n, bool)
    if n > 1:
        gap[1:] = space[1:] & space[:-1] & ~newline[1:] & ~newline[:-1]
    wide = gap.copy()
    if n > 2:
        wide[1:] &= ~gap[:-1]  # one per run of blanks
        some = np.flatnonzero(wide[2:])
        wide[2 + some[np.isin(codes[some], [ord(c) for c in ".!?؟:"])]] = False  # two blanks after a sentence
    cells = V.counts_in((codes == ord("|")) | (codes == 9), starts, ends)
    semicolons = V.counts_in((codes == ord(";")) & ~np.r_[space[1:], True], starts, ends) if n else np.zeros(0, np.int64)
    gaps = V.counts_in(wide, starts, ends)
    dots = V.counts_in((codes == 46) & np.r_[False, codes[:-1] == 46], starts, ends) if n else np.zeros(0, np.int64)
    commas = V.counts_in((codes == 44) & np.r_[space[1:], False] & np.r_[classes[2:] == 6, False, False], starts, ends) if n > 2 else np.zeros(lines, np.int64)
    ends_digit = (classes[ends - 1] == 6) if lines else np.zeros(0, bool)
    table = (cells >= 1) | (semicolons >= 2) | ((gaps >= 1) & (prose > 0.03) & (words[:, 0] <= 1))
    table |= (gaps >= 2) & (word_total <= 6 * (gaps + 1))
    table &= (word_total <= 40 + 4 * (cells + semicolons + gaps)) & (words[:, 0] <= 2 + 2 * (cells + semicolons + gaps))
    contents = ends_digit & ((dots >= 3) | (commas >= 2) | (commas >= 1) & (word_total <= 7))
    unreadable = (junk < prose) & (words[:, 0] <= 0.08 * word_total) & ((prose > FAR) | (junk < 0.7 * prose))
    unreadable &= (junk < 0.12) | (word_total == 0) | (word_shares[:, 4] > 0.3) | (char_shares[:, 11:].sum(axis=1) + char_shares[:, 10] > 0.25)
    digits_only = (chars[:, 6] > 0) & (chars[:, :6].sum(axis=1) == 0) & (ends - starts <= 9) if lines else np.zeros(0, bool)
    # entries without a marker, and text without a function word, only count in a row of such lines
    short = (words[:, 0] == 0) & (word_total <= 7) & (word_total >= 1) & ~full_stop & ~digits_only & ((ends - starts) <= 70)
    bare = _in_rows(short & ~(last == ord(",")), pages, 3)
    lone = (word_chars <= 1) & (ends - starts <= 2)
    unreadable |= _in_rows(lone, pages, 5)
    unreadable &= _in_rows(lone, pages, 5) | (char_shares[:, 10:].sum(axis=1) > 0.25) | _in_rows(unreadable, pages, 3) | _whole_page(unreadable, pages)
    # the marks of layout that a line carries; those that say more weigh more
    listed = marker & ~(last == ord(".")) & ~digits_only
    marks = np.zeros((lines, len(KINDS)), np.float32)
    marks[:, 1] = 8 * listed + 1 * (bare & ~unreadable)
    marks[:, 2] = 4 * (contents & ~marker)
    marks[:, 3] = 2 * (table & ~(bare & marker & ~listed))
    marks[:, 4] = np.where(char_shares[:, 11:].sum(axis=1) > 0.2, 32, 0.5) * unreadable
    out = np.zeros(lines, np.int8)
    at = np.flatnonzero(marks.any(axis=1))
    if len(at):
        layout = marks[at] / marks[at].sum(axis=1, keepdims=True)
        of_layout = entropy(layout)
        far = np.stack([WEIGHTS[2] * divergence(layout, np.array(x, np.float32), of_layout) for x in LAYOUTS], axis=1)
        if not bare_words[at].all():
            nearest(at[~bare_words[at]])
        far[:, 0] += sum(WEIGHTS[:2]) * prose[at]
        far[:, 4] += sum(WEIGHTS[:2]) * junk[at]
        for kind, both in enumerate(apart(STRUCTURED, at), 1):
            far[:, kind] += sum(w * d for w, d in zip(WEIGHTS, both))
        out[at] = far.argmin(axis=1)
    edge = np.minimum(from_top, from_bottom) <= 1
    third = codes[np.minimum(starts + 2, n - 1)] if lines else np.zeros(0, np.uint32)
    heading = ((initial >= 48) & (initial <= 57)) & ((second == 46) | (third == 46))
    tabular = (out == 3) & ((cells + semicolons > 0) | (gaps != 1) | (chars[:, 6] > 0))
    running = (edge & ~heading & ~tabular & (semicolons == 0) & ~full_stop & (word_total <= 9) & (words[:, 0] <= 1) & (out != 1) & (out != 2) & (cells <= 1) & (out != 4)) | digits_only & edge
    return Lines(codes, offsets, starts, ends, pages, from_top, from_bottom, word_total, words[:, 0], word_chars, chars, out, full_stop, running)


def page_kinds(lines: Lines, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines of each kind, whole lines) per page, running lines aside.

    A prose line that is a whole paragraph counts once, like any other line.
    """
    k = len(KINDS)
    body = ~lines.running
    counts = np.bincount(lines.pages[body] * k + lines.kinds[body], minlength=pages * k).reshape(pages, k)
    return counts, counts.sum(axis=1)


def _function_words(words: DataFrame, limit: int = 20_000) -> np.ndarray:
    """Keys of the common words; their number is checked, as they are sent to every task."""
    found = words.where("word IS NOT NULL").select("word").distinct().limit(limit + 1).toArrow().column(0).to_pylist()
    if len(found) > limit:
        raise ValueError(f"more than {limit} common words")
    return word_keys(found)


SCHEMA = "source string, page int, words int, mean_word_length double, symbol_share double, punctuated_lines double, common_words double, lines int, structured_lines double, profile string"


def _statistics(common: np.ndarray):
    def run(batches):
        for batch in batches:
            for a, b in V.slices(batch.column(2)):
                n = b - a
                lines = read_lines(batch.column(2)[a:b], common)
                counts, whole = page_kinds(lines, n)
                add = lambda x: np.bincount(lines.pages, weights=x, minlength=n)  # noqa: B023, E731
                words, chars = add(lines.words), add(lines.chars.sum(axis=1))
                symbols = add(lines.chars[:, 8:].sum(axis=1))
                all_lines = np.bincount(lines.pages, minlength=n)
                share = lambda x, y: np.round(x / np.maximum(y, 1), 4)
                structured = counts[:, 1:].sum(axis=1)
                kind = np.where(whole == 0, "empty", np.where(2 * structured > whole, np.array(KINDS)[1 + counts[:, 1:].argmax(axis=1)], "prose"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b], batch.column(1)[a:b], pa.array(words.astype(np.int32)), pa.array(share(add(lines.word_chars), words)), pa.array(share(symbols, chars)),
                        pa.array(share(add(lines.full_stop), all_lines)), pa.array(share(add(lines.function_words), words)), pa.array(all_lines.astype(np.int32)), pa.array(share(structured, whole)), pa.array(kind.tolist(), pa.string()),
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return run


def page_statistics(pages: DataFrame, common_words: DataFrame, source: str = "source", page: str = "page", column: str = "text") -> DataFrame:
    """One row per distinct stored page text: word count, mean word length, share of symbols, of lines that end
    like sentences and of common words, number of lines, share of structured (not prose) lines and the profile.

    A null or blank text has zero counts and the profile 'empty'.  Pages stored twice with one text give one
    row; with two texts, two rows.  Null source or page is kept as null.
    """
    common = _function_words(common_words)
    rows = pages.select(F.col(source).cast("string").alias("source"), F.col(page).cast("int").alias("page"), F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(_statistics(common), SCHEMA).distinct()


def structured_pages(pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """(source, page): pages with text of which more than half of the lines, running lines aside, are list or
    contents entries, table rows or unreadable."""
    return page_statistics(pages, common_words).where("profile NOT IN ('prose', 'empty')").select("source", "page").distinct()
