"""Splitting oversized texts at natural boundaries by recursive bisection (problem 3).

A text above its limit is cut at the strongest boundary near its middle, each half that is still longer than
the limit less the overlap is cut again, and then each piece gets the last characters of what stands before it.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V

DEFAULT_LIMIT, DEFAULT_OVERLAP = 800, 120
#: Share of a stretch, on either side of its middle, in which a stronger boundary beats a nearer one.
REACH = 0.25


def boundary_strengths(codes: np.ndarray) -> np.ndarray:
    """Strength of a cut before each character: 7 paragraph, 6 line, 5 sentence, 4 clause, 3 comma, 2 blank,
    1 between other characters, 0 inside a character with its marks."""
    n = len(codes)
    out = np.ones(n, np.int8)
    if n < 2:
        return out
    newline, blank = codes == 10, V.look_up(V.space_table(), codes)
    after = np.zeros(n, bool)
    after[1:] = blank[:-1] & ~blank[1:]
    out[after] = 2
    before = np.zeros(n, np.uint32)  # last character that is not blank, before each position
    seen = np.where(~blank, np.arange(n), -1)
    last = np.maximum.accumulate(seen)
    before[1:] = np.where(last[:-1] >= 0, codes[np.maximum(last[:-1], 0)], 0)
    for strength, marks in ((3, ",،、"), (4, ";:؛；："), (5, ".!?؟。！？…")):
        out[after & np.isin(before, [ord(c) for c in marks])] = strength
    lines = np.cumsum(newline)
    breaks = np.zeros(n, np.int64)  # newlines in the white space before each position
    start = np.maximum(last[:-1], 0)
    breaks[1:] = lines[:-1] - np.where(last[:-1] >= 0, lines[start], 0)
    out[after & (breaks == 1)] = 6
    out[after & (breaks >= 2)] = 7
    table = np.isin(codes, _marks())
    out[table] = 0
    out[1:][codes[:-1] == 0x200D] = 0
    out[1:][(codes[:-1] == 13) & (codes[1:] == 10)] = 0
    return out


def _marks() -> np.ndarray:
    if not hasattr(_marks, "kept"):
        ranges = (*range(0x300, 0x3100), *range(0xFB1E, 0xFB1F), *range(0xFE00, 0xFE30), *range(0x1F3FB, 0x1F400))
        _marks.kept = np.array([c for c in ranges if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me") or c >= 0x1F3FB] + [0x200D], np.uint32)
    return _marks.kept


def cuts(codes: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces without overlap; the pieces cover the text and none is empty."""
    n = len(codes)
    if n <= limit:
        return [(0, n)]
    room = max(1, limit - overlap)
    strength = boundary_strengths(codes)
    todo, done = [(0, n)], []
    while todo:
        a, b = todo.pop()
        if b - a <= (limit if a == 0 else room):
            done.append((a, b))
            continue
        middle, reach = (a + b) // 2, max(1, int((b - a) * REACH))
        low, high = max(a + 1, middle - reach), min(b - 1, middle + reach)
        at = np.arange(low, high + 1)
        # strength first, then nearness to the middle
        best = int(at[np.lexsort((np.abs(at - middle), -strength[at].astype(np.int16)))[0]])
        todo += [(best, b), (a, best)]
    return sorted(done)


def _pieces(batches):
    for batch in batches:
        key, starts, ends, numbers, counts, texts = [], [], [], [], [], []
        ids, limits, overlaps = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i, text in enumerate(batch.column(1).to_pylist()):
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            found = cuts(codes, limits[i], overlaps[i])
            for number, (a, b) in enumerate(found):
                first = max(0, a - overlaps[i])
                key.append(i)
                numbers.append(number + 1)
                counts.append(len(found))
                starts.append(first)
                ends.append(b)
                texts.append(text[first:b])
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(key, pa.int64())), *(pa.array(x, pa.int32()) for x in (numbers, counts, starts, ends)), pa.array(texts, pa.string())],
            ["key", "piece", "pieces", "start", "end", "text"],
        )


def split_oversized(df: DataFrame, key: str = "chunk_id", column: str = "text", limit: str = "chunk_size", overlap: str = "chunk_overlap") -> DataFrame:
    """(key, piece, pieces, start, end, text): all texts as pieces of at most their limit.

    ``start`` and ``end`` count characters in the stored text; ``text[start:end]`` is the piece, which begins
    with the last ``overlap`` characters before its own part.  A null limit stands for 800, a null overlap for
    120; a limit below one counts as one, a negative overlap as none, and an overlap as large as the limit or
    larger as one character less than it, so that each piece brings a new one.  A text that fits, an empty one too, is its own only piece; a null text has no piece.
    Rows equal in key, text, limit and overlap count once.
    """
    size = F.greatest(F.coalesce(F.col(limit), F.lit(DEFAULT_LIMIT)), F.lit(1)).cast("int")
    rows = df.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"), size.alias("limit"), F.col(overlap).alias("overlap"))
    rows = rows.withColumn("overlap", F.least(F.greatest(F.coalesce("overlap", F.lit(DEFAULT_OVERLAP)), F.lit(0)), F.col("limit") - 1).cast("int"))
    long = rows.where("length(text) > limit")
    fits = rows.where("length(text) <= limit").select("key", "text").distinct()
    fits = fits.select("key", F.lit(1).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start"), F.length("text").alias("end"), "text")
    key_type = df.schema[key].dataType.simpleString()
    cut = long.distinct().mapInArrow(_pieces, f"key {key_type}, piece int, pieces int, start int, `end` int, text string")
    return fits.unionByName(cut).withColumnRenamed("key", key)
