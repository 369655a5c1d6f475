"""Lines repeated across the documents of one source (problem 4).

Texts are cut by content, not by newlines: a rolling hash runs over the comparable characters and a cut falls
where the hash is the smallest of its window, so equal passages are cut alike wherever they stand.  Distinct
documents are counted per piece and source; where a piece recurs too often, the lines it covers are checked
exactly and cut from each document.

No repeated line can be lost: a newline enters the stream as a run as long as hash and window together, so the
cuts inside and at the ends of a line follow from the line alone, whatever its neighbours are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import vectext as V
from .keyfilter import KeyFilter, key_filter

HASH_WIDTH, WINDOW = 8, 32
MIN_DOCUMENTS, MIN_SHARE = 8, 0.1
_RUN = HASH_WIDTH + WINDOW
#: Windows that are worked on at once: their hashes stay in the cache of a core.
_BLOCK = 1 << 15


def comparable(codes: np.ndarray, offsets: np.ndarray):
    """Lower case, blanks as one space and trimmed from line ends, digit runs as '#': (codes, offsets)."""
    return _comparable(codes, offsets)[:2]


def _comparable(codes: np.ndarray, offsets: np.ndarray):
    """The comparable form and the place in the stored text of each of its characters: (codes, offsets, places)."""
    low = V.lower(codes)
    n = len(low)
    if n == 0:
        return low, offsets, np.zeros(0, np.int64)
    blank, digit = (low == 32) | (low == 9) | (low == 13), (low >= 48) & (low <= 57)
    again = np.zeros(n, bool)  # goes on with the blanks or digits before it, in the same text
    np.logical_and(blank[1:], blank[:-1], out=again[1:])
    again[1:] |= digit[1:] & digit[:-1]
    again[offsets[:-1][offsets[:-1] < n]] = False
    low[blank] = 32
    low[digit] = 35
    # a blank at the edge of a line goes too: the last of its run, after a line end or before one
    kept = np.flatnonzero(~again)
    out, begin = low[kept], np.searchsorted(kept, offsets)
    edge = np.zeros(len(out) + 1, bool)
    edge[begin] = True
    newline = out == 10
    edge[1:] |= newline
    edge[:-1] |= newline
    at = np.flatnonzero(out == 32)
    at = at[edge[at] | edge[at + 1]]
    keep = np.ones(len(out), bool)
    keep[at] = False
    return out[keep], begin - np.searchsorted(at, begin), kept[keep]


def rolling_hashes(stream: np.ndarray) -> np.ndarray:
    """Hash of the HASH_WIDTH characters from each place on."""
    if len(stream) < HASH_WIDTH:
        return np.zeros(0, np.uint64)
    out, factor, width = stream.astype(np.uint64), 0x100000001B3, 1
    while width < HASH_WIDTH:  # twice as many characters each time
        left = out[:-width] * np.uint64(factor)
        left += out[width:]
        out, factor, width = left, factor * factor & 0xFFFFFFFFFFFFFFFF, 2 * width
    return out


def _smallest(stream: np.ndarray, first: int) -> np.ndarray:
    """Places of the smallest hash of each window of a part of a stream that begins at ``first``, the last one of
    equals; the place in the low bits breaks ties."""
    order = V.mix(rolling_hashes(stream))
    order &= np.uint64(0xFFFFFFFF00000000)
    order |= np.arange(0xFFFFFFFF - first, 0xFFFFFFFF - first - len(order), -1).view(np.uint64)
    span = 1
    while span < WINDOW:
        order = np.minimum(order[:-span], order[span:])
        span *= 2
    order = order[np.flatnonzero(np.r_[True, order[1:] != order[:-1]])]  # many windows have one smallest
    return (np.uint64(0xFFFFFFFF) - (order & np.uint64(0xFFFFFFFF))).astype(np.int64)


def content_pieces(codes: np.ndarray, offsets: np.ndarray):
    """Content-defined pieces of comparable texts.

    Returns (hash, text number, first, end) per piece, where first and end index ``codes``; pieces of
    newlines only are left out.
    """
    n, texts = len(codes), len(offsets) - 1
    # stream: each newline, and each end of a text, becomes a run of newlines
    newline = codes == 10
    jump = np.empty(n + 1, np.int64)
    jump[0] = _RUN
    jump[1:] = 1
    jump[1:][newline] = _RUN
    np.add.at(jump, offsets[1:-1], 2 * _RUN)
    place = np.cumsum(jump, out=jump)[:-1]
    breaks = np.flatnonzero(newline)
    text_begin = offsets[:-1] + (_RUN - 1) * np.searchsorted(breaks, offsets[:-1]) + 2 * _RUN * np.arange(texts)
    size = n + (_RUN - 1) * len(breaks) + 2 * _RUN * texts
    stream = np.full(size, 10, np.uint32)
    stream[place] = codes  # the rest of each run is newlines already
    cut = np.zeros(size + 1, bool)
    for k in range(0, size - HASH_WIDTH - WINDOW + 2, _BLOCK):
        cut[_smallest(stream[k : k + _BLOCK + HASH_WIDTH + WINDOW - 2], k)] = True
    cut[text_begin] = True
    cut[size] = True
    edges = np.flatnonzero(cut)
    character = np.flatnonzero(~newline)
    before = np.r_[0, np.cumsum(stream != 10, dtype=np.int32)][edges]
    a, b = edges[:-1], edges[1:]
    real = before[1:] > before[:-1]
    a, b = a[real], b[real]
    hashes = V.span_hashes(stream, a, b)
    first, end = character[before[:-1][real]], character[before[1:][real] - 1] + 1
    return hashes, np.searchsorted(text_begin, a, side="right") - 1, first, end


def _slices(batch: pa.RecordBatch, column: int):
    for a, b in V.slices(batch.column(column), V.SLICE_CHARS // 2):
        codes, offsets = V.code_points(batch.column(column)[a:b])
        yield a, b, *comparable(codes, offsets)


def _keys(source_hash: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return V.mix(source_hash.view(np.uint64) + V.mix(piece)).view(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each of the different keys, and how many there are of it; equal keys may stand for each other."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order[first], np.diff(first, append=len(keys))


def _count_pieces(batches):
    """(source_hash, piece, documents): in how many rows of the batch a piece occurs."""
    for batch in batches:
        sources = np.asarray(batch.column(1)) if batch.num_rows else None
        for a, b, codes, offsets in _slices(batch, 0):
            hashes, texts, _, _ = content_pieces(codes, offsets)
            # sorts of single 64-bit keys; a piece counts once a text, then its texts are counted by source
            once, _ = _distinct(V.mix(hashes + V.mix(V.spread(texts))))
            hashes, source = hashes[once], sources[a:b][texts[once]]
            first, counts = _distinct(V.mix(hashes + V.mix(source.view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(source[first]), pa.array(hashes[first].view(np.int64)), pa.array(counts.astype(np.int32))], ["source_hash", "piece", "documents"])


def _lines(codes: np.ndarray, offsets: np.ndarray):
    """(starts, ends, texts) of the lines of comparable texts that have a character."""
    return V.runs(codes != 10, offsets)


def _candidate_lines(frequent: KeyFilter):
    """(row, line): lines all of whose pieces recur in their source, once a row and line."""

    def run(batches):
        for batch in batches:
            sources = np.asarray(batch.column(1)) if batch.num_rows else None
            for a, b, codes, offsets in _slices(batch, 0):
                hashes, texts, first, end = content_pieces(codes, offsets)
                hit = frequent.maybe(_keys(sources[a:b][texts], hashes))
                miss = np.r_[0, np.cumsum(~hit)]
                starts, ends, owner = _lines(codes, offsets)
                # pieces that touch a line: those from the one that holds its first character to the one of its last
                left = np.searchsorted(end, starts, side="right")
                right = np.searchsorted(first, ends - 1, side="right")
                ok = np.flatnonzero((miss[right] - miss[left] == 0) & (right > left))
                if not len(ok):
                    continue
                line = [codes[s:e].tobytes().decode("utf-32-le", "replace") for s, e in zip(starts[ok], ends[ok])]
                rows = pa.array(owner[ok] + a)
                yield pa.RecordBatch.from_arrays([batch.column(2).take(rows), batch.column(3).take(rows), pa.array(line, pa.string())], ["key", "source", "line"])

    return run


def repeated_lines(df: DataFrame, key: str = "chunk_id", source: str = "source", column: str = "text", min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, line, documents, source_documents): comparable lines with a letter that occur in at least
    ``min_documents`` distinct keys of a source and in at least ``min_share`` of its distinct keys.

    Rows with a null key, source or text are left out; rows repeated under one key count once.  Empty texts
    count as documents of their source.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(source).isNotNull()).select(
        F.col(column).cast("string").alias("text"), F.xxhash64(F.col(source).cast("string")).alias("source_hash"), F.col(key).cast("string").alias("key"), F.col(source).cast("string").alias("source")
    )
    sizes = rows.select("source", "source_hash", "key").distinct().groupBy("source", "source_hash").agg(F.count(F.lit(1)).alias("source_documents"))
    sizes = written(sizes, "source-sizes")
    least = F.greatest(F.lit(min_documents), F.ceil(F.col("source_documents") * min_share - 1e-9))
    rows = rows.where("text IS NOT NULL")
    # rows stored twice are counted twice here: never too few, and the exact count below settles it
    counts = rows.select("text", "source_hash").mapInArrow(_count_pieces, "source_hash bigint, piece bigint, documents int")
    counts = counts.groupBy("source_hash", "piece").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= min_documents)
    frequent = counts.join(sizes, "source_hash").where(F.col("documents") >= least).select("source_hash", "piece")
    frequent = written(frequent.mapInArrow(_piece_keys, "k bigint"), "frequent-pieces")
    known = key_filter(frequent, "k", frequent.count())
    lines = rows.select("text", "source_hash", "key", "source").mapInArrow(_candidate_lines(known), "key string, source string, line string")
    found = lines.distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= min_documents)
    found = found.join(sizes.select("source", "source_documents"), "source").where(F.col("documents") >= least)
    return found.where(F.col("line").rlike(r"\p{L}"))


def _piece_keys(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)))], ["k"])


#: Lines of at least so many characters are also cut out of the middle of other lines.
INSIDE = 24
#: Bytes of repeated lines that are sent to all tasks; more of them meet the rows in a join by source.
SENT_BYTES = 16 << 20


def _cut_out(rows: pa.RecordBatch, first: int, end: int) -> tuple[list[str | None], list[int]]:
    """Texts of a slice of (key, source, text, lines) rows without the lines, and how many passages were cut from each.

    A line is anchored at its smallest rolling hash, a cut that its content defines; wherever the same hash turns up
    in a text of the source, the whole line is compared there, be it a line of its own or not.
    """
    texts = rows.column(2)[first:end]
    codes, offsets = V.code_points(texts)
    low, at, places = _comparable(codes, offsets)
    n = end - first
    known: dict = {}
    number, lines, of = np.zeros(n, np.int64), [], []
    for i, (source, gone) in enumerate(zip(rows.column(1)[first:end].to_pylist(), rows.column(3)[first:end])):
        if source not in known:
            known[source] = len(known)
            gone = gone.as_py() or []
            lines += gone
            of += [known[source]] * len(gone)
        number[i] = known[source]
    out, removed = texts.to_pylist(), [0] * n
    if not lines or not len(low):
        return out, removed
    notice, bounds = V.code_points(pa.array(lines, pa.string()))
    size = np.diff(bounds)
    of = np.array(of, np.int64)
    whole = V.span_hashes(notice, bounds[:-1], bounds[1:])
    key = lambda group, h: V.mix(h + V.mix(group.astype(np.uint64)))
    # lines of their own
    starts, ends, owner = _lines(low, at)
    alone = np.isin(key(number[owner], V.span_hashes(low, starts, ends)), key(of, whole))
    spans = [np.stack([starts[alone], ends[alone]], axis=1)]
    # inside other lines
    long = np.flatnonzero(size >= INSIDE)
    if len(long) and len(low) >= HASH_WIDTH:
        rolled = V.mix(rolling_hashes(notice))
        anchor = np.array([a + int(np.argmin(rolled[a : b - HASH_WIDTH + 1])) for a, b in zip(bounds[:-1][long], bounds[1:][long])])
        keys = key(of[long], rolled[anchor])
        order = np.argsort(keys, kind="stable")
        keys, long, shift = keys[order], long[order], (anchor - bounds[:-1][long])[order]
        text_of = np.repeat(np.arange(n), np.diff(at))[: len(low) - HASH_WIDTH + 1]
        here = key(number[text_of], V.mix(rolling_hashes(low)))
        left, right = np.searchsorted(keys, here, "left"), np.searchsorted(keys, here, "right")
        hit = np.flatnonzero(right > left)
        count = (right - left)[hit]
        place = np.repeat(hit, count)
        which = np.repeat(left[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
        a = place - shift[which]
        b = a + size[long[which]]
        ok = (a >= at[text_of[place]]) & (b <= at[text_of[place] + 1])
        a, b, which = a[ok], b[ok], long[which[ok]]
        ok = V.span_hashes(low, a, b) == whole[which]
        a, b = a[ok], b[ok]
        letter = np.r_[V.look_up(V.alnum_table(), low), False]
        ok = ~(letter[a] & letter[a - 1] & (a > 0)) & ~(letter[b - 1] & letter[b])
        spans.append(np.stack([a[ok], b[ok]], axis=1))
    spans = np.unique(np.concatenate(spans), axis=0)
    spans = spans[np.r_[True, spans[1:, 0] >= np.maximum.accumulate(spans[:, 1])[:-1]]] if len(spans) else spans
    drop = np.zeros(len(codes) + 1, np.int64)
    stored = np.r_[places, len(codes)]
    text_of = np.searchsorted(at, spans[:, 0], side="right") - 1
    for (a, b), i in zip(spans.tolist(), text_of.tolist()):
        begin, stop = int(stored[a]), min(int(stored[b]), int(offsets[i + 1]))
        if (a == at[i] or low[a - 1] == 10) and (b == at[i + 1] or low[b] == 10):  # a line goes with its line break
            while begin > offsets[i] and codes[begin - 1] != 10:
                begin -= 1
            stop += b < at[i + 1]
        drop[begin] += 1
        drop[stop] -= 1
        removed[i] += 1
    keep = np.cumsum(drop)[:-1] == 0
    for i in np.unique(text_of).tolist():
        span = slice(offsets[i], offsets[i + 1])
        out[i] = codes[span][keep[span]].tobytes().decode("utf-32-le", "replace").strip("\n")
    return out, removed


def remove_repeated_lines(df: DataFrame, lines: DataFrame, key: str = "chunk_id", source: str = "source", column: str = "text") -> DataFrame:
    """(key, source, text, removed): each distinct (key, source, text) without the given lines of its source.

    ``lines`` has source and line in comparable form.  A line goes with its line break; a line of ``INSIDE``
    characters or more is also cut where it stands inside a longer line, between words.  What is left is trimmed of
    line breaks at its ends; removed counts the cuts.  Texts without such lines, nulls among them, come back as they
    were with removed = 0.

    A source has few such lines, as each is in a tenth of its documents; they come to the rows of their source in one
    join, for which the texts stay where they are while all lines together are small.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(column).cast("string").alias("text"))
    lists = written(lines.where("source IS NOT NULL AND line IS NOT NULL").groupBy("source").agg(F.collect_set("line").alias("lines")), "source-lines")
    size = lists.agg(F.coalesce(F.sum(F.octet_length(F.array_join("lines", "\n")) + F.octet_length("source")), F.lit(0)).alias("n")).first()["n"]
    rows = rows.join(F.broadcast(lists) if size <= SENT_BYTES else lists, "source", "left").select("key", "source", "text", "lines")

    def run(batches):
        for batch in batches:
            for a, b in V.slices(batch.column(2), V.SLICE_CHARS // 2):
                text, removed = _cut_out(batch, a, b)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(text, pa.string()), pa.array(removed, pa.int32())], ["key", "source", "text", "removed"])

    kind = df.schema[key].dataType.simpleString()
    # rows stored twice give the same result twice; texts that differ by their notices only are told apart by a hash
    marked = rows.withColumn("key", F.struct("key", F.xxhash64("text").alias("h")))
    out = marked.mapInArrow(run, f"key struct<key:{kind},h:bigint>, source string, text string, removed int").distinct()
    return out.select(F.col("key.key").alias(key), F.col("source").alias(source), F.col("text").alias(column), "removed")
