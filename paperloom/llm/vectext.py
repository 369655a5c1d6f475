"""Array view of a batch of texts: code points, lines, words and n-gram hashes in NumPy.

Every function works on one Arrow string column of a task at once, so the per-character work of the
operators in this package stays out of Python loops.  Batches are cut into slices of about a million
characters, which bounds the memory of a worker whatever the length of a single Arrow batch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that one slice may hold, unless a single text is longer.
SLICE_CHARS = 1 << 20
_TABLE = 0x32400  # code points above are neither cased nor met in running text
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SEEDS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower-case code point of each code point (first one where it has several)."""
    return np.array([ord(chr(i).lower()[0]) for i in range(_TABLE)], dtype=np.uint32)


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    return np.array([chr(i).isalnum() for i in range(_TABLE)], dtype=bool)


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    """Whether a code point is white space."""
    return np.array([chr(i).isspace() for i in range(_TABLE)], dtype=bool)


def char_table(chars: str) -> np.ndarray:
    """Whether a code point is one of ``chars``."""
    out = np.zeros(_TABLE, bool)
    out[[ord(c) for c in chars]] = True
    return out


def look_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """table[codes]; code points beyond the table count as the last one, U+323FF, which is unassigned."""
    return table.take(codes, mode="clip")


def lower(codes: np.ndarray) -> np.ndarray:
    """Lower-case form of an array of code points."""
    out = lower_table().take(codes, mode="clip")
    if len(codes) and codes.max() >= _TABLE:
        beyond = codes >= _TABLE
        out[beyond] = codes[beyond]
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    return _powers(max(1 << 20, 1 << (n - 1).bit_length()) if n else 1 << 20)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher: spreads each bit of a 64-bit value over the whole word."""
    x = np.atleast_1d(x)  # arrays wrap around silently, NumPy scalars warn
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(_SEEDS[0])
    moved = out >> np.uint64(27)
    out ^= moved
    out *= np.uint64(_SEEDS[1])
    np.right_shift(out, np.uint64(31), out=moved)
    out ^= moved
    return out


def spread(numbers: np.ndarray) -> np.ndarray:
    """Small numbers far from those that other hashes start from, so that no sum of two hashes meets its mirror image."""
    return numbers.astype(np.uint64) ^ np.uint64(_SEEDS[3])


def slices(column: pa.Array | pa.ChunkedArray, chars: int = SLICE_CHARS):
    """Row ranges (first, end) of a string column with about ``chars`` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield first, end
        first = end


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the n + 1 offsets of the texts in them.  A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    if at[-1] == at[0]:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    # only the bytes of these texts: a slice shares the buffer of its whole batch
    raw = column.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
    codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) == len(raw):
        return codes, at - at[0]
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.asarray(pc.utf8_length(column)), out=offsets[1:])
    if offsets[-1] == len(codes):
        return codes, offsets
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
    return codes, lead[at - at[0]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of true values; no run goes over from one text to the next."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    # between two characters of a run lies a joint: no text begins there
    joint = np.zeros(n + 1, bool)
    np.logical_and(inside[1:], inside[:-1], out=joint[1:n])
    joint &= ~edge
    starts = np.flatnonzero(inside & ~joint[:-1])
    ends = np.flatnonzero(inside & ~joint[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal spans have equal hashes wherever they stand."""
    up, down = powers(len(codes) + 1)
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    terms = total[1:]
    terms[:] = codes
    terms += np.uint64(1)
    terms *= up[: len(codes)]
    np.cumsum(terms, out=terms)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def counts_in(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each of the spans [start, end)."""
    at = np.flatnonzero(flags)
    return np.searchsorted(at, ends) - np.searchsorted(at, starts)


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of an array of mixed hashes is one of the ``known`` ones, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    low = np.zeros(1 << 16, bool)
    low[(known & np.uint64(0xFFFF)).view(np.int64)] = True
    out = low[(values & np.uint64(0xFFFF)).view(np.int64)]
    at = np.flatnonzero(out)  # few others have the low bits of a known one
    out[at] = known.take(np.searchsorted(known, values[at]), mode="clip") == values[at]
    return out


def words(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, runs of letters or digits in lower case: hashes, text numbers, starts and ends."""
    low = lower(codes)
    starts, ends, docs = runs(look_up(alnum_table(), low), offsets)
    return span_hashes(low, starts, ends), docs, starts, ends


def ngrams(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row, and the position of the first word of each."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(hashes) - n + 1
    at = np.flatnonzero(docs[:last] == docs[n - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mix(out + hashes[at + k] + np.uint64(_SEEDS[k % 5]))
    return out, at
