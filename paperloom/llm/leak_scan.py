"""Evaluation passages in a corpus (problem 7): Wu-Manber multi-pattern search over words.

Patterns are all runs of 13 words of the test items.  Texts become word hashes; a shift table over blocks of two
words says how far the search may jump, buckets by the hash of the last block select the patterns, a prefix
block thins them, and the words themselves are compared.  All texts of an Arrow slice are searched abreast, a
cursor for every 256 words, so long texts take no longer per word than short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V

RUN = 13
_STRETCH = 256
#: Words of test items searched for at once, and cells of the shift table for each of them.
BLOCK_WORDS, CELLS = 200_000, 64


def _block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return V.mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


@dataclass
class Patterns:
    """Tables of the search: patterns as word hashes sorted by their last block, and the shift table."""

    words: np.ndarray  # (patterns, run)
    items: np.ndarray  # number of the test item of each pattern
    suffix: np.ndarray
    prefix: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], run: int = RUN) -> Patterns:
        """All runs of ``run`` words of the texts; a text of fewer words has none."""
        codes, offsets = V.code_points(pa.array(texts, pa.string()))
        hashes, docs, _, _ = V.words(codes, offsets)
        at = np.flatnonzero(docs[: len(docs) - run + 1] == docs[run - 1 :]) if len(docs) >= run else np.zeros(0, np.int64)
        words = hashes[at[:, None] + np.arange(run)]
        items = docs[at]
        suffix, prefix = _block(words[:, -2], words[:, -1]), _block(words[:, 0], words[:, 1])
        order = np.argsort(suffix, kind="stable")
        # sparse enough for long jumps however many patterns there are
        shift = np.full(1 << max(16, int(CELLS * len(items)).bit_length()), run - 1, np.uint8)
        for end in range(1, run):
            cell = _block(words[:, end - 1], words[:, end]) & np.uint64(len(shift) - 1)
            np.minimum.at(shift, cell.astype(np.int64), np.uint8(run - 1 - end))
        return cls(words[order], items[order], suffix[order], prefix[order], shift)

    def search(self, hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, patterns): where a pattern's last word stands, and which pattern."""
        run, n = self.words.shape[1], len(hashes)
        if n < run or not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        end = np.r_[first[1:], n]
        starts = first + run - 1
        pieces = np.maximum(0, -(-(end - starts) // _STRETCH))
        owner = np.repeat(np.arange(len(first)), pieces)
        at = starts[owner] + _STRETCH * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(at + _STRETCH, end[owner])
        found = []
        while len(at):
            blocks = _block(hashes[at - 1], hashes[at])
            jump = self.shift[(blocks & np.uint64(len(self.shift) - 1)).astype(np.int64)]
            here = jump == 0
            if here.any():
                found.append(np.stack([at[here], blocks[here].view(np.int64)], axis=1))
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.concatenate(found)
        where, blocks = found[:, 0], found[:, 1].view(np.uint64)
        low, high = np.searchsorted(self.suffix, blocks, "left"), np.searchsorted(self.suffix, blocks, "right")
        sizes = high - low
        where = np.repeat(where, sizes)
        pattern = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        ok = _block(hashes[where - run + 1], hashes[where - run + 2]) == self.prefix[pattern]
        where, pattern = where[ok], pattern[ok]
        for k in range(run):
            ok = hashes[where - run + 1 + k] == self.words[pattern, k]
            where, pattern = where[ok], pattern[ok]
        return where, pattern


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, doc_id: str = "doc_id", item_id: str = "item_id", column: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, runs): one row for each document and test item that share ``run`` words in a
    row; first_word is the position of the first such run in the document, runs how many of its runs match.

    Words are runs of letters or digits in lower case, whatever stands between them.  Null and short texts match
    nothing; null ids are kept as null.  Test items are sent to the tasks in blocks of about ``block_words`` words,
    so any number of them, and of any length, can be searched; the corpus is read once for each block.
    """
    ids = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}"
    rows = docs.where(F.col(column).isNotNull()).select(doc_id, F.col(column).cast("string").alias("text"))
    out = None
    listed = items.where(F.col(column).isNotNull()).select(item_id, column).distinct()
    total = listed.agg(F.coalesce(F.sum(F.regexp_count(F.col(column), F.lit(r"[\p{L}\p{N}]+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_words))
    for block in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64(item_id, column), F.lit(blocks)) == block)
        table = part.toArrow()
        sent = docs.sparkSession.sparkContext.broadcast((Patterns.of(table.column(1).to_pylist(), run), table.column(0).combine_chunks()))

        def search(batches, sent=sent):
            patterns, names = sent.value
            for batch in batches:
                for a, b in V.slices(batch.column(1)):
                    codes, offsets = V.code_points(batch.column(1)[a:b])
                    hashes, texts, _, _ = V.words(codes, offsets)
                    ends, pattern = patterns.search(hashes, texts)
                    if not len(ends):
                        continue
                    owner, item = texts[ends], patterns.items[pattern]
                    begin = np.searchsorted(texts, owner)
                    position = ends - begin - patterns.words.shape[1] + 1
                    order = np.lexsort((position, item, owner))
                    owner, item, position = owner[order], item[order], position[order]
                    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])])
                    # a run that is in an item twice counts once
                    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (position[1:] != position[:-1])]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner[new] + a)), names.take(pa.array(item[new])), pa.array(position[new].astype(np.int32)), pa.array(np.add.reduceat(fresh, new).astype(np.int32))],
                        [doc_id, item_id, "first_word", "runs"],
                    )

        hits = rows.mapInArrow(search, f"{ids}, first_word int, runs int")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy(doc_id, item_id).agg(F.min("first_word").alias("first_word"), F.max("runs").alias("runs"))
