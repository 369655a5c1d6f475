"""Keyword-stuffed pages, link lists and tag lists (problem 9).

Two kinds of evidence are joined.  *List density*, measured in the page alone: which words stand in lines of links
or tags, in phrases repeated outside sentences, or under the *keywords* of the page, pairs of words that recur
until they fill it, be they dressed as sentences or not.  *Replication*: the pages that may be flagged are exploded
into five-word shingles, and distinct hosts are counted per shingle over all documents; words outside sentences
under shingles that several hosts carry are stitched from phrases replicated elsewhere.  A page is flagged when
more than half of its words fall under the two together.

Ordinary sentences are replicated too, so a sentence counts by the repetition inside its page alone.  Repetition,
sentences and words are measured on every page.  What neither stands outside sentences nor under a keyword cannot
count, so a page where that is half of the words is never flagged, whatever its phrases; it still carries phrases:
the shingles of the pages that may be flagged go to the tasks as a fixed-size filter, what the filter lets through
meets them in an exact join, and a task never sends more rows of a phrase than decide whether enough hosts have it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import vectext as V
from .keyfilter import KeyFilter, key_filter

MIN_WORDS, SHARE, HOSTS, WIDTH = 10, 0.5, 3, 5
#: A sentence has at least this many words before its full stop.
SENTENCE_WORDS = 5
#: This many short entries in one line, outside sentences, are a list of tags; table rows have fewer cells.
TAG_ENTRIES, TAG_WORDS = 10, 6
#: A pair of words is a keyword of its page if it occurs so often, closer together than whole sentences, and has
#: this share of the page's words.
KEYWORD_COUNT, KEYWORD_NEAR, KEYWORD_SHARE = 4, 12, 0.04

_LINK = re.compile(r"(?:https?:)?//[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:[a-z]{2,10})\b(?=[/\s]|$)", re.I)
_TAG = re.compile(r"(?<!\w)#[^\W\d_]\w*")
_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"</?(?:a|p|br|div|span|li|ul|ol|b|i|em|strong|h\d|td|tr|table)\b[^>]*>", re.I)
_STOP = re.compile(r"[.!?؟。]+[\"')\]»”]*(?=\s|$)")
_ITEMS = re.compile(r"[,،;؛|•·●▪#/]|\s[-–—*]\s|^\s*(?:[-–—*•·▪●]|\d+[.)]|\[[ xX]?\])\s+|:\s")
_HREF = re.compile(r"<a\s[^>]*href\s*=[^>]*>(.*?)</a>", re.I | re.S)


@lru_cache(maxsize=1)
def _edge_tables() -> tuple[np.ndarray, np.ndarray]:
    """Characters that may be full stops, and those that may follow one."""
    return V.char_table(".!?؟。"), V.space_table() | V.char_table("<\"')]»”")


def outside_sentences(codes: np.ndarray, offsets: np.ndarray):
    """(words, words in sentences) of each text, and of each word its hash, text and whether it is in a sentence;
    markup and line ends close a stretch, full stops a sentence."""
    texts = len(offsets) - 1
    hashes, docs, starts, _ = V.words(codes, offsets)
    words = np.bincount(docs, minlength=texts)
    n = len(codes)
    stops, closing = _edge_tables()
    full = V.look_up(stops, codes)
    at = np.flatnonzero(full)
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    full[at] = last[at + 1] | V.look_up(closing, codes[np.minimum(at + 1, n - 1)])
    edge = full | (codes == 10) | (codes == 60)
    edge[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(edge)
    if not len(starts) or not len(ends):
        return words, np.zeros(texts, np.int64), hashes, docs, np.zeros(len(starts), bool)
    # words from one end to the next
    until = np.searchsorted(starts, ends, side="right")
    size = np.diff(until, prepend=0)
    begin = np.r_[0, ends[:-1] + 1]
    good = full[ends] & (size >= SENTENCE_WORDS) & (V.counts_in((codes == 47) | (codes == 35), begin, ends + 1) < 2)
    in_sentence = np.repeat(good, size)
    return words, np.bincount(docs, weights=in_sentence, minlength=texts).astype(np.int64), hashes, docs, in_sentence


def keyword_cover(hashes: np.ndarray, docs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Flags the words of a slice that stand under a keyword of their page; ``words`` counts the words of each page."""
    covered = np.zeros(len(hashes), bool)
    pairs, at = V.ngrams(hashes, docs, 2)
    if not len(at):
        return covered
    keys = V.mix(pairs + V.mix(V.spread(docs[at])))  # equal pairs of one page have equal keys
    # only keys that come again so often so near can be keywords; the pairs of one page stand in a row
    again = np.zeros(len(keys), bool)
    for far in range(1, min(KEYWORD_NEAR + 1, len(keys))):
        again[far:] |= keys[far:] == keys[:-far]
    often, close = np.unique(keys[again], return_counts=True)
    some = np.flatnonzero(V.is_in(keys, often[close >= KEYWORD_COUNT - 1]))
    if not len(some):
        return covered
    keys, at = keys[some], at[some]
    order = np.argsort(keys, kind="stable")
    keys, place = keys[order], at[order]
    again = np.r_[False, keys[1:] == keys[:-1]]
    near = again & (np.diff(place, prepend=0) <= KEYWORD_NEAR)
    group = np.cumsum(~again) - 1
    n, close = np.bincount(group), np.bincount(group, weights=near)
    owner = docs[place[~again]]
    keyword = (close >= KEYWORD_COUNT - 1) & (2 * n >= KEYWORD_SHARE * words[owner])
    hit = place[keyword[group]]
    covered[hit] = covered[hit + 1] = True
    return covered


def without_markup(text: str) -> str:
    """The text with a link's label and address on a line of their own, and line ends for other markup."""
    if "<" not in text:
        return text
    text = _HREF.sub(lambda m: f" \n{m[1]} {' '.join(_LINK.findall(m[0])) or 'http://link'}\n ", text)
    return _MARKUP.sub("\n", text)


@lru_cache(maxsize=100_000)
def _entry(text: str) -> tuple[str, int]:
    """The words of an entry of a list, and how many they are."""
    words = _WORD.findall(text)
    return " ".join(words), len(words)


def page_evidence(text: str) -> tuple[int, int, list[tuple[str, bool]]]:
    """(words, words of lists, stretches) of one page.

    Words of lists stand in lines of links, in tags, in phrases repeated outside sentences or under keywords of the
    page; stretches are its words in their order, with whether a replicated phrase may count them: not if they are
    in sentences or are counted already.
    """
    total = listed = 0
    stretches: list[tuple[str, bool]] = []  # text and whether it is outside sentences
    for line in without_markup(text).split("\n"):
        words = _WORD.findall(line.lower())
        if not words:
            continue
        total += len(words)
        in_links = sum(len(_WORD.findall(x)) for x in _LINK.findall(line)) if "." in line or "//" in line else 0
        tags = _TAG.findall(line) if "#" in line else []
        if in_links * 3 >= len(words) or tags and 2 * len(tags) >= len(words):
            listed += len(words)
            stretches.append((line, False))
            continue
        last = begin = 0
        for stop in _STOP.finditer(line):
            if len(_WORD.findall(line[begin : stop.end()])) >= SENTENCE_WORDS:
                stretches += [(line[last:begin], True), (line[begin : stop.end()], None)]
                last = stop.end()
            begin = stop.end()
        stretches.append((line[last:], True))
    parts = [(_WORD.findall(x.lower()), [_entry(y) for y in map(str.strip, _ITEMS.split(x.strip().lower())) if y] if loose else [], loose) for x, loose in stretches if x.strip()]
    items = Counter(x for _, y, _ in parts for x, _ in y)
    pairs = Counter(p for words, _, loose in parts if loose for p in zip(words, words[1:]))
    everywhere = " ".join(" ".join(words) for words, _, _ in parts)
    hashes, docs, _, _ = V.words(*V.code_points(pa.array([everywhere])))
    stuffed = keyword_cover(hashes, docs, np.array([len(hashes)]))
    out, begin = [], 0
    for words, entries, loose in parts:
        inside = stuffed[begin : begin + len(words)]
        begin += len(words)
        if loose is False:  # links and tags are counted
            out.append((" ".join(words), False))
            continue
        if loose is None:
            listed += int(inside.sum())
            out.append((" ".join(words), False))
            continue
        if len(entries) >= TAG_ENTRIES and len(words) <= TAG_WORDS * len(entries):
            listed += len(words)
            out.append((" ".join(words), False))
            continue
        repeated = sum(n for x, n in entries if n <= 8 and items[x] >= 3)
        covered = inside.copy()
        for i, p in enumerate(zip(words, words[1:])):
            if pairs[p] >= 4:
                covered[i : i + 2] = True
        found = max(repeated, int(covered.sum()))
        # entries that differ, with a few repeats by chance, are an ordinary list
        if found * 2 > len(words):
            listed += len(words) if found * 10 >= 6 * len(words) else found
            out.append((" ".join(words), False))
        else:
            out.append((" ".join(words), True))
    return total, listed, out


def _evidence(batches):
    for batch in batches:
        for a, b in V.slices(batch.column(1)):
            part = batch.column(1)[a:b]
            codes, offsets = V.code_points(part)
            words, inside, hashes, docs, in_sentence = outside_sentences(codes, offsets)
            stuffed = np.bincount(docs, weights=keyword_cover(hashes, docs, words) & in_sentence, minlength=b - a)
            at = np.flatnonzero((words >= MIN_WORDS) & (2 * (words - inside + stuffed) > words))
            if not len(at):
                continue
            found = [page_evidence(t) for t in part.take(pa.array(at)).to_pylist()]
            rows = pa.array(at + a)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(2).take(rows), batch.column(3).take(rows),
                    pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()),
                    pa.array([[t for t, _ in x[2]] for x in found], pa.list_(pa.string())), pa.array([[may for _, may in x[2]] for x in found], pa.list_(pa.bool_())),
                ],
                ["doc_id", "host", "page", "words", "listed", "stretches", "open"],
            )


def _rows(docs: DataFrame, doc_id: str, column: str, host: str) -> DataFrame:
    """(doc_id, text, host, page) of the documents with a text."""
    rows = docs.where(F.col(column).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(column).cast("string").alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    return rows.withColumn("page", F.xxhash64("text"))


def page_lists(docs: DataFrame, doc_id: str = "doc_id", column: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, page, words, listed, stretches, open): list density of the pages that may be spam; page is a
    hash of the text, by which copies of one page count once among the hosts of a phrase."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return _rows(docs, doc_id, column, host).mapInArrow(_evidence, f"doc_id {kind}, host string, page bigint, words int, listed int, stretches array<string>, open array<boolean>")


def _page_phrases(batches):
    """The shingles of each page: ``at`` is the place of the first word, ``before`` and ``after`` count the words
    that may be counted before it and before the shingle's end."""
    for batch in batches:
        parts = batch.column(1)
        owner, texts, may = np.asarray(pc.list_parent_indices(parts), np.int64), pc.list_flatten(parts), pc.list_flatten(batch.column(2))
        # a slice ends with a page, so that no shingle is lost between two
        whole = pc.binary_join(parts, " ")
        for a, b in V.slices(whole):
            here = (owner >= a) & (owner < b)
            hashes, docs, _, _ = V.words(*V.code_points(whole[a:b]))
            sizes = np.bincount(V.words(*V.code_points(texts.filter(pa.array(here))))[1], minlength=int(here.sum()))
            counted = np.r_[0, np.cumsum(np.repeat(np.asarray(may.filter(pa.array(here))), sizes))]
            grams, at = V.ngrams(hashes, docs, WIDTH)
            rows = pa.array(docs[at] + a)
            place = at - np.searchsorted(docs, docs[at])
            columns = [place, counted[at], counted[at + WIDTH], grams.view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(pa.array(x.astype(np.int64)) for x in columns)], ["page", "at", "before", "after", "phrase"])


def carried_phrases(rows: DataFrame, wanted: KeyFilter, hosts: int = HOSTS) -> DataFrame:
    """(phrase, host, page): the shingles of all texts that the filter lets through; hosts and pages are hashes.

    Of each phrase a slice gives the rows of ``hosts`` different hosts and of as many different pages, where it has
    so many: enough to tell whether the phrase has them, so nothing is lost and no phrase grows with its slice.
    """

    def first_of(phrase: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Rows that bring the first ``hosts`` different values of ``other`` of their phrase."""
        order = np.lexsort((other, phrase))
        p, o = phrase[order], other[order]
        new = np.r_[True, p[1:] != p[:-1]]
        fresh = new | np.r_[True, o[1:] != o[:-1]]
        rank = np.cumsum(fresh)
        return order[fresh & (rank - rank[np.flatnonzero(new)][np.cumsum(new) - 1] < hosts)]

    def run(batches):
        for batch in batches:
            of_host, of_page = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for a, b in V.slices(batch.column(0)):
                part = batch.column(0)[a:b]
                if pc.any(pc.match_substring(part, "<")).as_py():
                    part = pa.array([without_markup(t) for t in part.to_pylist()], pa.string())
                hashes, texts, _, _ = V.words(*V.code_points(part))
                grams, at = V.ngrams(hashes, texts, WIDTH)
                keep = wanted.maybe(grams.view(np.int64))
                grams, owner = grams[keep], texts[at[keep]] + a
                if not len(grams):
                    continue
                found = np.unique(np.concatenate([first_of(grams, of_host[owner]), first_of(grams, of_page[owner])]))
                of = pa.array(owner[found])
                yield pa.RecordBatch.from_arrays([pa.array(grams[found].view(np.int64)), batch.column(1).take(of), batch.column(2).take(of)], ["phrase", "host", "page"])

    return rows.select("text", F.xxhash64("host").alias("host"), "page").mapInArrow(run, "phrase bigint, host bigint, page bigint")


def spam_pages(docs: DataFrame, doc_id: str = "doc_id", column: str = "text", host: str = "source", hosts: int = HOSTS, share: float = SHARE) -> DataFrame:
    """(doc_id, words, listed, replicated, carried, spam_share): pages of at least ten words of which more than
    ``share`` stand in link lists, tag lists or repeated keywords, or in phrases that at least ``hosts`` hosts carry.

    ``replicated`` counts the words that only such phrases account for, ``carried`` all words under them.  A phrase
    counts its hosts over distinct texts, so a page copied whole to other hosts does not vouch for itself.  Null
    texts are no pages; a null host is one host of its own; rows repeated under one id count once.
    """
    pages = written(page_lists(docs, doc_id, column, host).distinct(), "page-lists")
    # one row a text: copies share their phrases
    texts = pages.groupBy("page").agg(F.first("words").alias("words"), F.first("listed").alias("listed"), F.first("stretches").alias("stretches"), F.first("open").alias("open"))
    phrases = written(texts.select("page", "stretches", "open").mapInArrow(_page_phrases, "page bigint, at bigint, before bigint, after bigint, phrase bigint"), "phrases")
    asked = written(phrases.select("phrase").distinct(), "asked-phrases")
    everywhere = carried_phrases(_rows(docs, doc_id, column, host), key_filter(asked, "phrase", asked.count()), hosts)
    everywhere = everywhere.join(asked, "phrase", "left_semi")
    carried = everywhere.groupBy("phrase", "host", "page").agg(F.lit(1).alias("one")).groupBy("phrase").agg(F.countDistinct("host").alias("hosts"), F.countDistinct("page").alias("pages"))
    carried = carried.where(f"hosts >= {hosts} AND pages >= {hosts}").select("phrase")
    # a shingle covers the words that the one before it has not covered
    ordered = Window.partitionBy("page").orderBy("at")
    reach = F.lag(F.col("at") + WIDTH).over(ordered)
    weighed = phrases.join(carried, "phrase", "left_semi").select(
        "page",
        (F.col("after") - F.greatest("before", F.coalesce(F.lag("after").over(ordered), F.lit(0)))).alias("new"),
        (F.col("at") + WIDTH - F.greatest("at", F.coalesce(reach, F.lit(0)))).alias("under"),
    )
    weighed = weighed.groupBy("page").agg(F.sum("new").cast("int").alias("replicated"), F.sum("under").cast("int").alias("carried"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    out = pages.select("doc_id", "page", "words", "listed").join(weighed, "page", "left").select("doc_id", "words", "listed", zero("replicated"), zero("carried"))
    out = out.where(F.col("listed") + F.col("replicated") > share * F.col("words"))
    out = out.groupBy("doc_id").agg(*(F.max(x).alias(x) for x in ("words", "listed", "replicated", "carried")))
    return out.withColumn("spam_share", F.round((F.col("listed") + F.col("replicated")) / F.col("words"), 4)).withColumnRenamed("doc_id", doc_id)
