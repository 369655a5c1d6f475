"""Noise in text from scanned pages (problem 2).

Two averaged perceptrons are trained here, on bounded samples of the pages themselves.

*Furniture* (running titles, page numbers, copyright and date stamps): a line classifier over shape and
page-position features.  Its labels are those lines of a sample that recur, digits aside, on several pages of
their source at one place; it then judges every line, wherever it stands.

*Characters*: an editor that predicts for each character of a word whether to keep, delete or replace it, by one
or two characters (insertion), and for a hyphen at a line end whether to join with or without it.  It learns from
frequent words of the corpus to which the misreadings of printed text were applied, each at each place.  How far it
must prefer an edit is settled on the noise of words that were held out from it.

Words are counted over all prose pages by Spark.  A rare word is set against all frequent words of the same
*skeleton* (the form in which characters that are mistaken for each other are equal), a join within Spark.  The
editor walks from the one to the other by the fixed misreadings and says what that gains; it turns down what it
would rather keep, and of several words it would accept the best one holds.  The vocabulary only confirms: a word is
mended to a much more frequent one or not at all.  For a broken word the editor's preference for joining with or
without the hyphen is weighed against the counts of the two words.

The findings go back to their pages: furniture is dropped, misread words are replaced, broken words are joined, and
the lines of a paragraph become one line.  Whether a line end closes a paragraph follows from blank lines, the
width of the page, full stops and the kinds of the two lines.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import vectext as V
from .quality_stats import Lines, _function_words, page_kinds, read_lines

# --- fixed values: what scanners read, and what was printed -------------------------------------------
MISREAD = (
    ("c", "e"), ("f", "t"), ("l", "i"), ("b", "h"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"),
    ("8", "b"), ("9", "g"), ("@", "a"), ("!", "i"), ("|", "l"), ("$", "s"), ("€", "e"), ("rn", "m"), ("cl", "d"), ("ii", "u"),
    ("ri", "n"), ("vv", "w"), ("m", "in"), ("h", "li"), ("li", "h"), ("d", "cl"), ("m", "rn"), ("e", "c"), ("t", "f"), ("i", "l"), ("h", "b"),
)
HYPHENS = "-‐‑­¬"
# --- end of fixed values ------------------------------------------------------------------------------

#: A word is a misreading only of a word at least so many times as frequent, and that often at least.
RATIO, LEAST = 12, 8
TRAIN_PAGES, TRAIN_WORDS, EPOCHS = 2500, 1500, 3
#: What a factor of e in the counts of two words weighs against the editor's margin.
COUNT_WEIGHT = 3.0
_HASH = 1 << 15
_SYMBOLS = "@!|$€"


def skeleton(word: Column) -> Column:
    """The form of a word in which characters that scanners mistake for each other are equal: each letter is
    written as the strokes it may fall into."""
    out = F.translate(word, "cf01!|5$9@€lr", "etoiiissgaeii")
    for letter, strokes in (("m", "iii"), ("n", "ii"), ("u", "ii"), ("h", "ii"), ("b", "ii"), ("6", "ii"), ("8", "ii"), ("d", "ei"), ("w", "vv")):
        out = F.replace(out, F.lit(letter), F.lit(strokes))
    return out


# ---------------------------------------------------------------------------------------- perceptrons


@dataclass
class Perceptron:
    """Averaged multi-class perceptron over hashed features; trained in mini-batches, used on whole arrays."""

    labels: list[str]
    weights: np.ndarray = field(default=None)  # (_HASH, labels)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(rows, labels) scores of rows of feature numbers."""
        out = np.zeros((len(features), len(self.labels)), np.float32)
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    @classmethod
    def train(cls, labels: list[str], features: np.ndarray, gold: np.ndarray, allowed: np.ndarray | None = None, epochs: int = EPOCHS, batch: int = 256) -> Perceptron:
        """Fits the weights and averages them over all updates."""
        now, total = np.zeros((_HASH, len(labels)), np.float32), np.zeros((_HASH, len(labels)), np.float32)
        model, steps, order = cls(labels, now), 0, np.random.default_rng(7)
        for _ in range(epochs):
            for rows in np.array_split(order.permutation(len(gold)), max(1, len(gold) // batch)):
                s = model.scores(features[rows])
                if allowed is not None:
                    s = np.where(allowed[rows], s, -np.inf)
                guess = s.argmax(axis=1)
                wrong = guess != gold[rows]
                f, g, b = features[rows[wrong]], gold[rows[wrong]], guess[wrong]
                for k in range(features.shape[1]):
                    np.add.at(now, (f[:, k], g), 1.0)
                    np.add.at(now, (f[:, k], b), -1.0)
                steps += 1
                if steps % 4 == 0:
                    total += now
        return cls(labels, total / max(1, steps // 4))


def _hashed(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(0)
    for p in parts:
        out = V.mix(np.asarray(p).astype(np.uint64) + out * np.uint64(31) + np.uint64(17))
    return (out & np.uint64(_HASH - 1)).astype(np.int64)


# ------------------------------------------------------------------------------------- character editor

_JOIN = "\n"


def _actions() -> list[str]:
    """Edit of one character: what stands for it afterwards.  'keep' keeps it, '' deletes it."""
    out = ["keep", "", "-"]
    for seen, meant in MISREAD:
        for a in ((meant,) if len(seen) == 1 else (meant,)):
            if a not in out:
                out.append(a)
    return out


def _aligned(seen: str, meant: str) -> list[str]:
    """Actions that turn one misreading into what was printed: the first character changes, the rest go."""
    return [meant, *[""] * (len(seen) - 1)]


def _char_features(codes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Feature numbers of each character: neighbours to both sides, pairs and triples of them."""
    n = len(codes)
    codes = codes.astype(np.int64)

    def at(shift: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if shift >= 0:
            out[: n - shift] = np.where(word[shift:] == word[: n - shift], codes[shift:], 0)
        else:
            out[-shift:] = np.where(word[:shift] == word[-shift:], codes[:shift], 0)
        return out

    l3, l2, l1, c, r1, r2, r3 = (at(k) for k in range(-3, 4))
    return np.stack(
        [_hashed(1, c), _hashed(2, c, l1), _hashed(3, c, r1), _hashed(4, c, l1, r1), _hashed(5, c, l2, l1), _hashed(6, c, r1, r2), _hashed(7, l2, l1, c, r1), _hashed(8, l1, c, r1, r2), _hashed(9, l3, l2, l1, c), _hashed(10, c, r1, r2, r3), _hashed(11, l2, l1, c, r1, r2)],
        axis=1,
    )


def _spread(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets = V.code_points(pa.array(words, pa.string()))
    return codes, np.repeat(np.arange(len(words)), np.diff(offsets))


@dataclass
class Editor:
    """The trained perceptron, the margin from which an edit is accepted, and the unit of its join preference."""

    model: Perceptron
    threshold: float = 0.0
    join_unit: float = 1.0


def misreadings(word: str) -> list[tuple[int, str, str]]:
    """(place, seen, meant): every single misreading of a word."""
    return [(k, seen, meant) for seen, meant in MISREAD for k in range(len(word)) if word.startswith(meant, k)]


def _noisy(word: str, at: dict[int, tuple[str, str]], cut: int, keep_hyphen: bool) -> tuple[str, list[str]]:
    """A word misread at some places and broken before ``cut`` (0: not), with the action of each character."""
    out, actions, i = [], [], 0
    while i < len(word):
        if i == cut and cut and word[i - 1] != "-" and word[i] != "-":
            out.append(_JOIN)
            actions.append("")
        if word[i] == "-" and keep_hyphen:
            out.append(_JOIN)
            actions.append("-")
            i += 1
        elif i in at:
            seen, meant = at[i]
            out.extend(seen)
            actions += _aligned(seen, meant)
            i += len(meant)
        else:
            out.append(word[i])
            actions.append("keep")
            i += 1
    return "".join(out), actions


def _fit_editor(words: list[str]) -> Perceptron:
    """Fits the editor: each word as it is, with each single misreading, with two, and broken over two lines."""
    labels = _actions()
    index = {a: i for i, a in enumerate(labels)}
    rng = np.random.default_rng(11)
    noisy, gold = [], []
    for word in words:
        ops = misreadings(word)
        made = [({}, 0, False)] * 3 + [({k: (seen, meant)}, 0, False) for k, seen, meant in ops]
        for _ in range(len(ops) // 3):
            made.append(({ops[k][0]: ops[k][1:] for k in rng.integers(0, len(ops), 2)}, 0, False))
        if len(word) > 4:
            made += [({}, int(rng.integers(2, len(word) - 1)), rng.random() < 0.5) for _ in range(3)]
        for at, cut, keep_hyphen in made:
            seen, actions = _noisy(word, at, cut, keep_hyphen)
            noisy.append(seen)
            gold += [index[a] for a in actions]
    if not noisy:
        return Perceptron(labels, np.zeros((_HASH, len(labels)), np.float32))
    codes, word = _spread(noisy)
    return Perceptron.train(labels, _char_features(codes, word), np.array(gold), batch=1024)


def train_editor(words: list[tuple[str, int]], size: int = TRAIN_WORDS) -> Editor:
    """Trains the editor on the given frequent words; a fifth of them is held out first, to settle its threshold.

    The threshold is the margin that parts best the single misreadings of the held-out words, to be mended, from
    the edits that would take the held-out words themselves for misreadings.
    """
    chosen = [w for w, _ in words[:size]]
    held = [w for i, w in enumerate(chosen) if i % 5 == 4]
    first = _fit_editor([w for i, w in enumerate(chosen) if i % 5 != 4])
    misread = [(w[:k] + seen + w[k + len(meant) :], w) for w in held for k, seen, meant in misreadings(w)]
    intact = [(w, w[:k] + meant + w[k + len(seen) :]) for w in held for seen, meant in MISREAD for k in range(len(w)) if w.startswith(seen, k)]
    threshold = _parting(*(edit_margin(first, [a for a, _ in x], [b for _, b in x]) for x in (misread, intact)))
    unit = float(np.median(np.abs(join_preference(first, [(w[: len(w) // 2], w[len(w) // 2 :]) for w in held if len(w) > 5])))) if any(len(w) > 5 for w in held) else 1.0
    return Editor(_fit_editor(chosen), threshold, unit or 1.0)


def _parting(high: np.ndarray, low: np.ndarray) -> float:
    """The value with the largest share of ``high`` at or above it less that of ``low``; the smallest of equals."""
    if not len(high):
        return 0.0
    at = np.sort(high)
    share = 1 - np.arange(len(at)) / len(at)
    return float(at[int(np.argmax(share - (1 - np.searchsorted(np.sort(low), at) / max(1, len(low)))))])


def edit_margin(model: Perceptron, seen: list[str], meant: list[str]) -> np.ndarray:
    """What the editor gains by turning each word into the other instead of keeping it; -inf where the fixed
    misreadings do not lead from the one to the other."""
    codes, word = _spread(seen)
    out = np.full(len(seen), -np.inf)
    if not len(codes):
        return out
    scores = model.scores(_char_features(codes, word))
    gain = scores - scores[:, :1]
    first = np.searchsorted(word, np.arange(len(seen)))
    index = {a: k for k, a in enumerate(model.labels)}
    for w, (a, b) in enumerate(zip(seen, meant)):
        best: list[dict[int, float]] = [{} for _ in range(len(a) + 1)]  # characters read -> characters made -> gain
        best[0][0] = 0.0
        for i in range(len(a)):
            for made, value in best[i].items():
                if b[made : made + 1] == a[i]:
                    best[i + 1][made + 1] = max(value, best[i + 1].get(made + 1, -np.inf))
                for wrong, right in _BY_FIRST.get(a[i], ()):
                    if b.startswith(right, made) and a.startswith(wrong, i):
                        row = first[w] + i
                        v = value + float(gain[row, index[right]]) + float(gain[row + 1 : row + len(wrong), index[""]].sum())
                        to = best[i + len(wrong)]
                        to[made + len(right)] = max(v, to.get(made + len(right), -np.inf))
        out[w] = best[-1].get(len(b), -np.inf)
    return out


_BY_FIRST = {c: tuple(x for x in MISREAD if x[0][0] == c) for c in {x[0][0] for x in MISREAD}}


def join_preference(model: Perceptron, parts: list[tuple[str, str]]) -> np.ndarray:
    """How far the editor prefers keeping the hyphen over dropping it when it joins the parts of each broken word."""
    codes, word = _spread([f"{a}{_JOIN}{b}" for a, b in parts])
    if not len(codes):
        return np.zeros(0)
    scores = model.scores(_char_features(codes, word))[codes == 10]
    return (scores[:, model.labels.index("-")] - scores[:, model.labels.index("")]).astype(float)


# ------------------------------------------------------------------------------------- page furniture

_PAGE_NO = re.compile(r"[\W_]*(?:(?:page|p|pp|seite|s|pagina|página|صفحة)\b\.?)?\s*\d{1,4}(?:\s*(?:of|von|de|sur|من|/)\s*\d{1,4})?[\W_]*", re.I)
_ROMAN = re.compile(r"[\W_]*[ivxlc]{1,8}[\W_]*", re.I)
_STAMP = re.compile(r"\d{4}-\d\d(?:-\d\d)?|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b")
_HEADER = re.compile(r"[A-Z](?: ?[A-Z]){1,4} \d{3,6}:\d{4}\b")
_RIGHTS = re.compile(r"[©®]|\(c\)\s|copyright|rights reserved|alle rechte|tous droits|derechos reservados|جميع الحقوق", re.I)
_SECTION = re.compile(r"\d{1,2}\.\d{1,2}\b")
_CAPTION = re.compile(r"(?:table|figure|tabelle|tableau|tabla|abbildung|fig\.?|جدول|شكل)\s+\d", re.I)


_NO_LETTER = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=100_000)
def _letters(text: str) -> str:
    return _NO_LETTER.sub("", text.lower() if text.isascii() else unicodedata.normalize("NFKD", text.lower()))


@lru_cache(maxsize=20_000)
def _title_grams(source: str | None) -> frozenset:
    name = _letters(re.sub(r"\.\w{2,5}$", "", source or ""))
    return frozenset(name[i : i + 3] for i in range(len(name) - 2))


@lru_cache(maxsize=1000)
def _roman(number: int | None) -> str:
    """A page number in small Roman figures; the empty text for none above 399."""
    out = ""
    if number is None or not 0 < number < 400:
        return out
    for value, figure in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += figure * (number // value)
        number %= value
    return out


def _is_page_number(line: str, page: int | None, beside: tuple[str, ...], source: str | None) -> bool:
    """Whether a line gives the number of its page, or of the next beside a running title."""
    if line.lower().strip("-–[]() .") == _roman(page) != "":
        return True
    digits = re.findall(r"\d+", line)
    if page is None or not digits or not _PAGE_NO.fullmatch(line):
        return False
    by_title = any(_title_likeness(x, source)[1] >= 0.6 or _HEADER.match(x) for x in beside)
    return str(page) in digits or by_title and str(page + 1) in digits


@lru_cache(maxsize=100_000)
def _title_likeness(line: str, source: str | None) -> tuple[float, float]:
    """Shares of the letter triples of a line and of the name of its source that the two have in common."""
    title, letters = _title_grams(source), _letters(line)
    grams = {letters[i : i + 3] for i in range(len(letters) - 2)}
    if not title or not grams:
        return 0.0, 0.0
    return len(grams & title) / min(len(title), len(grams)), len(grams & title) / len(title)


def furniture_features(line: str, source: str | None, page: int | None, top: int, bottom: int, words: int, function_words: int, full_stop: bool, beside: tuple[str, ...]) -> list[int]:
    """Feature numbers of one line; ``beside`` has the lines before and after it."""
    alike, covers = _title_likeness(line, source)
    digits = re.findall(r"\d+", line)
    number = bool(digits) and bool(_PAGE_NO.fullmatch(line))
    same = page is not None and any(str(page + k) in digits for k in (0, 1)) or _is_page_number(line, page, beside, source)
    by_title = number and any(_title_likeness(x, source)[1] >= 0.6 or _HEADER.match(x) for x in beside)
    edge = min(top, bottom, 3)
    rights, roman = bool(_RIGHTS.search(line)), bool(_ROMAN.fullmatch(line))
    head, dated, section, caption = (bool(x(line)) for x in (_HEADER.match, _STAMP.search, _SECTION.match, _CAPTION.match)) if digits else (False,) * 4
    kind = (number, head, rights, dated, roman, int(alike * 4), int(covers * 4))
    values = [
        (1, int(alike * 5), int(covers * 5)), (2, number, same), (3, head), (4, rights, words > 12), (5, dated, words <= 3), (6, roman, edge == 0), (7, edge), (8, section, caption),
        (9, full_stop, function_words > 1), (10, min(words, 12)), (11, kind), (12, edge, number, alike >= 0.6), (13, same, alike >= 0.6), (16, by_title, same), (17, by_title, edge), (14, function_words > 0, alike >= 0.8, covers >= 0.8), (15,),
    ]
    return [_stable(v) for v in values]


@lru_cache(maxsize=100_000)
def _stable(value: tuple) -> int:
    from zlib import crc32

    return crc32(repr(value).encode()) & (_HASH - 1)


def _beside(lines: Lines, i: int) -> tuple[str, ...]:
    """The lines before and after a short line with a digit, where they are short and on the same page."""
    if not lines.chars[i, 6] or lines.words[i] > 4:
        return ()
    return tuple(lines.text(j) for j in (i - 1, i + 1) if 0 <= j < len(lines.starts) and lines.pages[j] == lines.pages[i] and lines.ends[j] - lines.starts[j] <= 70)


def _short_lines(lines: Lines, kinds: np.ndarray) -> np.ndarray:
    """Lines that may be furniture: not on an unreadable page, with a digit, a sign or two capitals, or of a few
    characters; entries of lists and contents and sentences are none.  A long line inside the page, of whole words
    and without a sign such as a copyright mark, is text; at its edges, letter-spaced or with a sign, lines of any
    length are judged."""
    size = lines.ends - lines.starts
    shape = (size <= 10) | (lines.chars[:, 2] >= 2) | (lines.chars[:, 3] + lines.chars[:, 2] >= 2) | (lines.chars[:, 11] > 0) | (lines.chars[:, 6] > 0) & (lines.words <= 6)
    spaced = lines.word_chars < 3 * lines.words
    marked = (lines.chars[:, 11] > 0) | spaced | (np.minimum(lines.from_top, lines.from_bottom) == 0)
    shape &= ((lines.words <= 12) & (size <= 80) & (lines.function_words <= 3) | marked & (4 * lines.function_words <= lines.words)) & ~(lines.full_stop & (lines.words > 5))
    shape &= (lines.kinds != 2) & ((lines.kinds != 1) | (size <= 12) | (lines.chars[:, 10] == 0) & ((lines.chars[:, 11] > 0) | (np.minimum(lines.from_top, lines.from_bottom) <= 3) & (lines.chars[:, 2] >= 2))) & ((lines.kinds != 3) | (lines.chars[:, 6] <= 4) & (lines.chars[:, 10] <= 1) & (lines.words <= 8))
    shape &= (lines.function_words == 0) | (size <= 60) & (lines.words - lines.function_words <= 6) | marked
    return np.flatnonzero(shape & (kinds[lines.pages] != 4))


def _kinds(lines: Lines, n: int) -> np.ndarray:
    counts, whole = page_kinds(lines, n)
    structured = counts[:, 1:].sum(axis=1)
    return np.where(2 * structured > whole, 1 + counts[:, 1:].argmax(axis=1), 0)


def _comparable(line: str) -> str:
    return re.sub(r"\d+", "#", re.sub(r"\s+", " ", line.lower()))


def _sampled(pages: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` pages: sources by a hash of their name, of a large source an eighth of the sample.

    Sizes of sources decide thresholds beforehand, so few more rows than wanted ever leave the tasks.
    """
    share = max(1, rows // 8)
    sizes = pages.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.least(F.col("n"), F.lit(share)))
    total = sizes.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("t")).first()["t"]
    part = min(1.0, 1.5 * rows / max(1, total))
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = sizes.where(unit("source") <= part).select("source", (F.col("kept") / F.col("n")).alias("share"))
    out = pages.join(chosen, "source").where(unit("source", "page", "text") <= F.col("share"))
    return out.select("source", "page", "text").orderBy(F.xxhash64("source"), F.xxhash64("source", "page", "text")).limit(rows)


def train_furniture(pages: DataFrame, common: np.ndarray, rows: int = TRAIN_PAGES) -> Perceptron:
    """Fits the line classifier on at most ``rows`` pages, whole sources of them chosen by a hash of the source.

    A line is labelled furniture if its comparable form recurs on a tenth of its source's sampled pages, on two at
    least, and says so by its place or shape; a line is labelled text if it is on no other page and not short.
    """
    table = _sampled(pages.where("text IS NOT NULL AND source IS NOT NULL").select("source", "page", "text"), rows).toArrow()
    texts, sources, numbers = table.column(2).combine_chunks(), table.column(0).to_pylist(), table.column(1).to_pylist()
    found: dict[tuple, set] = {}
    seen_pages: dict[str, set] = {}
    kept = []
    for a, b in V.slices(texts):
        lines = read_lines(texts[a:b], common)
        kinds = _kinds(lines, b - a)
        short = _short_lines(lines, kinds)
        # as many ordinary lines, so that the classifier knows text even where all short lines are furniture
        plain = np.setdiff1d(np.flatnonzero((lines.function_words > 0) & (kinds[lines.pages] != 4)), short)
        plain = plain[:: max(1, len(plain) // max(1, len(short)))]
        for i in np.union1d(short, plain):
            p = a + int(lines.pages[i])
            line = lines.text(i)
            key = (sources[p], _comparable(line))
            found.setdefault(key, set()).add(numbers[p])
            seen_pages.setdefault(sources[p], set()).add(numbers[p])
            kept.append((key, line, p, int(lines.from_top[i]), int(lines.from_bottom[i]), int(lines.words[i]), int(lines.function_words[i]), bool(lines.full_stop[i]), _beside(lines, i), int(lines.kinds[i])))
    features, gold = [], []
    for key, line, p, top, bottom, words, function_words, full_stop, beside, kind in kept:
        n, of = len(found[key]), len(seen_pages[sources[p]])
        edge = min(top, bottom)
        titled = _title_likeness(line, sources[p])[1] >= 0.5
        counted = _is_page_number(line, numbers[p], beside, sources[p]) and kind != 3
        shaped = titled or counted or bool(_PAGE_NO.fullmatch(line) or _RIGHTS.search(line) or _HEADER.match(line))
        recurs = n >= max(2, 0.1 * of) and edge <= 2 or _RIGHTS.search(line) and words <= 8 or counted and (edge <= 2 or beside)
        if recurs and function_words <= 2 and not _SECTION.match(line) and not _CAPTION.match(line) and not (full_stop and not titled) and (kind != 3 or titled):
            label = 1
        elif not shaped and (n == 1 or full_stop or function_words > 2 or kind == 3 or _SECTION.match(line) or _CAPTION.match(line)):
            label = 0
        else:
            continue
        features.append(furniture_features(line, sources[p], numbers[p], top, bottom, words, function_words, full_stop, beside))
        gold.append(label)
    if len(set(gold)) < 2:
        return Perceptron(["text", "furniture"], np.zeros((_HASH, 2), np.float32))
    return Perceptron.train(["text", "furniture"], np.array(features), np.array(gold), epochs=20, batch=64)


def furniture_lines(model: Perceptron, lines: Lines, kinds: np.ndarray, sources: list, numbers: list) -> np.ndarray:
    """Flags the lines of a slice that are furniture."""
    out = np.zeros(len(lines.starts), bool)
    at = _short_lines(lines, kinds)
    if not len(at):
        return out
    rows = [furniture_features(lines.text(i), sources[lines.pages[i]], numbers[lines.pages[i]], int(lines.from_top[i]), int(lines.from_bottom[i]), int(lines.words[i]), int(lines.function_words[i]), bool(lines.full_stop[i]), _beside(lines, i)) for i in at]
    s = model.scores(np.array(rows))
    out[at] = s[:, 1] > s[:, 0]
    return out


# -------------------------------------------------------------------------------------------- pages

_STRIP = "".join(c for c in map(chr, range(0x21, 0x2100)) if unicodedata.category(c)[0] in "PS" and c not in _SYMBOLS + HYPHENS)


@lru_cache(maxsize=1)
def _core_table() -> np.ndarray:
    """Characters with which a word may begin or end."""
    out = V.alnum_table().copy()
    for c in "@!$€|":
        out[ord(c)] = True
    return out


def clean_word(token: str) -> str | None:
    """A stored token in lower case without surrounding punctuation; None for numbers, codes and single letters."""
    if token.isalpha():
        return token.lower() if len(token) > 1 else None
    word = token.strip(_STRIP + HYPHENS).rstrip("!|").lower()
    letters = sum(map(str.isalpha, word))
    if letters < 2 or 2 * letters < len(word) or _THREE_DIGITS.search(word):
        return None
    return word


_THREE_DIGITS = re.compile(r"\d{3}")


@dataclass
class Words:
    """Tokens of the text lines of a slice: hashes of their stored lower-case form, pages, spans; and broken words."""

    hashes: np.ndarray
    pages: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    low: np.ndarray
    broken: list[tuple[int, str, str]]


def page_words(lines: Lines, kinds: np.ndarray, furniture: np.ndarray) -> Words:
    """Words of the prose pages, furniture aside; words broken over two lines are apart from the others."""
    low = V.lower(lines.codes)
    keep = ~furniture & (kinds[lines.pages] == 0) & (lines.kinds != 4)
    at = np.flatnonzero(keep)
    inside = np.zeros(len(low) + 1, np.int64)
    np.add.at(inside, lines.starts[at], 1)
    np.add.at(inside, lines.ends[at], -1)
    in_line = np.cumsum(inside)[:-1] > 0
    space = V.look_up(V.space_table(), low)
    starts, ends, pages = V.runs(in_line & ~space, lines.offsets)
    broken: list[tuple[int, str, str]] = []
    drop = np.zeros(len(starts), bool)
    if len(at) > 1:
        last = lines.codes[lines.ends[at] - 1]
        hyphen = np.isin(last, [ord(c) for c in HYPHENS])
        same = np.r_[lines.pages[at][1:] == lines.pages[at][:-1], False]
        for k in np.flatnonzero(hyphen & same):
            left = np.searchsorted(ends, lines.ends[at[k]])
            right = np.searchsorted(starts, lines.starts[at[k + 1]])
            if left >= len(ends) or right >= len(starts) or ends[left] - starts[left] < 2:
                continue
            a, b = _text(lines.codes, starts[left], ends[left]), _text(lines.codes, starts[right], ends[right])
            a = a.rstrip(HYPHENS)
            if not a or not a[-1].isalpha() or not b[:1].isalpha() and b[:1] not in _SYMBOLS + "01569" or b[:1].isupper() and not a.isupper():
                continue
            broken.append((int(pages[left]), a, b))
            drop[left] = drop[right] = True
    starts, ends, pages = starts[~drop], ends[~drop], pages[~drop]
    # surrounding punctuation
    core = V.look_up(_core_table(), low)
    solid = np.r_[0, np.cumsum(core)]
    some = solid[ends] > solid[starts]
    starts, ends, pages = starts[some], ends[some], pages[some]
    where = np.flatnonzero(core)
    starts, ends = (where[solid[starts]], where[solid[ends] - 1] + 1) if len(starts) else (starts, ends)
    return Words(V.span_hashes(low, starts, ends), pages, starts, ends, low, broken)


def _text(codes: np.ndarray, a: int, b: int) -> str:
    return codes[a:b].tobytes().decode("utf-32-le", "replace")


def _pages(batches, common, model):
    """(batch, first row, lines, kinds, furniture) of each slice; columns are source, page, text and what follows."""
    for batch in batches:
        sources, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in V.slices(batch.column(2)):
            lines = read_lines(batch.column(2)[a:b], common)
            kinds = _kinds(lines, b - a)
            yield batch, a, lines, kinds, furniture_lines(model, lines, kinds, sources[a:b], numbers[a:b])


@dataclass
class PageRepair:
    """What was found in the pages: ``lines`` (source, page, item), ``mended`` (source, page, item) and
    ``misread`` (word, right): each misread word with its right spelling; ``fixes`` (id, a, b, item): for each
    stored page its misread words a and broken words a, b, with what is right; ``texts`` (id, source, page, text,
    ends): the pages to be mended, null where they were not asked for."""

    lines: DataFrame
    mended: DataFrame
    misread: DataFrame
    fixes: DataFrame
    texts: DataFrame | None = None


def _prepared(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("source").cast("string").alias("source"), F.col("page").cast("int").alias("page"), F.col("text").cast("string").alias("text"))


def repair_pages(pages: DataFrame, common_words: DataFrame, train_pages: int = TRAIN_PAGES, train_words: int = TRAIN_WORDS, texts: bool = False) -> PageRepair:
    """Finds furniture lines and words to be mended; with ``texts`` also keeps the pages without their furniture.

    Null and blank texts have neither; a page stored twice gives its findings once; null source or page is kept.
    Nothing is mended on list, table and unreadable pages, and unreadable pages have no furniture.
    """
    common = _function_words(common_words)
    rows = _prepared(pages).where("text IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    spark = pages.sparkSession
    furniture = spark.sparkContext.broadcast(train_furniture(_prepared(pages), common, train_pages))
    shared = spark.sparkContext.broadcast(common)
    found = written(rows.mapInArrow(_findings(shared, furniture, texts), FINDINGS), "page-findings")
    lines = found.where("kind = 'line'").select("source", "page", F.col("a").alias("item")).distinct()
    words = found.where("kind = 'word'").select(F.col("a").alias("word"), "id", "at", "n")
    vocabulary = written(words.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    frequent = _plain_words(vocabulary).orderBy(F.desc("n"), "word").limit(train_words).toArrow()
    editor = train_editor(list(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist())), train_words)
    sent = spark.sparkContext.broadcast(editor)
    broken = _parted(found.where("kind = 'broken'").select("source", "page", "a", "b", "id"), sent)
    if texts:
        broken = written(broken, "broken")
    asked = vocabulary.unionByName(broken.select(F.explode(F.array("solid", "hyphened")).alias("word"), F.lit(0).cast("bigint").alias("n")))
    misread = written(_misread(asked.groupBy("word").agg(F.sum("n").alias("n")), sent), "misread")
    seen = words.select("word", "id", "at").join(misread, "word").select("word", "id", F.explode("at").alias("far"), F.col("right").alias("item"))
    seen = seen.select((F.col("id") + F.col("far")).alias("id"), "word", "item")
    named = found.where("kind = 'page'").select("id", "source", "page")
    mended = seen.select("id", "item").distinct().join(named, "id").select("source", "page", "item")
    joined = _joined(broken, vocabulary, misread, editor)
    fixes = seen.select("id", F.col("word").alias("a"), F.lit(None).cast("string").alias("b"), "item").unionByName(joined.select("id", "a", "b", "item"))
    kept = found.where("kind = 'text'").select("id", "source", "page", F.col("a").alias("text"), F.col("b").alias("ends")) if texts else None
    return PageRepair(lines, mended.unionByName(joined.select("source", "page", "item")).distinct(), misread, fixes, kept)


#: One row per line, broken word and page that has words; words come once per slice with the pages they are on,
#: as distances from the id of its first page.  Texts have what follows each of their lines in ``b``.
FINDINGS = "kind string, source string, page int, a string, b string, n int, id bigint, at array<int>"


def _findings(common, furniture, texts: bool = False):
    """The rows of FINDINGS, made in one pass over the pages; 'text' rows only if asked for."""
    names = [x.split()[0] for x in FINDINGS.split(", ")]

    def rows_of(kind: str, batch, at, a, b, n=None, ids=None, lists=None):
        size = len(a)
        where = pa.array(at, pa.int64()) if at is not None else pa.nulls(size, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * size, pa.string()), batch.column(0).take(where), batch.column(1).take(where), pa.array(a, pa.string()), pa.array(b, pa.string()) if b is not None else pa.nulls(size, pa.string()),
                pa.array(n, pa.int32()) if n is not None else pa.nulls(size, pa.int32()), pa.array(ids, pa.int64()) if ids is not None else pa.nulls(size, pa.int64()),
                lists if lists is not None else pa.nulls(size, pa.list_(pa.int32())),
            ],
            names,
        )

    def run(batches):
        for batch, a, lines, kinds, out in _pages(batches, common.value, furniture.value):
            at = np.flatnonzero(out)
            yield rows_of("line", batch, (lines.pages[at] + a).tolist(), [lines.text(i) for i in at], None)
            words = page_words(lines, kinds, out)
            ids = np.asarray(batch.column(3))
            yield rows_of("broken", batch, [a + p for p, _, _ in words.broken], [x for _, x, _ in words.broken], [y for _, _, y in words.broken], None, ids[[a + p for p, _, _ in words.broken]])
            if texts:
                size = len(kinds)
                kept, ends = kept_lines(lines, kinds, out)
                # an unreadable page stays as it is stored
                for p in np.flatnonzero(kinds == 4):
                    kept[p], ends[p] = batch.column(2)[a + int(p)].as_py(), None
                yield rows_of("text", batch, np.arange(a, a + size), kept, ends, None, ids[a : a + size])
            if not len(words.hashes):
                continue
            order = np.argsort(words.hashes)
            ordered = words.hashes[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]]
            first = order[new]
            n = np.diff(np.flatnonzero(new), append=len(new))
            low = words.low.tobytes().decode("utf-32-le", "replace")
            text = [clean_word(low[i:j]) for i, j in zip(words.starts[first].tolist(), words.ends[first].tolist())]
            pairs = np.sort((np.cumsum(new) - 1) << 32 | words.pages[order])
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
            owner, page = pairs >> 32, pairs & 0xFFFFFFFF
            keep = np.array([t is not None for t in text], bool)
            inside = keep[owner]
            counts = np.bincount(owner[inside], minlength=len(n))[keep]
            far = (ids[a + page[inside]] - ids[a]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(far))
            kept = [t for t in text if t is not None]
            yield rows_of("word", batch, None, kept, None, n[keep].astype(np.int32), np.full(len(kept), ids[a]), lists)
            used = np.unique(page[inside]) + a
            yield rows_of("page", batch, used, [None] * len(used), None, None, ids[used])

    return run


#: What follows a line: a blank, as its paragraph goes on; a line end; the end of a paragraph.
GOES_ON, LINE_END, PARAGRAPH_END = 0, 1, 2
#: Lines longer than this are whole paragraphs and say nothing of the width of the page.
WIDEST = 200


def line_ends(lines: Lines, kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What follows each of the lines ``at``, those that stay of the pages of a slice; the last of a page has PARAGRAPH_END.

    A blank line ends a paragraph, unless furniture stood there and the sentence goes on after it.  Without one, a
    paragraph ends after a heading or caption, and where a sentence ends although the next word would have had room
    in the line.  Entries of lists and tables keep their line ends.
    """
    out = np.full(len(at), PARAGRAPH_END)
    if len(at) < 2:
        return out
    codes, n = lines.codes, len(lines.codes)
    breaks = (codes == 10) | (codes == 0x85) | (codes == 0x2028) | (codes == 13)
    breaks[:-1] &= ~((codes[:-1] == 13) & (codes[1:] == 10))
    total = np.r_[0, np.cumsum(breaks)]
    i, j = at[:-1], at[1:]
    same = lines.pages[i] == lines.pages[j]
    dropped = j - i - 1
    blank = total[lines.starts[j]] - total[lines.ends[i]] > dropped + 1
    size = lines.ends - lines.starts
    ordinary = np.where(size <= WIDEST, size, 0)
    width = np.zeros(len(kinds), np.int64)
    np.maximum.at(width, lines.pages[at], ordinary[at])
    space = np.flatnonzero(V.look_up(V.space_table(), codes))
    word_end = np.r_[space, n][np.searchsorted(space, lines.starts[j])]
    word = np.minimum(word_end, lines.ends[j]) - lines.starts[j]
    had_room = (size[i] + 1 + word <= width[lines.pages[i]]) | (size[i] > WIDEST)
    first, last, before = codes[lines.starts[j]], codes[lines.ends[i] - 1], codes[np.maximum(lines.ends[i] - 2, 0)]
    goes_on = V.look_up(_lower_case(), first)
    stop = _closes(lines, i)
    apart = np.zeros(len(size), bool)  # headings and captions
    for k in np.flatnonzero(~lines.full_stop & (size <= 80) & (lines.chars[:, 6] > 0)):
        line = lines.text(k)
        apart[k] = bool(_SECTION.match(line) or _CAPTION.match(line))
    short = (2 * size[i] < width[lines.pages[i]]) & ~goes_on & ~stop & had_room
    ends = np.where(blank & ~((dropped > 0) & ~stop & goes_on), PARAGRAPH_END, GOES_ON)
    inside = ends == GOES_ON
    ends[inside & (apart[i] & ~goes_on | apart[j] & (stop | had_room) | short | stop & had_room)] = PARAGRAPH_END
    structured = (lines.kinds[i] != 0) | (lines.kinds[j] != 0)
    ends[inside & structured] = LINE_END
    hyphen = np.isin(last, [ord(c) for c in HYPHENS]) & V.look_up(V.alnum_table(), before) & V.look_up(V.alnum_table(), first)
    ends[hyphen & ~(blank & ~goes_on)] = GOES_ON
    listed = np.isin(kinds[lines.pages[i]], (1, 2, 3))
    ends[listed] = np.where(blank[listed], PARAGRAPH_END, LINE_END)
    out[:-1] = np.where(same, ends, PARAGRAPH_END)
    return out


@lru_cache(maxsize=1)
def _lower_case() -> np.ndarray:
    """Whether a sentence may go on with a character: small letters and letters without case."""
    return np.array([(c := chr(i)).islower() or c.isalpha() and not c.isupper() and not c.istitle() for i in range(V._TABLE)], dtype=bool)


def _closes(lines: Lines, at: np.ndarray) -> np.ndarray:
    """Whether lines end a sentence, closing quotes and brackets aside."""
    last = lines.codes[lines.ends[at] - 1]
    before = lines.codes[np.maximum(lines.ends[at] - 2, lines.starts[at])]
    stops, closing = [ord(c) for c in ".!?؟。:"], [ord(c) for c in "\"')]»”’"]
    return np.isin(last, stops) | np.isin(last, closing) & np.isin(before, stops)


def kept_lines(lines: Lines, kinds: np.ndarray, furniture: np.ndarray) -> tuple[list[str], list[str]]:
    """The lines of each page without its furniture, one under the other, and a digit for what follows each of them."""
    at = np.flatnonzero(~furniture)
    if not len(at):
        return [""] * len(kinds), [""] * len(kinds)
    ends = (line_ends(lines, kinds, at) + 48).astype(np.uint8).tobytes().decode()
    size = lines.ends[at] - lines.starts[at] + 1
    to = np.cumsum(size)
    from_ = np.repeat(lines.starts[at] - (to - size), size) + np.arange(to[-1])
    codes = lines.codes.take(from_, mode="clip")
    codes[to - 1] = 10
    whole = codes.tobytes().decode("utf-32-le", "replace")
    cut = np.searchsorted(lines.pages[at], np.arange(len(kinds) + 1))
    begin = np.r_[0, to][cut].tolist()
    return [whole[a : max(a, b - 1)] for a, b in zip(begin[:-1], begin[1:])], [ends[a:b] for a, b in zip(cut[:-1], cut[1:])]


_TOKEN = re.compile(r"\S+")


def _core(token: str) -> tuple[int, int]:
    """Where the word that ``clean_word`` sees stands in a token."""
    begin, end = 0, len(token)
    solid = [k for k, c in enumerate(token) if c.isalnum() or c in _SYMBOLS]
    if not solid:
        return 0, 0
    begin, end = solid[0], solid[-1] + 1
    word = token[begin:end]
    begin += len(word) - len(word.lstrip(_STRIP + HYPHENS))
    end = begin + len(token[begin:end].rstrip(_STRIP + HYPHENS).rstrip("!|"))
    return begin, end


def _cased(seen: str, right: str) -> str:
    """The right spelling in the case of what was seen."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if seen[:1].isupper() else right


def _replaced(token: str, right: str) -> str:
    a, b = _core(token)
    return token[:a] + _cased(token[a:b], right) + token[b:]


def _joined_word(left: str, right: str, item: str | None) -> str:
    """One word of the two parts of a broken one, ``left`` with its hyphen; ``item`` is its right spelling, lower case."""
    stem = left.rstrip(HYPHENS)
    if item is None:  # names, codes and numbers keep their hyphen
        return f"{stem}-{right}"
    for whole in (stem + right, f"{stem}-{right}"):
        if clean_word(whole) == item:
            return whole
    return _replaced(stem + right, item)


def _mended(text: str, misread: dict[str, str], broken: dict[tuple[str, str], str]) -> str:
    """The text with its misread words replaced, those aside that stand broken over two lines."""
    low = text.lower()
    if len(low) != len(text):  # capitals of several small characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = {}
    for word, right in misread.items():
        k = low.find(word)
        while k >= 0:
            begin, end = k, k + len(word)
            while begin and not text[begin - 1].isspace():
                begin -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            a, b = _core(text[begin:end])
            if clean_word(text[begin + a : begin + b]) == word:
                places[begin + a] = (begin + b, begin, end, right)
            k = low.find(word, k + 1)
    out, done = [], 0
    for a, (b, begin, end, right) in sorted(places.items()):
        left = text[begin:end].rstrip(HYPHENS) if text[end : end + 1] == "\n" and text[end - 1] in HYPHENS else ""
        following = _TOKEN.match(text, end + 1) if left else None
        before = text[:begin].rsplit(None, 1)[-1] if begin > 1 and text[begin - 1] == "\n" and text[begin - 2] in HYPHENS else ""
        if following and (left, following[0]) in broken or before and (before.rstrip(HYPHENS), text[begin:end]) in broken:
            continue
        out += [text[done:a], _cased(text[a:b], right)]
        done = b
    return "".join([*out, text[done:]])


_BETWEEN = {"0": " ", "1": "\n", "2": "\n\n"}


def rebuilt(text: str, ends: str, misread: dict[str, str], broken: dict[tuple[str, str], str]) -> str:
    """The text of a page of which furniture is gone: words mended, lines joined, a blank line between paragraphs."""
    if misread:
        text = _mended(text, misread, broken)
    lines = text.split("\n")
    out = []
    for k in range(len(lines) - 1):
        line = lines[k]
        if ends[k] == "0" and line[-1:] in HYPHENS and line:
            last, first = line.rsplit(None, 1)[-1], _TOKEN.match(lines[k + 1])
            pair = (last.rstrip(HYPHENS), first[0]) if first else ("", "")
            if first and (pair in broken or len(last) > 1 and last[-2].isalnum() and pair[1][0].isalnum()):
                # the joined word goes on in the next line, where it may be broken again
                lines[k + 1] = line[: -len(last)] + _joined_word(last, pair[1], broken.get(pair)) + lines[k + 1][len(pair[1]) :]
                continue
        out += [line, _BETWEEN[ends[k]]]
    return "".join([*out, lines[-1]])


def _rebuilt_pages(batches):
    for batch in batches:
        out = []
        for text, ends, fixes in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
            if ends is None:
                out.append(text)
                continue
            fixes = sorted(fixes or [], key=lambda f: (f["a"], f["b"] or "", f["item"]), reverse=True)
            out.append(rebuilt(text, ends, {f["a"]: f["item"] for f in fixes if f["b"] is None}, {(f["a"], f["b"]): f["item"] for f in fixes if f["b"] is not None}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["source", "page", "text"])


def repaired_pages(pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """(source, page, text): every page as continuous paragraphs, without furniture and with its words mended.

    Paragraphs are parted by a blank line; list and table pages lose their furniture and keep their lines;
    unreadable and null texts stay as stored.  A page stored twice with one text comes once, with two texts twice.
    """
    found = repair_pages(pages, common_words, texts=True)
    fixes = found.fixes.groupBy("id").agg(F.collect_set(F.struct("a", "b", "item")).alias("fixes"))
    rows = found.texts.join(fixes, "id", "left").select("source", "page", "text", "ends", "fixes")
    out = rows.mapInArrow(_rebuilt_pages, "source string, page int, text string")
    blank = _prepared(pages).where("text IS NULL")
    return out.unionByName(blank).distinct()


_PLAIN = r"^[\p{L}][\p{L}'’-]*$"


def _plain_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n): frequent words of letters that are no misreadings of a much more frequent one, as far as counts tell."""
    plain = vocabulary.where(F.col("word").rlike(_PLAIN) & (F.col("n") >= LEAST)).withColumn("skeleton", skeleton(F.col("word")))
    most = plain.groupBy("skeleton").agg(F.max("n").alias("most"))
    return plain.join(most, "skeleton").where(F.col("most") < RATIO * F.col("n")).select("word", "n")


def _judged(sent):
    """The (word, right) rows that the editor accepts, with its margin and what the counts add to it."""

    def run(batches):
        editor = sent.value
        for batch in batches:
            seen, meant = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            n, most = (np.maximum(np.asarray(batch.column(k), np.float64), 1) for k in (2, 3))
            score = edit_margin(editor.model, seen, meant) + COUNT_WEIGHT * np.log(most / n / RATIO)
            keep = pa.array(score >= editor.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(score)], ["word", "right", "most", "score"]).filter(keep)

    return run


def _misread(known: DataFrame, sent) -> DataFrame:
    """(word, right): misread words with their right spelling.

    Every frequent word of its skeleton is a candidate; the editor scores all of them, and the best one that it
    accepts holds.  A word of letters alone must be ``RATIO`` times rarer than what it is mended to.
    """
    known = known.where("word IS NOT NULL").withColumn("skeleton", skeleton(F.col("word")))
    right = known.where(F.col("word").rlike(_PLAIN) & (F.col("n") >= 2)).select("skeleton", F.col("word").alias("right"), F.col("n").alias("most"))
    rows = known.join(right, "skeleton").where(F.col("word") != F.col("right"))
    signs = ~F.col("word").rlike(r"^[\p{L}'’-]+$")
    rows = rows.where(((F.col("most") >= RATIO * F.col("n")) & (F.col("most") >= LEAST)) | (signs & (F.col("most") > F.col("n"))))
    judged = written(rows.select("word", "right", "n", "most").mapInArrow(_judged(sent), "word string, right string, most bigint, score double"), "judged")
    # a word that is itself misread is nobody's right spelling
    judged = judged.join(judged.select(F.col("word").alias("right")).distinct(), "right", "left_anti")
    return judged.groupBy("word").agg(F.max_by("right", F.struct("score", "most", "right")).alias("right"))


def _parted(broken: DataFrame, sent) -> DataFrame:
    """Adds to broken words (a, b) their two joined forms and the editor's preference for the hyphen."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = join_preference(sent.value.model, [(x.lower(), y.lower()) for x, y in zip(a, b)])
            solid = [clean_word(x + y) for x, y in zip(a, b)]
            hyphen = [clean_word(f"{x}-{y}") for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(solid, pa.string()), pa.array(hyphen, pa.string()), pa.array(keep), *batch.columns[2:5]], ["source", "page", "solid", "hyphened", "keep", "a", "b", "id"])

    return broken.mapInArrow(run, "source string, page int, solid string, hyphened string, keep double, a string, b string, id bigint").where("solid IS NOT NULL").distinct()


def _joined(broken: DataFrame, vocabulary: DataFrame, misread: DataFrame, editor: Editor) -> DataFrame:
    """(source, page, id, a, b, item): words broken over two lines, joined with or without the hyphen.

    Each of the two forms is mended first where it is misread; the editor's preference in units of what it is on
    held-out words and the logarithm of the counts then decide together.
    """
    forms = broken.select("solid", "hyphened", "keep").distinct()
    for name in ("solid", "hyphened"):
        forms = forms.join(misread.select(F.col("word").alias(name), F.col("right").alias(f"{name}_right")), name, "left")
        forms = forms.withColumn(f"{name}_right", F.coalesce(f"{name}_right", name))
        forms = forms.join(vocabulary.select(F.col("word").alias(f"{name}_right"), F.col("n").alias(f"{name}_n")), f"{name}_right", "left")
    counts = F.log((F.coalesce("hyphened_n", F.lit(0)) + 0.5) / (F.coalesce("solid_n", F.lit(0)) + 0.5))
    hyphen = F.col("keep") / F.lit(editor.join_unit) + COUNT_WEIGHT * counts > 0
    forms = forms.select("solid", "hyphened", "keep", F.when(hyphen, F.col("hyphened_right")).otherwise(F.col("solid_right")).alias("item"))
    return broken.join(forms, ["solid", "hyphened", "keep"]).select("source", "page", "id", "a", "b", "item")


def found_noise(pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """(source, page, kind, item): 'mended' words in their right spelling and 'line' items, furniture as stored."""
    found = repair_pages(pages, common_words)
    mended = found.mended.select("source", "page", F.lit("mended").alias("kind"), "item")
    return mended.unionByName(found.lines.select("source", "page", F.lit("line").alias("kind"), "item"))
