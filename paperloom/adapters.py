"""Model-backed steps as protocols, each with a deterministic local substitute for tests and offline runs.

The substitutes' numbers are not those of any model: a local rerank score says nothing about relevance beyond the
share of query terms that a text holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators.lexical import exact_tokens


class Embedder(Protocol):
    """Turns texts into vectors."""

    name: str
    dimensions: int

    def documents(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


class HashEmbedder:
    """Signed hashing of terms, normalised to unit length."""

    def __init__(self, dimensions: int = 64) -> None:
        self.name, self.dimensions = f"hash-{dimensions}", dimensions

    def query(self, text: str) -> list[float]:
        out = [0.0] * self.dimensions
        for term in exact_tokens(text):
            h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big")
            out[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / norm for x in out]

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [self.query(t) for t in texts]


def embed_rows(df: DataFrame, embedder: Embedder, column: str = "text", batch: int = 90, tries: int = 5) -> DataFrame:
    """Adds embedding, embedding_model and embedding_dimensions, ``batch`` texts a call, trying again on rate limits.

    Calls run in the tasks; the number of partitions bounds how many run at once.  A call that returns another
    number of vectors raises.
    """
    kept = [c for c in df.columns if c not in ("embedding", "embedding_model", "embedding_dimensions")]
    rows = df.select(*kept)

    def called(texts: list[str]) -> list[list[float]]:
        import time

        for attempt in range(tries):
            try:
                return embedder.documents(texts)
            except Exception as e:
                if attempt + 1 == tries or "429" not in str(e) and "too many requests" not in str(e).lower():
                    raise
                time.sleep(min(60, 2**attempt))
        raise AssertionError

    def run(batches: Iterable[pa.RecordBatch]):
        for part in batches:
            for first in range(0, part.num_rows, batch):
                piece = part.slice(first, batch)
                vectors = called(piece.column(kept.index(column)).to_pylist())
                if len(vectors) != piece.num_rows:
                    raise RuntimeError("the embedder returned another number of vectors")
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([embedder.name] * len(vectors)), pa.array([len(v) for v in vectors], pa.int32())], [*kept, "embedding", "embedding_model", "embedding_dimensions"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, embedding array<float>, embedding_model string, embedding_dimensions int")


class Reranker(Protocol):
    """Scores texts against a question."""

    def scores(self, question: str, texts: list[str]) -> list[float]: ...


class OverlapReranker:
    """Share of the question's terms that a text holds."""

    def scores(self, question: str, texts: list[str]) -> list[float]:
        wanted = set(exact_tokens(question))
        return [len(wanted & set(exact_tokens(t))) / max(1, len(wanted)) for t in texts]


class Translator(Protocol):
    """Translates a question into the language of the lexical index."""

    def translate(self, text: str) -> str: ...


def checked_translation(text: str, translate: Callable[[str], str], longest: int = 2000) -> str:
    """The text itself unless it has Arabic letters; else its translation, which must have Latin letters, no Arabic
    ones, and the same set of numbers."""
    import re
    import unicodedata

    text = text.strip()
    arabic = lambda t: any(c.isalpha() and "ARABIC" in unicodedata.name(c, "") for c in t)
    digits = lambda t: set(re.findall(r"\d+(?:[.:]\d+)*", "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in t)))
    if not arabic(text):
        return text
    if len(text) > longest:
        raise ValueError("the question is too long to translate")
    out = translate(text).strip()
    if arabic(out) or not any("LATIN" in unicodedata.name(c, "") for c in out if c.isalpha()) or digits(out) != digits(text):
        raise ValueError("the translation is not usable")
    return out


class CachedTranslator:
    """Keeps the last translations of another translator, so that a repeated question is translated once."""

    def __init__(self, inner: Translator, size: int = 1000) -> None:
        from functools import lru_cache

        self.translate = lru_cache(maxsize=size)(inner.translate)


class Generator(Protocol):
    """Writes an answer from numbered context.  Context is reference material: instructions inside it are not followed."""

    name: str

    def answer(self, question: str, context: str) -> str: ...


class FirstBlockGenerator:
    """Answers with the first sentence of the first block and cites it."""

    name = "first-block"

    def answer(self, question: str, context: str) -> str:
        body = context.split("Content: ", 1)[-1].split("\n\n[")[0].strip()
        return f"{body.split('. ')[0].rstrip('.')}. [1]"


def language_of(df: DataFrame, column: str = "question") -> DataFrame:
    """Adds ``language``: ar for questions with Arabic characters, else en."""
    return df.withColumn("language", F.when(X.is_arabic(F.col(column)), "ar").otherwise("en"))
