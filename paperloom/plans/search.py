"""Hybrid retrieval and grounded answers over a chunk corpus."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Embedder, Generator, OverlapReranker, Reranker, Translator, checked_translation
from ..functions import text as X
from ..operators import fusion, lexical, vectors
from ..operators.sync import require
from ..session import written


@dataclass
class HybridSearcher:
    """Both legs over one corpus (chunk_id, source, page, text, embedding); ``exact`` picks the stemming tokenizer.

    The first question checks the models of all rows and writes the lexical index; later ones read both legs only.
    """

    corpus: DataFrame
    embedder: Embedder
    translator: Translator | None = None
    exact: bool = False

    @cached_property
    def index(self) -> lexical.LexicalIndex:
        """The lexical index, made once, after a check that all vectors are of the query's model."""
        vectors.require_one_model(self.corpus, self.embedder.name, self.embedder.dimensions)
        rows = lexical.one_row_per_key(self.corpus, "chunk_id", ["text"])
        return lexical.build_index(lexical.tokenized(rows, "chunk_id", exact=self.exact), "chunk_id")

    def search(self, query: str, k: int = 5, candidates: int = 20, rrf_k: int = fusion.RRF_K) -> DataFrame:
        """(rank, chunk_id, rrf_score, …, source, page, text): the fused top k of ``candidates`` hits a leg.

        The lexical leg uses the translated query, the vector leg the original one.
        """
        if fusion.positive(candidates, "candidates") < fusion.positive(k, "k"):
            raise ValueError("candidates must not be fewer than k")
        query = query.strip()
        if not query:
            raise ValueError("the query is blank")
        index = self.index
        words = checked_translation(query, self.translator.translate) if self.translator else query
        lexical_hits = lexical.search_index(index, "chunk_id", lexical.terms_of(self.corpus.sparkSession, words, self.exact), k=candidates)
        near = vectors.vector_search(self.corpus, self.embedder.query(query), "chunk_id", k=candidates)
        fused = written(fusion.fuse(near, lexical_hits, k=k, rrf_k=rrf_k), "fused")  # k rows
        texts = self.corpus.select("chunk_id", "source", "page", "text").join(F.broadcast(fused), "chunk_id").dropDuplicates(["chunk_id"])
        found = written(texts, "hits")
        require(fusion.outside_corpus(fused, found), "hits outside the corpus")
        return found.select(*fused.columns, "source", "page", "text").orderBy("rank")


def answer(question: str, searcher: HybridSearcher, generator: Generator, reranker: Reranker | None = None, k: int = 5, candidates: int = 20, threshold: float = fusion.EVIDENCE) -> dict:
    """A response record: retrieve, rerank, gate, build the context, generate.

    At most ``candidates`` rows reach the driver.  Without enough evidence the model is not called.
    """
    question = question.strip()
    if not question:
        raise ValueError("the question is blank")
    spark, reranker, began = searcher.corpus.sparkSession, reranker or OverlapReranker(), time.time()
    out = {"question": question, "answer": "", "sources": [], "model": generator.name, "evidence_threshold": threshold, "evidence_score": 0.0, "evidence_passed": True, "error": None, "error_type": None, "generation_seconds": 0.0}
    message = lambda e: spark.range(1).select(fusion.error_type(F.lit(str(e) or type(e).__name__)).alias("x")).first()["x"]
    try:
        hits = searcher.search(question, candidates, candidates).collect()
    except Exception as e:  # a failing service is reported, not raised
        return out | {"error": str(e), "error_type": message(e), "retrieval_seconds": round(time.time() - began, 4), "total_seconds": round(time.time() - began, 4)}
    scores = reranker.scores(question, [h["text"] for h in hits]) if hits else []
    best = sorted(zip(scores, hits), key=lambda x: (-x[0], x[1]["rank"]))[:k]
    top = best[0][0] if best else 0.0
    out |= {"evidence_score": round(top, 6), "retrieval_seconds": round(time.time() - began, 4)}
    if top < threshold or not best:
        text = spark.range(1).select(fusion.insufficient_message(F.lit(question)).alias("m")).first()["m"]
        return out | {"answer": text, "evidence_passed": False, "total_seconds": round(time.time() - began, 4)}
    rows = spark.createDataFrame([(i + 1, h["source"], h["page"], h["chunk_id"], h["text"]) for i, (_, h) in enumerate(best)], "rank int, source string, page int, chunk_id string, text string")
    context = fusion.build_context(rows).first()
    sources = [c.asDict() | {"rerank_score": best[c["number"] - 1][0]} for c in context["citations"]]
    started = time.time()
    try:
        text = generator.answer(question, context["context"])
    except Exception as e:
        return out | {"sources": sources, "error": str(e), "error_type": message(e), "generation_seconds": round(time.time() - started, 4), "total_seconds": round(time.time() - began, 4)}
    return out | {"answer": text, "sources": sources, "generation_seconds": round(time.time() - started, 4), "total_seconds": round(time.time() - began, 4)}


def settings_in_range(k: int = 5, candidates: int = 20) -> tuple[int, int]:
    """Settings of the search form: k of 3 to 10, candidates of 10 to 40 in steps of 5 and no fewer than k."""
    if not 3 <= k <= 10 or not 10 <= candidates <= 40 or candidates % 5 or candidates < k:
        raise ValueError("k must be 3 to 10, candidates 10 to 40 in steps of 5")
    return k, candidates


def preview(hits: DataFrame, length: int = 62) -> DataFrame:
    """Hits with a short text for display."""
    return hits.withColumn("preview", X.short_text(F.col("text"), length))
