"""Tokens, postings and BM25 top-k.

The plain tokenizer is a Spark expression.  The exact one (compatibility forms, case folding, Arabic marks,
stemming) runs on Arrow batches; a task stems each word once while its table of stems has room.
Statistics are aggregates over the whole corpus.  An index is written once for a corpus; a question then reads only
the postings of its own terms.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem
from ..session import stored, written

K1, B, EPSILON = 1.5, 0.75, 0.25

# fixed values: words that are no terms, and the shape of a term
STOPWORDS = tuple(
    """
    a an the is are was were be been being am
    do does did of in on at to for from with by as
    and or this that these those what which who whom
    whose how why when where it its they them their
    we our you your i me my
    """.split()
)
TERM = r"[0-9]+(?:[.:][0-9]+)*|[\p{L}\p{Nl}\p{No}]+"
# the same shape for Python, and the Arabic lengthening stroke and vowel marks that are dropped before it
_TERM = re.compile(r"\d+(?:[.:]\d+)*|[^\W\d_]+")
_MARKS = re.compile("[\u0640\u064b-\u065f\u0670]")
# end of fixed values


def plain_tokens(text: Column) -> Column:
    """Terms of a text in order: numbers with their clause parts, runs of letters in lower case; no stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


_STOP = frozenset(STOPWORDS)


def exact_tokens(text: str) -> list[str]:
    """Terms before stemming: compatibility forms, case folding, no Arabic marks, ASCII digits, no stopwords."""
    folded = _MARKS.sub("", unicodedata.normalize("NFKC", text).casefold())
    if not folded.isascii():
        folded = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in folded)
    return [t for t in _TERM.findall(folded) if t not in _STOP]


def _tokenized(batches):
    stems: dict[str, str] = {}
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            terms = []
            for t in exact_tokens(text or ""):
                if t not in stems:
                    if len(stems) > 200_000:
                        stems.clear()
                    stems[t] = stem(t) if t.isascii() and t.isalpha() else t
                terms.append(stems[t])
            out.append(terms)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.string()))], [*batch.schema.names[:-1], "terms"])


def tokenized(df: DataFrame, key: str, column: str = "text", exact: bool = False) -> DataFrame:
    """(key, terms); a null text has no terms."""
    rows = df.select(F.col(key), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_text"))
    if not exact:
        return rows.select(key, plain_tokens(F.col("_text")).alias("terms"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(_tokenized, f"`{key}` {kind}, terms array<string>")


def one_row_per_key(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The smallest row of each key: rows stored twice count once."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_r")).select(key, "_r.*")


def tokenless(tokens: DataFrame) -> DataFrame:
    """Rows without any term, which an index cannot hold."""
    return tokens.where(F.size("terms") == 0)


def postings(tokens: DataFrame, key: str) -> DataFrame:
    """(key, term, tf, doc_len): an explode and a partial aggregate; one row per key and distinct term."""
    rows = tokens.where(F.size("terms") > 0).select(key, F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
    return rows.groupBy(key, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_scores(tokens: DataFrame, key: str, terms: list[str], k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(key, bm25_score) of every row that holds at least one of ``terms``, repeats of a term counting again.

    Negative idf is replaced by epsilon times the mean idf of the whole vocabulary.  Statistics are of the whole
    corpus.  The query's terms are literals, so a corpus row is read once and only matching terms are shuffled.
    """
    spark = tokens.sparkSession
    if not terms:
        return tokens.select(key, F.lit(0.0).alias("bm25_score")).limit(0)
    rows = tokens.where(F.size("terms") > 0)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms").cast("double")).alias("avgdl"))
    df = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(size)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    weights = {}
    for t in terms:
        weights[t] = weights.get(t, 0) + 1
    wanted = spark.createDataFrame(list(weights.items()), "term string, times int")
    idf = idf.join(F.broadcast(wanted), "term").crossJoin(F.broadcast(mean))
    idf = idf.select("term", (F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")) * F.col("times")).alias("w"), "avgdl")
    hits = rows.select(key, F.size("terms").alias("dl"), F.explode(F.filter("terms", lambda t: t.isin(*weights))).alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(idf), "term").groupBy(key).agg(F.round(F.sum(part), 6).alias("bm25_score"))


@dataclass
class LexicalIndex:
    """Postings and weights of all terms, both sorted by term within their files, the mean length of a row, and the
    weight of terms that most rows hold."""

    postings: DataFrame  # term, key, dl, tf, bucket
    idf: DataFrame  # term, idf
    mean_length: float
    floor: float
    buckets: int


#: Terms in the corpus for each folder of an index, at most so many folders, and parts of one folder, so that a term of
#: very many rows is written and read by several tasks.
BUCKET_TERMS, BUCKETS, TERM_PARTS = 20_000_000, 256, 16


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(tokens: DataFrame, key: str, strict: bool = False, epsilon: float = EPSILON) -> LexicalIndex:
    """Writes the postings of a corpus, in folders by term and sorted by it: a search opens only the folders of its
    terms and there reads the row groups that may hold them.  Rows without terms are left out; ``strict`` raises on them instead."""
    if strict:
        bad = tokenless(tokens).limit(3).collect()
        if bad:
            raise ValueError(f"rows without any term: {[r[key] for r in bad]}")
    rows = tokens.where(F.size("terms") > 0)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms").cast("double")).alias("avgdl")).first()
    buckets = min(BUCKETS, 1 + int(size["n"] * (size["avgdl"] or 0) / BUCKET_TERMS))
    found = postings(tokens, key).select("term", key, F.col("doc_len").alias("dl"), "tf")
    found = found.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(TERM_PARTS)))
    found = written(found.sortWithinPartitions("bucket", "term"), "lexical-index", keep=True, by="bucket")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", (F.log(F.lit(size["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    idf = written(idf.sortWithinPartitions("term"), "lexical-weights", keep=True)
    mean = idf.agg(F.avg("idf").alias("m")).first()["m"] or 0.0
    return LexicalIndex(found, idf, size["avgdl"] or 1.0, epsilon * mean, buckets)


_INDEXES: dict[tuple, LexicalIndex] = {}


def session_index(name: tuple, key: str, tokens, spark: SparkSession) -> LexicalIndex:
    """The index of that name, made once a session from ``tokens()``; ``name`` changes whenever the corpus does.

    It is made again if the shared folder has been cleared since.
    """
    name = (spark.sparkContext.applicationId, *name)
    if name not in _INDEXES or not (stored(_INDEXES[name].postings) and stored(_INDEXES[name].idf)):
        _INDEXES[name] = build_index(tokens(), key)
    return _INDEXES[name]


def search_index(index: LexicalIndex, key: str, terms: list[str], k: int = 5, k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> DataFrame:
    """(rank, key, bm25_score): the best k rows for some terms, repeats counting again; the terms reach the scan.

    ``allowed`` has the keys that may be found; the statistics stay those of the whole corpus.
    """
    times: dict[str, int] = {}
    for t in terms:
        times[t] = times.get(t, 0) + 1
    weight = F.coalesce(*(F.when(F.col("term") == t, n) for t, n in times.items()), F.lit(0)) if times else F.lit(0)
    chosen = F.col("term").isin(*times) if times else F.lit(False)
    folders = F.lit(False)
    for t in times:  # constants, which prune the folders
        folders = folders | (F.col("bucket") == _bucket(F.lit(t), index.buckets))
    # no more rows than the question has terms
    weights = F.broadcast(index.idf.where(chosen).select("term", (F.when(F.col("idf") < 0, F.lit(index.floor)).otherwise(F.col("idf")) * weight).alias("w")))
    hits = index.postings.where(folders & chosen).join(weights, "term")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.mean_length)))
    scored = hits.groupBy(key).agg(F.round(F.sum(part), 6).alias("bm25_score"))
    if allowed is not None:
        scored = scored.join(allowed.select(key).distinct(), key, "left_semi")
    return top_k(scored, "bm25_score", key, k).select("rank", key, "bm25_score")


def terms_of(spark: SparkSession, query: str, exact: bool = False) -> list[str]:
    """The terms of a query, as the index has them."""
    if exact:
        return [stem(t) if t.isascii() and t.isalpha() else t for t in exact_tokens(query)]
    return spark.range(1).select(plain_tokens(F.lit(query)).alias("t")).first()["t"]


def top_k(scored: DataFrame, score: str, key: str, k: int, ascending: bool = False) -> DataFrame:
    """The first k rows by score, ties by key, with a rank from one.

    Sort and limit run first (a top-k per task, then one merge of k rows each); the window sees k rows only.
    """
    from pyspark.sql import Window

    by = [F.col(score).asc() if ascending else F.col(score).desc(), F.col(key).asc()]
    return scored.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("int"))


def bm25_search(corpus: DataFrame, query: str, key: str = "chunk_id", column: str = "text", k: int = 5, where: Column | None = None, exact: bool = False) -> DataFrame:
    """(rank, key, bm25_score): the best k rows for a query.

    ``where`` filters hits after scoring; the statistics stay those of the whole corpus.  A query without terms
    finds nothing.
    """
    scored = bm25_scores(tokenized(corpus, key, column, exact), key, terms_of(corpus.sparkSession, query, exact))
    if where is not None:
        scored = scored.join(corpus.where(where).select(key).distinct(), key, "left_semi")
    return top_k(scored, "bm25_score", key, k).select("rank", key, "bm25_score")


def bm25_search_all(corpus: DataFrame, queries: DataFrame, key: str = "doc_id", column: str = "text", query_key: str = "query_id", k: int = 5, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, key, bm25_score): the best k rows of the whole corpus for every query (query_id, text).

    Postings meet query terms in a shuffle join on the term, which adaptive execution splits where a term is hot;
    partial sums run before the second shuffle, and only k rows of a query and task reach the last one.
    """
    from pyspark.sql import Window

    rows = tokenized(corpus, key, column).where(F.size("terms") > 0)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms").cast("double")).alias("avgdl"))
    asked = queries.select(query_key, F.explode(plain_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("times"))
    found = rows.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(size)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"), "avgdl")
    part = F.col("idf") * F.col("times") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = asked.join(idf, "term").join(found, "term").groupBy(query_key, key).agg(F.round(F.sum(part), 6).alias("bm25_score"))
    order = Window.partitionBy(query_key).orderBy(F.col("bm25_score").desc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(query_key, "rank", key, "bm25_score")
