"""Exact vector search and the guard on model and dimensions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top_k


def squared_distance(a, b):
    """Squared Euclidean distance of two arrays, summed as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, query: list[float], key: str = "vec_id", column: str = "embedding", k: int = 5) -> DataFrame:
    """(rank, key, distance): the k nearest rows by squared distance, ties by key.

    An exact scan: one pass, a top-k in each task, one merge.  Vectors that are null or of another dimension are
    never near; see ``dimension_report``.
    """
    literal = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.where(F.size(column) == len(query)).select(key, F.round(squared_distance(F.col(column), literal), 6).alias("distance"))
    return top_k(rows, "distance", key, k, ascending=True).select("rank", key, "distance")


#: Bytes of query vectors that are sent to the tasks at once.
SENT_BYTES = 64 << 20


def nearest_for_all(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 5, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(query, rank, key, distance): the k nearest other vectors of every query, by squared distance, ties by key.

    A query meets the vectors of its own length.  Queries go to the tasks in blocks of ``sent_bytes``, so that
    one scan of the vectors serves hundreds of thousands of them; each task keeps k rows per query over all its
    batches, and the parts are merged per query.
    """
    import numpy as np

    asked = queries.where(F.col(column).isNotNull()).select(F.col(key).cast("bigint").alias("q"), F.col(column).alias("v"))
    size = asked.agg(F.coalesce(F.sum(8 * (F.size("v") + 1)), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // sent_bytes)
    found = None
    for n in range(blocks):  # one block of queries at a time visits the driver
        wanted = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n).toArrow()
        names, points = wanted.column("q").to_numpy(), wanted.column("v").to_pylist()
        lengths = np.array([len(p) for p in points], np.int64)
        parts = {int(d): (names[lengths == d], np.array([p for p in points if len(p) == d], np.float64)) for d in np.unique(lengths) if d}
        sent = vectors.sparkSession.sparkContext.broadcast(parts)

        def near(batches, sent=sent):
            best = {d: (np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)) for d, (q, _) in sent.value.items()}
            for batch in batches:
                lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0))
                for d, (q, points) in sent.value.items():
                    here = np.flatnonzero(lengths == d)
                    if not len(here):
                        continue
                    part = batch.take(pa.array(here))
                    keys, rows = part.column(0).to_numpy(), np.asarray(pc.list_flatten(part.column(1)), np.float64).reshape(-1, d)
                    far_of, key_of = best[d]
                    for at in range(0, len(points), 64):
                        far = ((points[at : at + 64, None, :] - rows[None, :, :]) ** 2).sum(axis=2).round(6)
                        far[q[at : at + 64, None] == keys[None, :]] = np.inf
                        far = np.concatenate([far_of[at : at + 64], far], axis=1)
                        names = np.concatenate([key_of[at : at + 64], np.broadcast_to(keys, (len(far), len(keys)))], axis=1)
                        order = np.lexsort((names, far), axis=1)[:, :k]
                        far_of[at : at + 64], key_of[at : at + 64] = np.take_along_axis(far, order, 1), np.take_along_axis(names, order, 1)
            for d, (far, names) in best.items():
                i, j = np.nonzero(np.isfinite(far))
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0][i]), pa.array(names[i, j]), pa.array(far[i, j])], ["query", "key", "distance"])

        rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.col(column)).mapInArrow(near, "query bigint, key bigint, distance double")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query bigint, rank int, {key} bigint, distance double")
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query", "rank", F.col("key").alias(key), "distance")


def require_one_model(vectors: DataFrame, model: str, dimensions: int, column: str = "embedding") -> None:
    """Raises if any row has another model or another number of dimensions than the query's."""
    from .sync import require

    wrong = vectors.where(~F.col("embedding_model").eqNullSafe(F.lit(model)) | ~F.size(column).eqNullSafe(F.lit(dimensions)))
    require(wrong.select("embedding_model", F.size(column).alias("dimensions")), "vectors of another model")


def dimension_report(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(dimensions, n): rows by number of dimensions, over all rows; null vectors count as null dimensions."""
    return vectors.groupBy(F.when(F.col(column).isNotNull(), F.size(column)).alias("dimensions")).agg(F.count(F.lit(1)).alias("n"))
