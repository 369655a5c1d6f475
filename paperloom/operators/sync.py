"""Keeping a chunk corpus in step with its sources: states, plan, validation and audit.

States are aggregates, plans are joins on the source, and violations are rows of a DataFrame, so all of it works
on corpora of any size; only counts reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("ADD", "SKIP", "REPLACE", "REPROCESS", "DELETE")


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def source_states(chunks: DataFrame) -> DataFrame:
    """(source, source_hash, pipeline_version, chunks): one row per source that is named.

    Hash and version are the smallest of the source: the same whatever the order of rows.  Chunks counts distinct ids.
    """
    rows = chunks.where(_filled("source"))
    return rows.groupBy("source").agg(F.min("source_hash").alias("source_hash"), F.min("pipeline_version").alias("pipeline_version"), F.countDistinct("chunk_id").alias("chunks"))


def current_states(states: DataFrame) -> DataFrame:
    """(source, source_hash, pipeline_version, chunk_ids): the latest state of each source by state_no."""
    row = F.struct("state_no", "source_hash", "pipeline_version", "chunk_ids")
    return states.where(_filled("source")).groupBy("source").agg(F.max(row).alias("s")).select("source", "s.source_hash", "s.pipeline_version", "s.chunk_ids")


def missing_sources(stored: DataFrame, present: DataFrame) -> DataFrame:
    """Stored sources that are no longer present."""
    return stored.select("source").distinct().join(present.select("source").distinct(), "source", "left_anti")


def unprocessed_sources(present: DataFrame, chunked: DataFrame) -> DataFrame:
    """Present sources without any new chunk: kept as they are, never deleted."""
    return missing_sources(present, chunked)


def sync_plan(new: DataFrame, stored: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(source, action): ADD, SKIP, REPLACE, REPROCESS or DELETE.

    ``new`` and ``stored`` have source, source_hash, pipeline_version.  A stored source is deleted when it is not
    among ``present`` (default: the new ones); a present one without new chunks has no action.
    """
    a = new.select("source", F.col("source_hash").alias("h"), F.col("pipeline_version").alias("v"), F.lit(True).alias("in_new"))
    b = stored.select("source", F.col("source_hash").alias("sh"), F.col("pipeline_version").alias("sv"), F.lit(True).alias("in_stored"))
    rows = a.join(b, "source", "full_outer")
    if present is not None:
        rows = rows.join(present.select("source", F.lit(True).alias("here")).distinct(), "source", "left")
    else:
        rows = rows.withColumn("here", F.col("in_new"))
    action = (
        F.when(F.col("in_new").isNull() & F.col("here").isNull(), "DELETE")
        .when(F.col("in_new").isNull(), None)
        .when(F.col("in_stored").isNull(), "ADD")
        .when(F.col("h").eqNullSafe(F.col("sh")) & F.col("v").eqNullSafe(F.col("sv")), "SKIP")
        .when(F.col("h").eqNullSafe(F.col("sh")), "REPROCESS")
        .otherwise("REPLACE")
    )
    return rows.select("source", action.alias("action")).where("action IS NOT NULL")


def action_counts(plan: DataFrame) -> DataFrame:
    """(action, sources): sources by action."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("sources"))


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, violation): one row for each rule that a chunk breaks.

    An empty text hides the other rules.  A chunk id must be the content address of its parts.
    """
    from .chunking import chunk_id

    rule = lambda condition, name: F.when(condition, F.lit(name))
    missing = [rule(~_filled(c), f"missing {c}") for c in ("source", "source_hash", "pipeline_version")]
    page = [rule(F.col("page").isNull(), "missing page"), rule(F.coalesce(F.col("page") <= 0, F.lit(True)), "invalid page")]
    address = rule(F.col("chunk_id") != chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("text")), "chunk_id mismatch")
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    found = F.when(empty, F.array(F.lit("empty document"))).otherwise(F.filter(F.array(*missing, *page, rule(~_filled("chunk_id"), "missing chunk_id"), address), lambda x: x.isNotNull()))
    return chunks.select("chunk_id", F.explode(found).alias("violation"))


def source_violations(chunks: DataFrame) -> DataFrame:
    """(source, violation): sources whose chunks do not have exactly one hash, or one version."""
    rows = chunks.where(_filled("source") & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    n = lambda c: F.countDistinct(F.when(_filled(c), F.col(c)))
    sums = rows.groupBy("source").agg(n("source_hash").alias("h"), n("pipeline_version").alias("v"))
    found = F.filter(F.array(F.when(F.col("h") != 1, "multiple source_hash values"), F.when(F.col("v") != 1, "multiple pipeline versions")), lambda x: x.isNotNull())
    return sums.select("source", F.explode(found).alias("violation"))


def corpus_audit(chunks: DataFrame) -> DataFrame:
    """One row: PASS or FAIL with the figures of a stored corpus.

    Lengths are of chunks with text; a chunk under 100 characters is short; errors counts violations of chunks and
    sources and one for repeated ids.
    """
    filled = F.coalesce(F.trim("text"), F.lit("")) != ""
    n = F.when(filled, F.length("text"))
    figures = chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct(F.when(_filled("source"), F.col("source"))).alias("sources"),
        (F.count("chunk_id") - F.countDistinct("chunk_id")).alias("duplicate_ids"), F.count_if(~filled).alias("empty_chunks"),
        F.count_if(n < 100).alias("short_chunks"), F.count_if(filled & F.col("ocr_used")).alias("ocr_chunks"),
        F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 1).alias("average"),
    )
    broken = chunk_violations(chunks).agg(F.count(F.lit(1)).alias("a")).join(source_violations(chunks).agg(F.count(F.lit(1)).alias("b")))
    errors = F.col("a") + F.col("b") + F.when(F.col("duplicate_ids") > 0, 1).otherwise(0)
    out = figures.join(broken).withColumn("errors", errors).withColumn("status", F.when(F.col("errors") == 0, "PASS").otherwise("FAIL"))
    return out.select("status", *figures.columns, "errors")


def sync_report(store: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: ids of the store and of an index, matching, missing and extra ones, PASS if there is no difference."""
    a = store.select(key).where(F.col(key).isNotNull()).distinct().withColumn("in_store", F.lit(1))
    b = index.select(key).where(F.col(key).isNotNull()).distinct().withColumn("in_index", F.lit(1))
    out = a.join(b, key, "full_outer").agg(
        F.count("in_store").alias("store_ids"), F.count("in_index").alias("index_ids"),
        F.count_if(F.col("in_store").isNotNull() & F.col("in_index").isNotNull()).alias("matching_ids"),
        F.count_if(F.col("in_index").isNull()).alias("missing_ids"), F.count_if(F.col("in_store").isNull()).alias("extra_ids"),
    )
    return out.withColumn("status", F.when((F.col("missing_ids") == 0) & (F.col("extra_ids") == 0), "PASS").otherwise("FAIL"))


def groupable_chunks(chunks: DataFrame, present: DataFrame) -> DataFrame:
    """Chunks fit for grouping by source: the source is present, hash and version are given."""
    return chunks.where(_filled("source_hash") & _filled("pipeline_version")).join(present.select("source").distinct(), "source", "left_semi")


def require(condition_rows: DataFrame, message: str) -> None:
    """Raises if there is any row; used for preconditions and for checks after a write."""
    example = condition_rows.limit(3).collect()
    if example:
        raise RuntimeError(f"{message}: {[r.asDict() for r in example]}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union of frames by column name."""
    return reduce(DataFrame.unionByName, frames)
