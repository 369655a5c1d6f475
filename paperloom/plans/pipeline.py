"""Ingestion and synchronisation: extract what changed, chunk, plan, apply, verify."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Embedder, embed_rows
from ..operators import chunking, extraction, sync
from ..operators.cascade import extract_pages
from ..session import written
from ..sources.files import changed_files, failed_files, listed_files, source_files
from ..sources.store import ChunkStore


@dataclass(frozen=True)
class IngestSettings:
    """Chunk parameters and version.  ``compare_parameters`` makes a change of them count as a new version."""

    version: str = "2.0"
    size: int = chunking.SIZE
    overlap: int = chunking.OVERLAP
    compare_parameters: bool = True

    @property
    def stored_version(self) -> str:
        return f"{self.version}/{self.size}/{self.overlap}" if self.compare_parameters else self.version


def chunk_rows(pages: DataFrame, settings: IngestSettings) -> DataFrame:
    """Store rows of accepted pages."""
    chunks = chunking.chunk_documents(pages, settings.size, settings.overlap)
    hashes = pages.groupBy("source").agg(F.min("source_hash").alias("source_hash"))
    return chunks.join(hashes, "source").withColumn("pipeline_version", F.lit(settings.stored_version))


def accepted_pages(attempts: DataFrame, blank: DataFrame | None = None) -> DataFrame:
    """(source, source_hash, page, loader, text): the chosen text of each accepted page."""
    status = extraction.page_status(attempts, blank).where("status = 'accepted'").select("source", "page", "loader", "score")
    texts = attempts.where("quality = 'good'").select("source", "source_hash", "page", "loader", "score", "text")
    return texts.join(status, ["source", "page", "loader", "score"]).dropDuplicates(["source", "page"])


def ingest(spark, folder: str, extractors: list, store: ChunkStore, settings: IngestSettings = IngestSettings(), dry_run: bool = False, allow_delete_all: bool = False, embedder: Embedder | None = None) -> DataFrame:
    """Synchronises a store with a folder of files and returns the plan.

    Hashes come first: files whose hash and version are stored are not extracted again.  Files that cannot be read
    are in the plan as FAILED and keep what is stored of them.
    """
    files, listed = source_files(spark, folder), listed_files(spark, folder)
    present = listed.select("source")
    hashed = written(files.select("source", "path", "source_hash"), "hashes")
    failed = written(failed_files(listed, hashed).select("source", F.lit("FAILED").alias("action")), "failed-files")
    states = sync.source_states(store.read())
    fresh = changed_files(files, states, settings.stored_version)
    pages = written(accepted_pages(extract_pages(fresh, extractors)), "accepted")
    same = hashed.join(changed_files(hashed, states, settings.stored_version).select("source"), "source", "left_anti").select("source", "source_hash")
    return synchronise(pages, present, store, settings, dry_run, allow_delete_all, same, embedder).unionByName(failed)


STORE_SCHEMA = "chunk_id string, source string, page int, chunk_index int, text string, char_count int, chunk_size int, chunk_overlap int, noise_lines_removed int, source_hash string, pipeline_version string"


EMBEDDED_SCHEMA = f"{STORE_SCHEMA}, embedding array<float>, embedding_model string, embedding_dimensions int"


def synchronise(pages: DataFrame, present: DataFrame, store: ChunkStore, settings: IngestSettings = IngestSettings(), dry_run: bool = False, allow_delete_all: bool = False, unchanged: DataFrame | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Brings the store in step with ``pages`` and returns the plan (source, action).

    ``unchanged`` (source, source_hash) names files that were not read again because nothing changed.
    ``present`` (source) lists the files that exist; pages may hold fewer of them.  With nothing present and rows
    stored it raises before any work unless ``allow_delete_all``.  Additions and replacements come before
    deletions; afterwards no stored source may be absent from ``present``.  With an ``embedder`` all new rows are
    embedded before anything is stored; the store then has the columns of ``EMBEDDED_SCHEMA``.
    """
    stored = store.read()
    if present.isEmpty() and not stored.isEmpty() and not allow_delete_all:
        raise RuntimeError("no source is present but chunks are stored; deleting all needs allow_delete_all")
    known = written(sync.source_states(stored), "stored-states")
    new_hashes = pages.groupBy("source").agg(F.min("source_hash").alias("source_hash")).withColumn("pipeline_version", F.lit(settings.stored_version))
    if unchanged is not None:
        new_hashes = new_hashes.unionByName(unchanged.withColumn("pipeline_version", F.lit(settings.stored_version)))
    plan = written(sync.sync_plan(new_hashes, known, present), "plan")
    if dry_run:
        return plan
    work = plan.where("action IN ('ADD', 'REPLACE', 'REPROCESS')")
    rows = written(chunk_rows(pages.join(work.select("source"), "source", "left_semi"), settings), "new-chunks")
    if not rows.isEmpty():
        store.replace_sources(rows, (lambda df: embed_rows(df, embedder)) if embedder else None)
    gone = plan.where("action = 'DELETE'")
    if not gone.isEmpty():
        store.delete_sources(gone)
    sync.require(sync.missing_sources(store.read(), present), "stored sources that are not present")
    return plan
