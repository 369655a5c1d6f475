"""Staged extraction of page texts from source files.

Each stage runs only on the pages that the stages before left without good text.  A stage is a map over files: a
file's bytes meet the list of its wanted pages, so a file is read once a stage, by one task, and pages of files
that are done are not read again.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import text_quality
from ..session import written

# fixed values: what counts as ink, and how much of it a blank page may have
WHITE, INK_SHARE, LONGEST_SIDE = 245, 0.0005, 600

CANDIDATE = "source string, source_hash string, page int, stage_ord int, loader string, text string, error string"


class Extractor(Protocol):
    """Reads texts of pages, counted from one, from the bytes of a file."""

    loader: str

    def page_count(self, content: bytes) -> int: ...

    def page_text(self, content: bytes, page: int) -> str: ...


class FormFeedText:
    """Pages of a UTF-8 text file, separated by form feeds: a substitute for readers of page formats."""

    def __init__(self, loader: str = "pypdf") -> None:
        self.loader = loader

    def page_count(self, content: bytes) -> int:
        return len(content.decode("utf-8").split("\f"))

    def page_text(self, content: bytes, page: int) -> str:
        return content.decode("utf-8").split("\f")[page - 1]


def list_pages(files: DataFrame, extractor: Extractor) -> DataFrame:
    """(source, source_hash, page, error): the pages of each file; a file that cannot be read has one row without page."""

    def run(batches):
        for batch in batches:
            out = []
            for source, hash_, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out += [(source, hash_, page + 1, None) for page in range(extractor.page_count(content))]
                except Exception as e:  # a broken file is reported and costs no other file
                    out.append((source, hash_, None, str(e) or type(e).__name__))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], ["source", "source_hash", "page", "error"])

    return files.select("source", "source_hash", "content").mapInArrow(run, "source string, source_hash string, page int, error string")


def run_stage(files: DataFrame, wanted: DataFrame, extractor: Extractor, stage: int) -> DataFrame:
    """Candidate rows of one stage for the wanted (source, page)."""

    def run(batches):
        for batch in batches:
            out = []
            for source, hash_, content, pages in zip(*(c.to_pylist() for c in batch.columns)):
                for page in pages:
                    try:
                        out.append((source, hash_, page, stage, extractor.loader, extractor.page_text(content, page) or "", None))
                    except Exception as e:
                        out.append((source, hash_, page, stage, extractor.loader, None, str(e) or type(e).__name__))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in CANDIDATE.split(", ")])

    asked = wanted.groupBy("source").agg(F.sort_array(F.collect_set("page")).alias("pages"))
    return files.select("source", "source_hash", "content").join(asked, "source").mapInArrow(run, CANDIDATE)


def extract_pages(files: DataFrame, extractors: list[Extractor], language: str = "eng", force_all: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """Scored attempts (source, source_hash, page, stage_ord, loader, text, error, score, quality, reasons).

    ``pages`` (page) limits the pages of every file; numbers a file does not have are dropped.  ``force_all`` runs
    every stage on every page.
    """
    if not extractors:
        raise ValueError("no extractor is given")
    wanted = list_pages(files, extractors[0]).where("page IS NOT NULL").select("source", "page")
    if pages is not None:
        wanted = wanted.join(pages.select("page").distinct(), "page", "left_semi")
    found = None
    for stage, extractor in enumerate(extractors, 1):
        raw = run_stage(files, wanted, extractor, stage)
        kept = [x.split()[0] for x in CANDIDATE.split(", ")]
        scored = text_quality(raw, language=language).select(*kept[:-2], F.col("cleaned").alias("text"), "error", F.when(F.col("error").isNull(), F.col("score")).alias("score"), F.when(F.col("error").isNull(), F.col("quality")).alias("quality"), "reasons")
        scored = written(scored, "stage")
        found = scored if found is None else found.unionByName(scored)
        if not force_all:
            wanted = wanted.join(found.where("quality = 'good'").select("source", "page").distinct(), ["source", "page"], "left_anti")
    return found


def ink_share(pixels: np.ndarray) -> float:
    """Share of dark pixels of a grey image (rows, columns), brought to at most 600 pixels a side by block means."""
    step = max(1, -(-max(pixels.shape) // LONGEST_SIDE))
    rows, columns = (n - n % step for n in pixels.shape)
    small = pixels[:rows, :columns].reshape(rows // step, step, columns // step, step).mean(axis=(1, 3)) if rows and columns else pixels
    return float((small < WHITE).mean()) if small.size else 0.0


def blank_checks(images: DataFrame) -> DataFrame:
    """(source, page, blank, error): whether a grey image (source, page, width, height, pixels) has hardly any ink.

    An image that is missing or of the wrong size is not blank and has an error.
    """

    def run(batches):
        for batch in batches:
            blank, errors = [], []
            for width, height, raw in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                error = "no image" if raw is None else None if width and height and len(raw) == width * height else "the image has another size than stated"
                errors.append(error)
                blank.append(error is None and ink_share(np.frombuffer(raw, np.uint8).reshape(height, width).astype(float)) <= INK_SHARE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blank, pa.bool_()), pa.array(errors, pa.string())], ["source", "page", "blank", "error"])

    return images.select("source", "page", "width", "height", "pixels").mapInArrow(run, "source string, page int, blank boolean, error string")


def blank_pages(images: DataFrame) -> DataFrame:
    """(source, page): pages whose grey image has hardly any ink."""
    return blank_checks(images).where("blank").select("source", "page").distinct()
