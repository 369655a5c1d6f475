"""Extraction cascade over candidate rows: stage gates, the best candidate, page status, file rollups.

A candidate is one attempt of one loader on one page, keyed (source, page, stage_ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text of a page that failed without any message.
NO_TEXT = "No usable text was extracted from the page."
CHECK_FAILED = "Visual blank-page check failed: "
LOADERS = ("pypdf", "pymupdf", "tesseract")


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key, the one with the largest ``by``; ties fall to the row whose columns sort last.

    An aggregate with a map-side combine, no window: a hot key costs no large task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(by).alias("_by"), *(F.col(c).alias(f"_{c}") for c in rest))).alias("_row"))
    return best.select(*keys, *(F.col(f"_row._{c}").alias(c) for c in rest))


def stage_gates(attempts: DataFrame, force_ocr: bool = False) -> DataFrame:
    """(source, page, runs_fallback, runs_ocr): which later stages a page's attempts call for.

    The second loader runs unless the first was good; OCR runs unless one of the two was.  Null labels are not good.
    """
    good = lambda *stages: F.max(F.when(F.col("stage_ord").isin(*stages) & (F.col("quality") == "good"), 1).otherwise(0)) == 1
    out = attempts.groupBy("source", "page").agg(good(1).alias("first_good"), good(1, 2).alias("native_good"))
    forced = F.lit(force_ocr)
    return out.select("source", "page", (forced | ~F.col("first_good")).alias("runs_fallback"), (forced | ~F.col("native_good")).alias("runs_ocr"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """(source, page, stage_ord, loader, quality, score): the highest score of a page, the earliest stage of equals.

    Candidates without a score or of no text (quality empty) are left out; a page without any has no row.
    """
    rows = candidates.where("score IS NOT NULL AND coalesce(quality, '') <> 'empty'")
    best = rows.groupBy("source", "page").agg(F.max_by(F.struct("stage_ord", "loader", "quality", "score"), F.struct("score", -F.col("stage_ord"))).alias("b"))
    return best.select("source", "page", "b.*")


def attempt_records(attempts: DataFrame) -> DataFrame:
    """(source, page, attempts): the attempts of a page in stage order, as an array of structs."""
    record = F.struct("stage_ord", "loader", "quality", "score", "reasons", "error")
    return attempts.groupBy("source", "page").agg(F.sort_array(F.collect_list(record)).alias("attempts"))


def attempt_errors(attempts: DataFrame, fallback: str = NO_TEXT, checks: DataFrame | None = None) -> DataFrame:
    """(source, page, error): the messages of a page in stage order, joined by '; '; else why its check for a blank
    page failed, which ``checks`` (source, page, error) tells; else the fallback text."""
    told = F.when(F.trim("error") != "", F.struct("stage_ord", F.trim("error").alias("error")))
    out = attempts.groupBy("source", "page").agg(F.sort_array(F.collect_list(told)).alias("e"))
    told = F.nullif(F.array_join(F.transform("e", lambda x: x["error"]), "; "), F.lit(""))
    if checks is None:
        return out.select("source", "page", F.coalesce(told, F.lit(fallback)).alias("error"))
    failed = checks.where("error IS NOT NULL").groupBy("source", "page").agg(F.concat(F.lit(CHECK_FAILED), F.min("error")).alias("check"))
    same = out["source"].eqNullSafe(failed["source"]) & out["page"].eqNullSafe(failed["page"])
    return out.join(failed, same, "left").select(out["source"], out["page"], F.coalesce(told, "check", F.lit(fallback)).alias("error"))


def page_status(attempts: DataFrame, blank: DataFrame | None = None) -> DataFrame:
    """(source, page, status, loader, score): blank, failed_extraction, accepted or rejected_low_quality, in this order.

    ``blank`` (source, page) names visually blank pages; a page with a good attempt is never blank.
    """
    rows = attempts.groupBy("source", "page").agg(
        (F.max(F.when(F.col("quality") == "good", 1).otherwise(0)) == 1).alias("any_good"),
        F.max_by(F.struct("stage_ord", "loader", "quality", "score"), F.struct("score", -F.col("stage_ord"))).alias("_any"),
        F.max_by(F.when(F.col("score").isNotNull() & (F.coalesce("quality", F.lit("")) != "empty"), F.struct("stage_ord", "loader", "quality", "score")),
                 F.when(F.col("score").isNotNull() & (F.coalesce("quality", F.lit("")) != "empty"), F.struct("score", -F.col("stage_ord")))).alias("best"),
    )
    if blank is None:
        rows = rows.withColumn("is_blank", F.lit(False))
    else:
        rows = rows.join(blank.select("source", "page", F.lit(True).alias("is_blank")).distinct(), ["source", "page"], "left").withColumn("is_blank", F.coalesce("is_blank", F.lit(False)))
    status = (
        F.when(~F.col("any_good") & F.col("is_blank"), "blank")
        .when(F.col("best").isNull(), "failed_extraction")
        .when(F.col("best.quality") == "good", "accepted")
        .otherwise("rejected_low_quality")
    )
    return rows.select("source", "page", status.alias("status"), "best.loader", "best.score")


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("int")


def file_rollup(pages: DataFrame) -> DataFrame:
    """One row per source: pages by status, accepted ones by loader, pdf_type and file status.

    ``pages`` has source, page, status and loader, one row per page.  Null sources are left out.
    """
    ok = F.col("status") == "accepted"
    out = pages.where("source IS NOT NULL").groupBy("source").agg(
        F.count(F.lit(1)).cast("int").alias("total_pages"),
        _count(ok).alias("accepted"), _count(F.col("status") == "blank").alias("blank"),
        _count(F.col("status") == "rejected_low_quality").alias("rejected"), _count(F.col("status") == "failed_extraction").alias("failed"),
        *(_count(ok & (F.col("loader") == loader)).alias(loader) for loader in LOADERS),
    )
    native, ocr = F.col("pypdf") + F.col("pymupdf") > 0, F.col("tesseract") > 0
    return out.withColumns(
        {
            "fallback": F.col("pymupdf") + F.col("tesseract"),
            "pdf_type": F.when(native & ocr, "mixed").when(native, "text").when(ocr, "scanned").otherwise("unknown"),
            "file_status": F.when(F.col("accepted") == 0, "failed").when((F.col("rejected") > 0) | (F.col("failed") > 0), "partial").otherwise("success"),
        }
    )


def ingestion_summary(files: DataFrame) -> DataFrame:
    """(measure, value, n): files by status and by type, pages by status and by loader."""
    by = lambda name, column: files.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "value", "n")
    counted = ("accepted", "blank", "rejected", "failed", *LOADERS)
    sums = files.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit("pages").alias("measure"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in counted))).alias("r")).select("r.*")
    return by("file_status", "file_status").unionByName(by("pdf_type", "pdf_type")).unionByName(rows)


def route_pages(pages: DataFrame) -> DataFrame:
    """Adds ``route``: ingest for accepted pages with text, else blank, rejected or failed."""
    blank_text = F.coalesce(F.trim("text"), F.lit("")) == ""
    status = F.col("extraction_status")
    return pages.withColumn("route", F.when(status == "blank", "blank").when(status == "rejected_low_quality", "rejected").when((status == "accepted") & ~blank_text, "ingest").otherwise("failed"))


def select_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``pages`` that ``wanted`` (ord, page) asks for, in its order, repeats kept; unknown pages are dropped."""
    return wanted.join(pages, "page").orderBy("ord")


def first_page(pages: DataFrame, preview: int = 500) -> DataFrame:
    """One row: the first page by source and page number with the beginning of its text."""
    return pages.where("text IS NOT NULL").orderBy("source", "page", "ingested_at").limit(1).select("source", "page", F.substring("text", 1, preview).alias("preview"))
