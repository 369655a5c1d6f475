"""Layout noise, recursive splitting, merging of short pieces, and content-addressed chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SIZE, OVERLAP, SHORT = 800, 120, 100

# fixed values: boundaries from strongest to weakest, and the shapes of layout noise
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ": ", ", ", " ", "")
NOISE_ANYWHERE = (r"(?i)^©\s*ISO\b.*all rights reserved.*$", r"(?i)^ISO\s+\d{3,6}:\d{4}\s*\d{4}-\d{2}$")
NOISE_AT_EDGE = (r"(?i)^ISO\s+\d{3,6}:\d{4}\s*\([a-z]{1,3}\)$", r"^\d{1,4}$", r"(?i)^[ivxlcdm]{1,8}$")
EDGE_LINES = 4


def is_noise(line: Column, at_edge: Column) -> Column:
    """Whether a line is layout noise: some shapes everywhere, others only at the edges of a page."""
    flat = X.squeeze(line)
    anywhere, edge = F.lit(False), F.lit(False)
    for p in NOISE_ANYWHERE:
        anywhere = anywhere | flat.rlike(p)
    for p in NOISE_AT_EDGE:
        edge = edge | flat.rlike(p)
    return anywhere | (at_edge & edge)


def without_noise(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``denoised`` and ``noise_lines_removed``.

    Edge lines are the first and the last four that are not blank.  Blank lines become empty, at most one stays
    in a row; the result is trimmed.  Null counts as empty text.
    """
    lines = F.split(F.coalesce(F.col(column), F.lit("")), r"\r\n|[\n\r]")
    filled = F.filter(F.transform("_lines", lambda x, i: F.when(X.strip(x) != "", i)), lambda i: i.isNotNull())
    out = df.withColumn("_lines", lines).withColumn("_filled", filled)
    edges = F.array_union(F.slice("_filled", 1, EDGE_LINES), F.slice(F.reverse("_filled"), 1, EDGE_LINES))
    out = out.withColumn("_edges", edges)
    judged = F.transform("_lines", lambda x, i: F.when(X.strip(x) == "", F.lit("")).when(~is_noise(x, F.array_contains(F.col("_edges"), i)), x))
    out = out.withColumn("_kept", F.filter(judged, lambda x: x.isNotNull()))
    denoised = X.strip(F.regexp_replace(F.array_join("_kept", "\n"), r"\n{3,}", "\n\n"))
    return out.withColumns({"denoised": denoised, "noise_lines_removed": (F.size("_lines") - F.size("_kept")).cast("int")}).drop("_lines", "_filled", "_edges", "_kept")


def chunk_id(source: Column, page: Column, index: Column, text: Column) -> Column:
    """Content address of a chunk; null parts read 'None', so that no two keys run together."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws("|", part(source), part(page), part(index), part(text)), 256)


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of a text, each after the first beginning with the separator; characters if it is empty."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pieces joined up to the size; each pack begins with as many last pieces of the one before as fit the overlap."""
    packs, pack, length = [], [], 0
    for piece in pieces:
        if pack and length + len(piece) > size:
            packs.append("".join(pack))
            while pack and (length > overlap or length + len(piece) > size):
                length -= len(pack.pop(0))
        pack.append(piece)
        length += len(piece)
    return [*packs, "".join(pack)] if pack else packs


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the strongest separator that a stretch has."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    out, small = [], []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        out += _packed(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [piece]
    out += _packed(small, size, overlap)
    return [c for c in (p.strip() for p in out) if c]


def join_short(pieces: list[str], size: int, least: int = SHORT) -> list[str]:
    """Pieces under ``least`` characters joined to the next one, else to the one before, where the size allows."""
    todo = [p for p in (x.strip() for x in pieces) if p][::-1]
    done: list[str] = []
    while todo:
        now = todo.pop()
        if len(now) < least:
            if todo and len(now) + 2 + len(todo[-1]) <= size:
                todo[-1] = f"{now}\n\n{todo[-1]}"
                continue
            if done and len(done[-1]) + 2 + len(now) <= size:
                done[-1] = f"{done[-1]}\n\n{now}"
                continue
        done.append(now)
    return done


def chunk_documents(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = SHORT) -> DataFrame:
    """Chunks of page rows: (chunk_id, source, page, chunk_index, text, char_count, chunk_size, chunk_overlap, noise_lines_removed).

    Pages without source, page number or text have none; repeated (source, page, text) rows count once.
    ``chunk_index`` counts from one within a page.
    """
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("chunk size must be positive and the overlap smaller than it")
    rows = pages.where("source IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL").select("source", "page", "text").distinct()
    # empty texts have no pieces; a filter here would make Catalyst evaluate the whole expression twice
    rows = without_noise(rows).select("source", "page", "denoised", "noise_lines_removed")

    def cut(batches):
        for batch in batches:
            found = [join_short(split_text(t, size, overlap), size, least) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.list_(pa.string()))], ["source", "page", "noise_lines_removed", "pieces"])

    kind = pages.schema["page"].dataType.simpleString()
    pieces = rows.mapInArrow(cut, f"source string, page {kind}, noise_lines_removed int, pieces array<string>")
    out = pieces.select("source", "page", "noise_lines_removed", F.posexplode("pieces").alias("i", "text")).withColumn("chunk_index", (F.col("i") + 1).cast("int"))
    return out.select(
        chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "source", "page", "chunk_index", "text",
        F.length("text").alias("char_count"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), "noise_lines_removed",
    )


def chunk_summary(chunks: DataFrame, least: int = SHORT) -> DataFrame:
    """One row: number of chunks, shortest, longest and mean length, chunks under ``least`` characters."""
    n = F.length("text")
    return chunks.where("text IS NOT NULL").agg(F.count(F.lit(1)).alias("chunks"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 1).alias("average"), F.count_if(n < least).alias("short"))
