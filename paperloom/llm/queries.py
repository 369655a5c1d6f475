"""Queries of the numbered problems and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table
from . import bisect_split, canonical, leak_scan, mixing, near_dup, ocr_repair, quality_stats, site_lines, spam_pages

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of similar chunks, exact copies of one text too, however many there are."""
    return near_dup.near_duplicate_pairs(read_table(spark, sf_dir, "chunk"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: its class of copies, its links to other classes, and the group that links connect."""
    found = near_dup.near_duplicates(read_table(spark, sf_dir, "chunk"))
    return near_dup.class_links(found)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_repair.found_noise(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "common_words"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, page, text): all pages as continuous paragraphs, without running lines and with their words mended."""
    return ocr_repair.repaired_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "common_words"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisect_split.split_oversized(read_table(spark, sf_dir, "chunk")).where("pieces > 1").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, piece, pieces, start, end, text): the pieces of all chunks."""
    return bisect_split.split_oversized(read_table(spark, sf_dir, "chunk"))


def p3_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, characters, fit, whole, overlapping): for each text whether its pieces fit, leave nothing out and overlap as wanted."""
    chunk = read_table(spark, sf_dir, "chunk").where("chunk_id IS NOT NULL AND text IS NOT NULL")
    one = chunk.groupBy("chunk_id").agg(F.min(F.struct("text", "chunk_size", "chunk_overlap")).alias("r")).select("chunk_id", "r.*")
    pieces = bisect_split.split_oversized(one)
    limit = F.greatest(F.coalesce("chunk_size", F.lit(bisect_split.DEFAULT_LIMIT)), F.lit(1))
    overlap = F.least(F.greatest(F.coalesce("chunk_overlap", F.lit(bisect_split.DEFAULT_OVERLAP)), F.lit(0)), limit - 1)
    before = F.lag("end").over(Window.partitionBy("chunk_id").orderBy("piece"))
    rows = pieces.withColumn("before", before).join(one.select("chunk_id", F.col("text").alias("stored"), limit.alias("limit"), overlap.alias("overlap")), "chunk_id")
    right = (F.length("text") <= F.col("limit")) & (F.substring(F.col("stored"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text"))
    joined = F.when(F.col("before").isNull(), F.col("start") == 0).otherwise((F.col("start") == F.greatest(F.col("before") - F.col("overlap"), F.lit(0))) & (F.col("end") > F.col("before")))
    rows = rows.select("chunk_id", F.length("stored").alias("characters"), "end", right.alias("fit"), joined.alias("overlapping"))
    out = rows.groupBy("chunk_id").agg(F.max("characters").alias("characters"), F.every("fit").alias("fit"), F.max("end").alias("last"), F.every("overlapping").alias("overlapping"))
    return out.select("chunk_id", "characters", "fit", (F.col("last") == F.col("characters")).alias("whole"), "overlapping")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(read_table(spark, sf_dir, "chunk")).select("source", "line")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, source, text, removed): chunks without the lines that their source repeats."""
    chunk = read_table(spark, sf_dir, "chunk")
    return site_lines.remove_repeated_lines(chunk, site_lines.repeated_lines(chunk))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.look_alike_pairs(read_table(spark, sf_dir, "chunk"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, form_id, stored_id, stored_forms, records, copies): each chunk with the classes of its one form and of its stored text."""
    return canonical.form_classes(read_table(spark, sf_dir, "chunk"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_stats.structured_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "common_words"))


def p6_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of figures per page text."""
    return quality_stats.page_statistics(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "common_words"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_scan.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, documents, runs): how many documents hold passages of each test item, and how many runs."""
    found = leak_scan.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.sum("runs").alias("runs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture by source: targets, what is held and the shares reached."""
    return mixing.mixture_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p8_token_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, copies): the mixture measured in tokens of a public byte-level vocabulary."""
    docs = mixing.token_sizes(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), TOKENIZER)
    return mixing.mixed_documents(docs, read_table(spark, sf_dir, "mix_targets"), F.col("size"))


def p8_token_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, used, target_share, used_share): what the drawn mixture holds, in tokens."""
    docs = mixing.token_sizes(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), TOKENIZER)
    return mixing.drawn_shares(docs, read_table(spark, sf_dir, "mix_targets"), F.col("size"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages.spam_pages(read_table(spark, sf_dir, "documents")).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, words, listed, replicated, carried, spam_share) of the flagged documents."""
    return spam_pages.spam_pages(read_table(spark, sf_dir, "documents"))


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_repaired, p3_found, p3_pieces, p3_covered, p4_found, p4_cleaned, p5_found, p5_forms, p6_found, p6_statistics, p7_found, p7_report, p8_found, p8_mixture, p8_token_mixture, p8_token_shares, p9_found, p9_scores)
}

_FORM = canonical.canonical_sql("text")
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"

ORACLE: dict[str, str] = {
    "p1_found": f"""
WITH c AS (SELECT DISTINCT chunk_id, {_FORM} AS text, text AS stored FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT chunk_id, {_WORDS.format("text")} AS w FROM c),
t AS (SELECT DISTINCT chunk_id, array_to_string(w[k:k+2], ' ') AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 3)),
n AS (SELECT chunk_id, count(*) AS n FROM t GROUP BY chunk_id),
both_ AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS m FROM t a JOIN t b USING (g) WHERE a.chunk_id < b.chunk_id GROUP BY ALL),
alike AS (SELECT a, b FROM both_ JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE m >= 0.5 * (x.n + y.n - m)),
same AS (SELECT x.chunk_id AS a, y.chunk_id AS b FROM c x JOIN c y ON x.stored = y.stored WHERE x.chunk_id < y.chunk_id)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM alike UNION SELECT a, b FROM same""",
    "p3_found": "SELECT DISTINCT chunk_id FROM chunk WHERE length(text) > greatest(coalesce(chunk_size, 800), 1)",
    "p3_covered": "SELECT chunk_id, length(text)::INTEGER AS characters, true AS fit, true AS whole, true AS overlapping FROM (SELECT chunk_id, min(text) AS text FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id)",
    "p4_cleaned": """
WITH r AS (SELECT DISTINCT chunk_id, source, text FROM chunk),
s AS (SELECT source, count(DISTINCT chunk_id) AS n FROM r WHERE source IS NOT NULL GROUP BY source),
l AS (SELECT chunk_id, source, regexp_replace(trim(regexp_replace(lower(x), '[ \\t\\r]+', ' ', 'g')), '[0-9]+', '#', 'g') AS line
      FROM (SELECT chunk_id, source, unnest(string_split(text, chr(10))) AS x FROM r WHERE source IS NOT NULL AND chunk_id IS NOT NULL)),
k AS (SELECT source, line, count(DISTINCT chunk_id) AS c FROM l WHERE regexp_matches(line, '\\p{L}') GROUP BY source, line),
f AS (SELECT source, list(line) AS gone FROM k JOIN s USING (source) WHERE c >= 8 AND 10 * c >= n GROUP BY source),
t AS (SELECT chunk_id, source, text, string_split(text, chr(10)) AS lines, coalesce(gone, []) AS gone FROM r LEFT JOIN f USING (source)),
u AS (SELECT *, list_filter(lines, lambda x: NOT list_contains(gone, regexp_replace(trim(regexp_replace(lower(x), '[ \\t\\r]+', ' ', 'g')), '[0-9]+', '#', 'g'))) AS kept FROM t)
SELECT chunk_id, source, CASE WHEN text IS NULL OR len(kept) = len(lines) THEN text ELSE regexp_replace(array_to_string(kept, chr(10)), '^\\n+|\\n+$', '', 'g') END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END::INTEGER AS removed FROM u""",
    "p4_found": """
WITH r AS (SELECT DISTINCT chunk_id, source, text FROM chunk WHERE chunk_id IS NOT NULL AND source IS NOT NULL),
s AS (SELECT source, count(DISTINCT chunk_id) AS n FROM r GROUP BY source),
l AS (SELECT chunk_id, source, regexp_replace(trim(regexp_replace(lower(x), '[ \\t\\r]+', ' ', 'g')), '[0-9]+', '#', 'g') AS line
      FROM (SELECT chunk_id, source, unnest(string_split(text, chr(10))) AS x FROM r)),
k AS (SELECT source, line, count(DISTINCT chunk_id) AS c FROM l WHERE regexp_matches(line, '\\p{L}') GROUP BY source, line)
SELECT source, line FROM k JOIN s USING (source) WHERE c >= 8 AND 10 * c >= n""",
    "p5_found": f"""
WITH c AS (SELECT DISTINCT chunk_id, text AS stored, {_FORM} AS form FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL)
SELECT DISTINCT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM c a JOIN c b USING (form) WHERE a.chunk_id < b.chunk_id AND a.stored <> b.stored""",
    "p5_forms": f"""
WITH c AS (SELECT DISTINCT chunk_id, md5(text) AS stored_id, md5({_FORM}) AS form_id FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT form_id, stored_id, count(DISTINCT chunk_id) AS copies FROM c GROUP BY form_id, stored_id),
f AS (SELECT form_id, count(DISTINCT stored_id) AS stored_forms, count(DISTINCT chunk_id) AS records FROM c GROUP BY form_id)
SELECT chunk_id, form_id, stored_id, stored_forms, records, copies FROM c JOIN s USING (form_id, stored_id) JOIN f USING (form_id)""",
    "p7_report": f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
dw AS (SELECT doc_id, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13))
SELECT item_id, count(DISTINCT doc_id) AS documents, count(*) AS runs FROM dw JOIN iw USING (g) GROUP BY item_id""",
    "p7_found": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
dw AS (SELECT doc_id, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    "p8_found": """
WITH t AS (SELECT source, max(greatest(weight, 0)) AS weight, greatest(coalesce(max(max_repeat), 1), 0) AS max_repeat FROM mix_targets WHERE source IS NOT NULL AND weight IS NOT NULL GROUP BY source),
d AS (SELECT source, sum(coalesce(len(regexp_extract_all(text, '\\S+')), 0)) AS n FROM documents WHERE source IN (SELECT source FROM t) GROUP BY source)
SELECT source FROM t LEFT JOIN d USING (source)
WHERE coalesce(n, 0) * max_repeat < (SELECT sum(n) FROM d) * weight / (SELECT sum(weight) FROM t)""",
}
