"""Queries of the retrieval pipeline, and the SQL they are compared with.

Every query reads whole tables.  A query is registered under its name with its SQL, if SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.quality import text_quality
from ..operators import chunking, extraction, fusion, lexical, sessions, sync, vectors
from ..session import fingerprint, read_table, shared_dir, written
from ..sources.store import ChunkStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


QUESTION = "How often does the audit lead verify the calibration log and the training matrix?"
SOURCE = "consolidated_quality_handbook.pdf"

# ------------------------------------------------------------------------------------------ SQL pieces

_B = r"\s\p{Z}\x{1C}-\x{1F}\x{85}"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_B}]+|[{_B}]+$', '', 'g')"


def _clean(c: str) -> str:
    out = f"regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g')"
    out = f"replace(replace(replace({out}, chr(160), ' '), chr(8203), ''), chr(65279), '')"
    out = f"regexp_replace({out}, '[\\t\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+(\\n|$)', '\\1', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g')"
    return _strip(out)


def _count(c: str, pattern: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, '{pattern}', '', 'g')))"


_CLEANED = f"SELECT source, page, ingested_at, {_clean('text')} AS x FROM pages"
_TERMS = "list_filter(regexp_extract_all(lower({}), '[0-9]+(?:[.:][0-9]+)*|[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda t: t NOT IN ({}))"
_STOP = ", ".join(f"'{w}'" for w in lexical.STOPWORDS)


def _terms(c: str) -> str:
    return _TERMS.format(c, _STOP)


def _bm25(table: str, key: str, text: str) -> str:
    """CTEs that end in scored(key, score)."""
    return f"""
tok AS (SELECT {key} AS k, {_terms("coalesce(text, '')")} AS t FROM {table}),
docs_ AS (SELECT k, t, len(t) AS dl FROM tok WHERE len(t) > 0),
size_ AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs_),
post AS (SELECT k, dl, term, count(*) AS tf FROM (SELECT k, dl, unnest(t) AS term FROM docs_) GROUP BY ALL),
df_ AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df_, size_),
idf_ AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest({_terms(text)}) AS term) GROUP BY term),
scored AS (SELECT k, round(sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN idf_ USING (term) JOIN asked USING (term), size_ GROUP BY k)"""


_CHUNK_ONCE = "chunk_once AS (SELECT chunk_id, r.source AS source, r.page AS page, r.text AS text FROM (SELECT chunk_id, min({'source': source, 'page': page, 'text': text}) AS r FROM chunk WHERE chunk_id IS NOT NULL GROUP BY chunk_id))"


def chunk_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, each id once."""
    return lexical.one_row_per_key(read_table(spark, sf_dir, "chunk"), "chunk_id", ["source", "page", "text"])


def text_index(spark: SparkSession, sf_dir: str, table: str, key: str, exact: bool = False) -> lexical.LexicalIndex:
    """The lexical index of a table's texts, made once a session and again only when its files have changed."""
    rows = lambda: chunk_once(spark, sf_dir) if table == "chunk" else read_table(spark, sf_dir, table)
    name = (sf_dir, table, exact, *fingerprint(spark, f"{sf_dir.rstrip('/')}/{table}.parquet"))
    return lexical.session_index(name, key, lambda: lexical.tokenized(rows(), key, exact=exact), spark)


def asked(spark: SparkSession, sf_dir: str, table: str, key: str, k: int = 5, exact: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """The best k rows of a table for the question."""
    return lexical.search_index(text_index(spark, sf_dir, table, key, exact), key, lexical.terms_of(spark, QUESTION, exact), k=k, allowed=allowed)


# ------------------------------------------------------------------------------------------------ scans


@query("SELECT source, sha256(sum(('0x' || substr(sha256(page || '|' || coalesce(text, '')), 1, 15))::BIGINT)::VARCHAR) AS source_hash FROM (SELECT DISTINCT source, page, text FROM pages WHERE source IS NOT NULL AND page IS NOT NULL) GROUP BY source")
def content_hashes(spark, sf_dir):
    """(source, source_hash): a hash of each source's distinct page texts, which stand in for its bytes.

    Page hashes are summed, so no task ever holds a whole source.
    """
    rows = read_table(spark, sf_dir, "pages").where("source IS NOT NULL AND page IS NOT NULL").select("source", "page", "text").distinct()
    page = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("page").cast("string"), F.coalesce("text", F.lit(""))), 256), 1, 15), 16, 10)
    return rows.groupBy("source").agg(F.sha2(F.sum(page.cast("decimal(20,0)")).cast("string"), 256).alias("source_hash"))


@query("SELECT source, source_hash, pipeline_version, count(*) AS rows FROM chunk GROUP BY ALL")
def metadata_scan(spark, sf_dir):
    """Metadata only: the scan reads three columns."""
    return read_table(spark, sf_dir, "chunk").groupBy("source", "source_hash", "pipeline_version").agg(F.count(F.lit(1)).alias("rows"))


@query(f"SELECT DISTINCT chunk_id, page, chunk_index FROM chunk WHERE source = '{SOURCE}'")
def source_scan(spark, sf_dir):
    """Rows of one source; the equality reaches the Parquet scan."""
    return read_table(spark, sf_dir, "chunk").where(F.col("source") == SOURCE).select("chunk_id", "page", "chunk_index").distinct()


@query("SELECT DISTINCT chunk_id, source FROM chunk WHERE chunk_id IN (SELECT s.chunk_id FROM (SELECT unnest(sources) AS s FROM answers))")
def cited_chunks(spark, sf_dir):
    """Keyed scan: chunks that any answer cites."""
    ids = read_table(spark, sf_dir, "answers").select(F.explode("sources").alias("s")).select("s.chunk_id").distinct()
    return read_table(spark, sf_dir, "chunk").join(ids, "chunk_id", "left_semi").select("chunk_id", "source").distinct()


@query("SELECT 'pages' AS name, count(*) AS rows FROM pages UNION ALL SELECT 'chunk', count(*) FROM chunk UNION ALL SELECT 'attempts', count(*) FROM attempts UNION ALL SELECT 'answers', count(*) FROM answers")
def table_counts(spark, sf_dir):
    """Rows of each stored table."""
    return sync.union_all([read_table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("rows")) for t in ("pages", "chunk", "attempts", "answers")])


@query("SELECT source, page, substr(text, 1, 500) AS preview FROM pages WHERE text IS NOT NULL AND source IS NOT NULL ORDER BY source, page, ingested_at NULLS FIRST LIMIT 1")
def first_page_preview(spark, sf_dir):
    """The first page of the corpus with the beginning of its text."""
    return extraction.first_page(read_table(spark, sf_dir, "pages").where("source IS NOT NULL"))


@query("SELECT w.ord, p.source, p.page, p.ingested_at FROM (SELECT page, min(n) AS ord FROM (VALUES (1, 3), (2, 1), (3, 2)) w(n, page) GROUP BY page) w JOIN pages p USING (page)")
def selected_pages(spark, sf_dir):
    """Pages 3, 1 and 2 of every source, in this order."""
    wanted = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "ord int, page int")
    return extraction.select_pages(read_table(spark, sf_dir, "pages"), wanted).select("ord", "source", "page", "ingested_at")


# ----------------------------------------------------------------------------------------------- text


@query(f"SELECT source, page, ingested_at, x AS cleaned FROM ({_CLEANED})")
def clean_text(spark, sf_dir):
    """Cleaned text of every stored page."""
    return read_table(spark, sf_dir, "pages").select("source", "page", "ingested_at", X.clean_text(F.col("text")).alias("cleaned"))


_SCRIPTS = {"latin": r"\p{Latin}", "arabic": r"\p{Arabic}", "cyrillic": r"\p{Cyrillic}", "greek": r"\p{Greek}"}


@query(
    "SELECT doc_id, letters, "
    + ", ".join(f"CASE WHEN letters > 0 THEN round({n} / letters, 4) ELSE 0.0 END AS {n}_ratio" for n in ("latin", "arabic", "cyrillic", "greek"))
    + f" FROM (SELECT doc_id, {_count('text', r'\p{L}')} AS letters, "
    + ", ".join(f"{_count('regexp_replace(text, ' + repr(chr(92) + 'P{L}') + ', ' + repr('') + ', ' + repr('g') + ')', p)} AS {n}" for n, p in _SCRIPTS.items())
    + " FROM documents WHERE text IS NOT NULL)"
)
def script_ratios(spark, sf_dir):
    """Shares of scripts among the letters of each document."""
    rows = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = rows.select("doc_id", X.letters_only(F.col("text")).alias("l"))
    counts = X.script_counts(F.col("l"))
    rows = rows.select("doc_id", *(v.alias(k) for k, v in counts.items()))
    return rows.select("doc_id", "letters", *(F.when(F.col("letters") > 0, F.round(F.col(n) / F.col("letters"), 4)).otherwise(0.0).alias(f"{n}_ratio") for n in ("latin", "arabic", "cyrillic", "greek")))


@query(
    f"SELECT doc_id, len(t) AS token_count, coalesce(list_max(l), 0) AS max_token_length, len(list_filter(l, lambda x: x >= 45)) AS long_tokens, "
    f"list_sum(l) AS token_chars FROM (SELECT doc_id, t, list_transform(t, lambda x: length(x)) AS l FROM (SELECT doc_id, regexp_extract_all(text, '[^{_B}]+') AS t FROM documents WHERE text IS NOT NULL))"
)
def token_metrics(spark, sf_dir):
    """Token figures of each document."""
    rows = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.token_lengths(F.col("text")).alias("l"))
    total = F.aggregate("l", F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", F.size("l").alias("token_count"), F.coalesce(F.array_max("l"), F.lit(0)).alias("max_token_length"), F.size(F.filter("l", lambda x: x >= 45)).alias("long_tokens"), F.when(F.size("l") > 0, total).alias("token_chars"))


_LINES = f"list_filter(list_transform(regexp_split_to_array(x, '\\r\\n|[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda y: {_strip('y')}), lambda y: y <> '')"


@query(f"""
WITH c AS ({_CLEANED}),
m AS (SELECT *, length(x) AS n, {_count("x", r"[\p{L}\p{N}]")} AS alnum, {_count("x", "[" + _B + "]")} AS blank,
  {_count("x", r"[\p{Cc}\p{Cf}\p{Co}\p{Z}]")} - {_count("x", r"[ \n\t]")} AS hidden, {_count("x", r"\x{FFFD}")} AS repl,
  list_transform(regexp_extract_all(x, '[^{_B}]+'), lambda t: length(t)) AS tok, {_LINES} AS ln,
  {_count("x", r"\p{L}")} AS letters, {_count(r"regexp_replace(x, '\P{L}', '', 'g')", r"\p{Latin}")} AS latin FROM c),
r AS (SELECT *, coalesce(list_max(tok), 0) AS mx, coalesce(round(len(list_filter(tok, lambda t: t >= 45)) / nullif(len(tok), 0), 4), 0) AS lt, len(ln) AS lines,
  coalesce(len(list_filter(ln, lambda y: regexp_matches(regexp_replace(y, '[{_B}]+', '', 'g'), '^\\p{{L}}$'))) / nullif(len(ln), 0), 0) AS single,
  CASE WHEN letters > 0 THEN round(1 - latin / letters, 4) ELSE 0 END AS unexpected, n >= 120 AND blank / greatest(n, 1) < 0.055 AS lowws FROM m),
s AS (SELECT *, greatest(0, 100
  - CASE WHEN n < 20 OR alnum < 8 THEN 50 ELSE 0 END - CASE WHEN 1 - hidden / greatest(n, 1) < 0.95 THEN 20 ELSE 0 END
  - CASE WHEN repl / greatest(n, 1) > 0.01 THEN 30 ELSE 0 END - CASE WHEN lowws THEN 25 ELSE 0 END
  - CASE WHEN mx >= 80 THEN CASE WHEN lowws THEN 30 ELSE 10 END WHEN mx >= 45 THEN 5 ELSE 0 END - CASE WHEN lt >= 0.05 THEN 5 ELSE 0 END
  - CASE WHEN lines >= 5 AND single >= 0.25 THEN 60 ELSE 0 END - CASE WHEN unexpected >= 0.2 THEN 60 WHEN unexpected >= 0.08 THEN 30 ELSE 0 END
  - CASE WHEN n >= 50 AND alnum / greatest(n, 1) < 0.3 THEN 20 ELSE 0 END) AS pts FROM r)
SELECT source, page, ingested_at, CASE WHEN x = '' THEN 0 ELSE pts END AS score,
  CASE WHEN x = '' THEN 'empty' WHEN lines >= 5 AND single >= 0.5 OR unexpected >= 0.5 THEN 'rejected' WHEN pts >= 70 THEN 'good' WHEN pts >= 45 THEN 'suspicious' ELSE 'rejected' END AS quality,
  CASE WHEN x = '' THEN 'empty_text' ELSE concat_ws(' ', CASE WHEN n < 20 OR alnum < 8 THEN 'very_short_text' END, CASE WHEN 1 - hidden / greatest(n, 1) < 0.95 THEN 'low_printable_ratio' END,
    CASE WHEN repl / greatest(n, 1) > 0.01 THEN 'replacement_characters' END, CASE WHEN lowws THEN 'low_whitespace' END, CASE WHEN mx >= 80 THEN 'very_long_token' WHEN mx >= 45 THEN 'long_token' END,
    CASE WHEN lines >= 5 AND single >= 0.25 THEN 'single_char_lines' END, CASE WHEN unexpected >= 0.08 THEN 'unexpected_script' END, CASE WHEN n >= 50 AND alnum / greatest(n, 1) < 0.3 THEN 'low_alnum_ratio' END) END AS reasons
FROM s""")
def page_quality(spark, sf_dir):
    """Score, grade and reasons of every stored page."""
    return text_quality(read_table(spark, sf_dir, "pages").select("source", "page", "ingested_at", "text")).select("source", "page", "ingested_at", "score", "quality", F.array_join("reasons", " ").alias("reasons"))


_NOISE_ANY, _NOISE_EDGE = (" OR ".join(f"regexp_matches(f, '{p}')" for p in shapes) for shapes in (chunking.NOISE_ANYWHERE, chunking.NOISE_AT_EDGE))


@query(f"""
WITH p AS (SELECT DISTINCT source, page, text FROM pages WHERE source IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL),
l AS (SELECT source, page, text, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')) AS y, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), 1) AS i FROM p),
k AS (SELECT *, {_strip("y")} AS s, {_strip("regexp_replace(y, '[" + _B + "]+', ' ', 'g')")} AS f FROM l),
e AS (SELECT *, CASE WHEN s <> '' THEN row_number() OVER (PARTITION BY source, page, text, s <> '' ORDER BY i) END AS a, CASE WHEN s <> '' THEN row_number() OVER (PARTITION BY source, page, text, s <> '' ORDER BY i DESC) END AS b FROM k),
j AS (SELECT *, s <> '' AND ({_NOISE_ANY} OR (a <= 4 OR b <= 4) AND ({_NOISE_EDGE})) AS noise FROM e)
SELECT source, page, {_strip("regexp_replace(coalesce(string_agg(CASE WHEN s = '' THEN '' ELSE y END, chr(10) ORDER BY i) FILTER (NOT noise), ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS denoised, count(*) FILTER (noise) AS removed
FROM j GROUP BY source, page, text""")
def page_noise(spark, sf_dir):
    """Pages without layout noise, and how many lines went."""
    rows = read_table(spark, sf_dir, "pages").where("source IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL").select("source", "page", "text").distinct()
    return chunking.without_noise(rows).select("source", "page", "denoised", F.col("noise_lines_removed").alias("removed"))


@query("SELECT DISTINCT chunk_id, chunk_id = sha256(coalesce(source, 'None') || '|' || coalesce(page::VARCHAR, 'None') || '|' || coalesce(chunk_index::VARCHAR, 'None') || '|' || coalesce(text, 'None')) AS matches FROM chunk")
def chunk_addresses(spark, sf_dir):
    """Whether each chunk id is the content address of its row."""
    address = chunking.chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("text"))
    return read_table(spark, sf_dir, "chunk").select("chunk_id", (F.col("chunk_id") == address).alias("matches")).distinct()


@query()
def chunk_documents(spark, sf_dir):
    """Chunks of all accepted pages."""
    return chunking.chunk_documents(read_table(spark, sf_dir, "pages").where("extraction_status = 'accepted'"))


@query(f"WITH {_CHUNK_ONCE} SELECT count(*) AS chunks, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 1) AS average, count(*) FILTER (length(text) < 100) AS short FROM chunk_once WHERE text IS NOT NULL")
def chunk_lengths(spark, sf_dir):
    """Lengths of the stored chunks."""
    return chunking.chunk_summary(chunk_once(spark, sf_dir))


# ----------------------------------------------------------------------------------- extraction cascade


@query("""SELECT source, page, NOT coalesce(bool_or(quality = 'good' AND stage_ord = 1), false) AS runs_fallback, NOT coalesce(bool_or(quality = 'good' AND stage_ord IN (1, 2)), false) AS runs_ocr
FROM attempts GROUP BY source, page""")
def stage_gates(spark, sf_dir):
    """Which later stages the attempts of each page call for."""
    return extraction.stage_gates(read_table(spark, sf_dir, "attempts"))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY score DESC, stage_ord) AS rn FROM attempts WHERE score IS NOT NULL AND coalesce(quality, '') <> 'empty'"


@query(f"SELECT source, page, stage_ord, loader, quality, score FROM ({_RANKED}) WHERE rn = 1")
def best_candidate(spark, sf_dir):
    """The best attempt of each page."""
    return extraction.best_candidate(read_table(spark, sf_dir, "attempts"))


@query("""SELECT source, page, string_agg(stage_ord || ':' || coalesce(loader, '?') || ':' || coalesce(quality, '?') || ':' || coalesce(score::VARCHAR, '?'), ' ' ORDER BY stage_ord) AS attempts FROM attempts GROUP BY source, page""")
def attempt_records(spark, sf_dir):
    """The attempts of each page in stage order."""
    known = lambda x: F.coalesce(x.cast("string"), F.lit("?"))
    rows = extraction.attempt_records(read_table(spark, sf_dir, "attempts"))
    told = F.transform("attempts", lambda a: F.concat_ws(":", a["stage_ord"].cast("string"), known(a["loader"]), known(a["quality"]), known(a["score"])))
    return rows.select("source", "page", F.array_join(told, " ").alias("attempts"))


@query(f"""SELECT source, page, coalesce(nullif(string_agg(trim(error), '; ' ORDER BY stage_ord) FILTER (trim(error) <> ''), ''), '{extraction.NO_TEXT}') AS error FROM attempts GROUP BY source, page""")
def attempt_errors(spark, sf_dir):
    """The error message of each page."""
    return extraction.attempt_errors(read_table(spark, sf_dir, "attempts"))


_STATUS = f"""
g AS (SELECT source, page, coalesce(bool_or(quality = 'good'), false) AS any_good FROM attempts GROUP BY source, page),
b AS (SELECT source, page, loader, quality, score FROM ({_RANKED}) WHERE rn = 1),
bl AS (SELECT DISTINCT source, page FROM pages WHERE extraction_status = 'blank'),
st AS (SELECT g.source, g.page, CASE WHEN NOT any_good AND bl.source IS NOT NULL THEN 'blank' WHEN b.source IS NULL THEN 'failed_extraction' WHEN b.quality = 'good' THEN 'accepted' ELSE 'rejected_low_quality' END AS status, b.loader, b.score
  FROM g LEFT JOIN b ON g.source = b.source AND g.page = b.page LEFT JOIN bl ON g.source = bl.source AND g.page = bl.page)"""


def _statuses(spark, sf_dir):
    blank = read_table(spark, sf_dir, "pages").where("extraction_status = 'blank'")
    return extraction.page_status(read_table(spark, sf_dir, "attempts"), blank)


@query(f"WITH {_STATUS} SELECT * FROM st")
def page_status(spark, sf_dir):
    """Status of each page from its attempts."""
    return _statuses(spark, sf_dir)


_ROLLUP = """
fr AS (SELECT source, count(*) AS total_pages, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'blank') AS blank, count(*) FILTER (status = 'rejected_low_quality') AS rejected,
  count(*) FILTER (status = 'failed_extraction') AS failed, count(*) FILTER (status = 'accepted' AND loader = 'pypdf') AS pypdf, count(*) FILTER (status = 'accepted' AND loader = 'pymupdf') AS pymupdf,
  count(*) FILTER (status = 'accepted' AND loader = 'tesseract') AS tesseract FROM st WHERE source IS NOT NULL GROUP BY source),
fs AS (SELECT *, pymupdf + tesseract AS fallback, CASE WHEN pypdf + pymupdf > 0 AND tesseract > 0 THEN 'mixed' WHEN pypdf + pymupdf > 0 THEN 'text' WHEN tesseract > 0 THEN 'scanned' ELSE 'unknown' END AS pdf_type,
  CASE WHEN accepted = 0 THEN 'failed' WHEN rejected > 0 OR failed > 0 THEN 'partial' ELSE 'success' END AS file_status FROM fr)"""


@query(f"WITH {_STATUS}, {_ROLLUP} SELECT * FROM fs")
def file_rollup(spark, sf_dir):
    """Counts, type and status of each file."""
    return extraction.file_rollup(_statuses(spark, sf_dir))


@query(
    f"WITH {_STATUS}, {_ROLLUP} SELECT 'file_status' AS measure, file_status AS value, count(*) AS n FROM fs GROUP BY file_status UNION ALL SELECT 'pdf_type', pdf_type, count(*) FROM fs GROUP BY pdf_type "
    + " ".join(f"UNION ALL SELECT 'pages', '{c}', coalesce(sum({c}), 0)::BIGINT FROM fs" for c in ("accepted", "blank", "rejected", "failed", *extraction.LOADERS))
)
def ingestion_summary(spark, sf_dir):
    """Totals of an ingestion run."""
    return extraction.ingestion_summary(extraction.file_rollup(_statuses(spark, sf_dir)))


@query("""SELECT source, CASE WHEN extraction_status = 'blank' THEN 'blank' WHEN extraction_status = 'rejected_low_quality' THEN 'rejected' WHEN extraction_status = 'accepted' AND coalesce(trim(text), '') <> '' THEN 'ingest' ELSE 'failed' END AS route, count(*) AS pages
FROM pages GROUP BY ALL""")
def page_routes(spark, sf_dir):
    """Stored pages of each source by where they go."""
    return extraction.route_pages(read_table(spark, sf_dir, "pages")).groupBy("source", "route").agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT source, page, max(ingested_at) AS ingested_at, count(*) AS stored FROM pages GROUP BY source, page")
def latest_pages(spark, sf_dir):
    """The latest row of each page and how often the page was stored."""
    return read_table(spark, sf_dir, "pages").groupBy("source", "page").agg(F.max("ingested_at").alias("ingested_at"), F.count(F.lit(1)).alias("stored"))


# --------------------------------------------------------------------------------------- synchronisation

_STATES = "ns AS (SELECT source, min(source_hash) AS source_hash, min(pipeline_version) AS pipeline_version, count(DISTINCT chunk_id) AS chunks FROM chunk WHERE coalesce(source, '') <> '' GROUP BY source)"
_CURRENT = "cs AS (SELECT source, arg_max(source_hash, state_no) AS source_hash, arg_max(pipeline_version, state_no) AS pipeline_version FROM (SELECT * FROM source_state s WHERE coalesce(source, '') <> '' AND state_no = (SELECT max(state_no) FROM source_state t WHERE t.source = s.source)) GROUP BY source)"


@query(f"WITH {_STATES} SELECT * FROM ns")
def source_states(spark, sf_dir):
    """State of each source from its chunks."""
    return sync.source_states(read_table(spark, sf_dir, "chunk"))


_PLAN = f"""{_STATES},
cs AS (SELECT s.source, s.source_hash, s.pipeline_version FROM source_state s JOIN (SELECT source, max(state_no) AS m FROM source_state WHERE coalesce(source, '') <> '' GROUP BY source) x ON s.source = x.source AND s.state_no = x.m),
pl AS (SELECT source, CASE WHEN ns.source IS NULL AND p.source IS NULL THEN 'DELETE' WHEN ns.source IS NULL THEN NULL WHEN cs.source IS NULL THEN 'ADD'
  WHEN ns.source_hash IS NOT DISTINCT FROM cs.source_hash AND ns.pipeline_version IS NOT DISTINCT FROM cs.pipeline_version THEN 'SKIP'
  WHEN ns.source_hash IS NOT DISTINCT FROM cs.source_hash THEN 'REPROCESS' ELSE 'REPLACE' END AS action
  FROM ns FULL JOIN cs USING (source) LEFT JOIN (SELECT DISTINCT source FROM pages WHERE source IS NOT NULL) p USING (source))"""


def _plan(spark, sf_dir):
    stored = sync.current_states(read_table(spark, sf_dir, "source_state"))
    present = read_table(spark, sf_dir, "pages").where("source IS NOT NULL").select("source").distinct()
    return sync.sync_plan(sync.source_states(read_table(spark, sf_dir, "chunk")), stored, present)


@query(f"WITH {_PLAN} SELECT source, action FROM pl WHERE action IS NOT NULL")
def sync_plan(spark, sf_dir):
    """What to do with each source."""
    return _plan(spark, sf_dir)


@query(f"WITH {_PLAN} SELECT action, count(*) AS sources FROM pl WHERE action IS NOT NULL GROUP BY action")
def action_counts(spark, sf_dir):
    """Sources by action."""
    return sync.action_counts(_plan(spark, sf_dir))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM mix_targets WHERE source IS NOT NULL)")
def missing_sources(spark, sf_dir):
    """Sources of stored documents that the list of wanted sources lacks."""
    return sync.missing_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


@query("SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def unprocessed_sources(spark, sf_dir):
    """Wanted sources without a document."""
    return sync.unprocessed_sources(read_table(spark, sf_dir, "mix_targets").where("source IS NOT NULL"), read_table(spark, sf_dir, "documents"))


_ADDRESS = "sha256(coalesce(source, 'None') || '|' || coalesce(page::VARCHAR, 'None') || '|' || coalesce(chunk_index::VARCHAR, 'None') || '|' || coalesce(text, 'None'))"
_VIOLATIONS = f"""
cv AS (SELECT chunk_id, unnest(CASE WHEN coalesce(trim(text), '') = '' THEN ['empty document'] ELSE list_filter([
  CASE WHEN coalesce(source, '') = '' THEN 'missing source' END, CASE WHEN coalesce(source_hash, '') = '' THEN 'missing source_hash' END, CASE WHEN coalesce(pipeline_version, '') = '' THEN 'missing pipeline_version' END,
  CASE WHEN page IS NULL THEN 'missing page' END, CASE WHEN coalesce(page <= 0, true) THEN 'invalid page' END, CASE WHEN coalesce(chunk_id, '') = '' THEN 'missing chunk_id' END, CASE WHEN chunk_id <> {_ADDRESS} THEN 'chunk_id mismatch' END], lambda v: v IS NOT NULL) END) AS violation FROM chunk),
sv AS (SELECT source, unnest(list_filter([CASE WHEN h <> 1 THEN 'multiple source_hash values' END, CASE WHEN v <> 1 THEN 'multiple pipeline versions' END], lambda x: x IS NOT NULL)) AS violation
  FROM (SELECT source, count(DISTINCT nullif(source_hash, '')) AS h, count(DISTINCT nullif(pipeline_version, '')) AS v FROM chunk WHERE coalesce(source, '') <> '' AND coalesce(trim(text), '') <> '' GROUP BY source))"""


@query(f"WITH {_VIOLATIONS} SELECT chunk_id, violation FROM cv")
def chunk_violations(spark, sf_dir):
    """Rules that stored chunks break."""
    return sync.chunk_violations(read_table(spark, sf_dir, "chunk"))


@query(f"WITH chunk AS (SELECT unnest(chunk_ids) AS chunk_id, 'listed' AS text, source, source_hash, pipeline_version, 1 AS page, 0 AS chunk_index FROM source_state), {_VIOLATIONS} SELECT source, violation FROM sv")
def source_violations(spark, sf_dir):
    """Sources whose chunks, over all states that list them, have not exactly one hash and version."""
    states = read_table(spark, sf_dir, "source_state")
    return sync.source_violations(states.select(F.explode("chunk_ids").alias("chunk_id"), F.lit("listed").alias("text"), "source", "source_hash", "pipeline_version"))


@query(f"""WITH {_VIOLATIONS}, f AS (SELECT count(*) AS chunks, count(DISTINCT nullif(source, '')) AS sources, count(chunk_id) - count(DISTINCT chunk_id) AS duplicate_ids, count(*) FILTER (coalesce(trim(text), '') = '') AS empty_chunks,
  count(*) FILTER (coalesce(trim(text), '') <> '' AND length(text) < 100) AS short_chunks, count(*) FILTER (coalesce(trim(text), '') <> '' AND ocr_used) AS ocr_chunks, min(length(text)) FILTER (coalesce(trim(text), '') <> '') AS shortest,
  max(length(text)) FILTER (coalesce(trim(text), '') <> '') AS longest, round(avg(length(text)) FILTER (coalesce(trim(text), '') <> ''), 1) AS average FROM chunk),
e AS (SELECT f.*, (SELECT count(*) FROM cv) + (SELECT count(*) FROM sv) + CASE WHEN duplicate_ids > 0 THEN 1 ELSE 0 END AS errors FROM f)
SELECT CASE WHEN errors = 0 THEN 'PASS' ELSE 'FAIL' END AS status, * FROM e""")
def corpus_audit(spark, sf_dir):
    """Audit of the stored chunks."""
    return sync.corpus_audit(read_table(spark, sf_dir, "chunk"))


_INDEXED = "SELECT DISTINCT unnest(chunk_ids) AS chunk_id FROM source_state"


@query(f"""WITH a AS (SELECT DISTINCT chunk_id FROM chunk WHERE chunk_id IS NOT NULL), b AS (SELECT chunk_id FROM ({_INDEXED}) WHERE chunk_id IS NOT NULL),
r AS (SELECT count(a.chunk_id) AS store_ids, count(b.chunk_id) AS index_ids, count(*) FILTER (a.chunk_id = b.chunk_id) AS matching_ids, count(*) FILTER (b.chunk_id IS NULL) AS missing_ids, count(*) FILTER (a.chunk_id IS NULL) AS extra_ids FROM a FULL JOIN b ON a.chunk_id = b.chunk_id)
SELECT *, CASE WHEN missing_ids = 0 AND extra_ids = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def sync_report(spark, sf_dir):
    """Ids of the chunks against the ids that the states list."""
    index = read_table(spark, sf_dir, "source_state").select(F.explode("chunk_ids").alias("chunk_id"))
    return sync.sync_report(read_table(spark, sf_dir, "chunk"), index)


@query(f"SELECT DISTINCT chunk_id FROM chunk WHERE chunk_id NOT IN (SELECT chunk_id FROM ({_INDEXED}) WHERE chunk_id IS NOT NULL)")
def insert_absent(spark, sf_dir):
    """Chunks that an insert-if-absent would embed and add: those no state lists."""
    index = read_table(spark, sf_dir, "source_state").select(F.explode("chunk_ids").alias("chunk_id")).distinct()
    return read_table(spark, sf_dir, "chunk").where("chunk_id IS NOT NULL").join(index, "chunk_id", "left_anti").select("chunk_id").distinct()


@query(f"SELECT chunk_id FROM ({_INDEXED}) WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunk WHERE chunk_id IS NOT NULL)")
def stale_chunks(spark, sf_dir):
    """Listed ids without a chunk: what a replacement deletes."""
    index = read_table(spark, sf_dir, "source_state").select(F.explode("chunk_ids").alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()
    return index.join(read_table(spark, sf_dir, "chunk").where("chunk_id IS NOT NULL").select("chunk_id"), "chunk_id", "left_anti")


@query("SELECT source, count(DISTINCT chunk_id) AS chunks FROM chunk WHERE coalesce(source_hash, '') <> '' AND coalesce(pipeline_version, '') <> '' AND source IN (SELECT source FROM pages WHERE source IS NOT NULL) GROUP BY source")
def groupable_chunks(spark, sf_dir):
    """Chunks per source that are fit for grouping."""
    rows = sync.groupable_chunks(read_table(spark, sf_dir, "chunk"), read_table(spark, sf_dir, "pages").where("source IS NOT NULL"))
    return rows.groupBy("source").agg(F.countDistinct("chunk_id").alias("chunks"))


# ------------------------------------------------------------------------------------------------ search


@query(f"WITH {_bm25('documents', 'doc_id', chr(39) + QUESTION + chr(39))} SELECT row_number() OVER (ORDER BY score DESC, k) AS rank, k AS doc_id, score AS bm25_score FROM scored ORDER BY score DESC, k LIMIT 5")
def bm25_topk(spark, sf_dir):
    """The best five documents for a question."""
    return asked(spark, sf_dir, "documents", "doc_id")


@query(ORACLE["bm25_topk"])
def bm25_indexed(spark, sf_dir):
    """The best five documents for a question, by an index that is written anew."""
    index = lexical.build_index(lexical.tokenized(read_table(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    return lexical.search_index(index, "doc_id", lexical.terms_of(spark, QUESTION))


@query(
    f"WITH {_CHUNK_ONCE}, {_bm25('chunk_once', 'chunk_id', chr(39) + QUESTION + chr(39))} SELECT row_number() OVER (ORDER BY score DESC, k) AS rank, k AS chunk_id, score AS bm25_score FROM scored WHERE k IN (SELECT chunk_id FROM chunk_once WHERE source = '{SOURCE}') ORDER BY score DESC, k LIMIT 5"
)
def bm25_source_filtered(spark, sf_dir):
    """The best five chunks of one source; scores are those of the whole corpus."""
    return asked(spark, sf_dir, "chunk", "chunk_id", allowed=chunk_once(spark, sf_dir).where(F.col("source") == SOURCE))


@query()
def bm25_stemmed(spark, sf_dir):
    """The best twenty documents with the exact tokenizer and stems."""
    return asked(spark, sf_dir, "documents", "doc_id", k=20, exact=True)


@query()
def tokenize_exact(spark, sf_dir):
    """(doc_id, n, terms): stemmed terms of every document."""
    rows = lexical.tokenized(read_table(spark, sf_dir, "documents"), "doc_id", exact=True)
    return rows.select("doc_id", F.size("terms").alias("n"), F.sha2(F.array_join("terms", " "), 256).alias("terms"))


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term")
def vocabulary(spark, sf_dir):
    """Corpus and document frequency of every term."""
    tokens = lexical.tokenized(read_table(spark, sf_dir, "documents"), "doc_id")
    return lexical.postings(tokens, "doc_id").groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(f"SELECT DISTINCT source, page FROM pages WHERE len({_terms("coalesce(text, '')")}) = 0")
def tokenless_pages(spark, sf_dir):
    """Pages without a term, which an index cannot hold."""
    rows = read_table(spark, sf_dir, "pages").withColumn("key", F.struct("source", "page"))
    return lexical.tokenless(lexical.tokenized(rows, "key")).select("key.source", "key.page").distinct()


@query(f"""WITH tok AS (SELECT doc_id AS k, {_terms("coalesce(text, '')")} AS t FROM documents),
docs_ AS (SELECT k, t, len(t) AS dl FROM tok WHERE len(t) > 0), size_ AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs_),
post AS (SELECT k, dl, term, count(*) AS tf FROM (SELECT k, dl, unnest(t) AS term FROM docs_) GROUP BY ALL), df_ AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df_, size_), idf_ AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT q, term, count(*) AS times FROM (SELECT doc_id AS q, unnest({_terms("title")}) AS term FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL) GROUP BY q, term),
scored AS (SELECT q, k, round(sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN idf_ USING (term) JOIN asked USING (term), size_ GROUP BY q, k)
SELECT * FROM (SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, k) AS rank, k AS doc_id, score AS bm25_score FROM scored) WHERE rank <= 5""")
def bm25_all_queries(spark, sf_dir):
    """Top five documents for the title of every document whose id is divisible by 100, against all documents."""
    docs = read_table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 100 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    return lexical.bm25_search_all(docs, asked)


_VECTOR = "SELECT vec_id, round(pow(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 2), 6) AS distance FROM embeddings"


def _query_vector(spark, sf_dir):
    return [float(x) for x in read_table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(f"SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, distance FROM ({_VECTOR}) ORDER BY distance, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    """The twenty nearest vectors of the first one."""
    return vectors.vector_search(read_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), k=20)


@query(
    "SELECT query, rank, vec_id, distance FROM (SELECT q.vec_id AS query, v.vec_id, round(pow(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2), 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(pow(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2), 6), v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5"
)
def vector_all_queries(spark, sf_dir):
    """The five nearest other vectors of every vector whose id is divisible by 100, against all vectors."""
    rows = read_table(spark, sf_dir, "embeddings")
    return vectors.nearest_for_all(rows.where("vec_id % 100 = 0"), rows)


@query("SELECT CASE WHEN embedding IS NOT NULL THEN len(embedding) END AS dimensions, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dimensions(spark, sf_dir):
    """Stored vectors by number of dimensions."""
    return vectors.dimension_report(read_table(spark, sf_dir, "embeddings"))


_LEGS = f"""{_bm25('documents', 'doc_id', chr(39) + QUESTION + chr(39))},
lx AS (SELECT row_number() OVER (ORDER BY score DESC, k) AS bm25_rank, k AS doc_id, score AS bm25_score FROM scored ORDER BY score DESC, k LIMIT 20),
vx AS (SELECT row_number() OVER (ORDER BY distance, vec_id) AS vector_rank, vec_id AS doc_id, distance FROM ({_VECTOR}) WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY distance, vec_id LIMIT 20),
fx AS (SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 9) AS rrf_score, vector_rank, bm25_rank, distance, bm25_score FROM vx FULL JOIN lx USING (doc_id)),
tx AS (SELECT row_number() OVER (ORDER BY rrf_score DESC, doc_id) AS rank, * FROM fx ORDER BY rrf_score DESC, doc_id LIMIT 10)"""


def _legs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = read_table(spark, sf_dir, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = vectors.vector_search(rows, _query_vector(spark, sf_dir), k=20).withColumnRenamed("vec_id", "doc_id")
    return near, asked(spark, sf_dir, "documents", "doc_id", k=20)


@query(f"WITH {_LEGS} SELECT * FROM tx")
def rrf_fusion(spark, sf_dir):
    """Both legs fused, ten documents."""
    return fusion.fuse(*_legs(spark, sf_dir), key="doc_id", k=10)


@query(f"WITH {_LEGS} SELECT (SELECT count(*) FROM vx) AS vector_candidates, (SELECT count(*) FROM lx) AS bm25_candidates, (SELECT count(*) FROM fx) AS unique_candidates, (SELECT count(*) FROM tx) AS returned, 'hybrid' AS mode")
def search_stats(spark, sf_dir):
    """Candidates of the two legs and the mode."""
    near, words = _legs(spark, sf_dir)
    return fusion.search_stats(near, words, fusion.fuse(near, words, key="doc_id", k=10), "doc_id")


@query(f"""WITH {_CHUNK_ONCE}, {_bm25('chunk_once', 'chunk_id', chr(39) + QUESTION + chr(39))}, h AS (SELECT row_number() OVER (ORDER BY score DESC, k) AS rank, k AS chunk_id FROM scored ORDER BY score DESC, k LIMIT 5)
SELECT string_agg('[' || rank || ']' || chr(10) || 'Source: ' || coalesce(source, '?') || chr(10) || 'Page: ' || coalesce(page::VARCHAR, '?') || chr(10) || 'Content: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS citations FROM h JOIN chunk_once USING (chunk_id)""")
def context_build(spark, sf_dir):
    """The numbered context of the best five chunks."""
    chunks = chunk_once(spark, sf_dir)
    hits = chunks.join(F.broadcast(asked(spark, sf_dir, "chunk", "chunk_id")), "chunk_id")  # five rows
    return fusion.build_context(hits).select("context", F.size("citations").cast("bigint").alias("citations"))


@query(f"""WITH {_bm25('documents', 'doc_id', chr(39) + QUESTION + chr(39))}, h AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) AS hybrid_rank FROM scored ORDER BY score DESC, k LIMIT 20),
w AS (SELECT list_distinct({_terms(chr(39) + QUESTION + chr(39))}) AS w), s AS (SELECT k AS doc_id, hybrid_rank, round(len(list_intersect(w, t)) / len(w)::DOUBLE, 6) AS rerank_score FROM h JOIN tok USING (k), w)
SELECT row_number() OVER (ORDER BY rerank_score DESC, hybrid_rank) AS rank, doc_id, rerank_score, hybrid_rank FROM s ORDER BY rerank_score DESC, hybrid_rank LIMIT 5""")
def reranked_topk(spark, sf_dir):
    """The best five of twenty candidates by the share of the question's terms that they hold, as a reranker gives them."""
    docs = read_table(spark, sf_dir, "documents")
    terms = sorted(set(lexical.terms_of(spark, QUESTION)))
    hits = written(asked(spark, sf_dir, "documents", "doc_id", k=20), "candidates")  # twenty rows
    held = F.size(F.array_intersect(lexical.plain_tokens(F.col("text")), F.array(*map(F.lit, terms))))
    results = docs.join(F.broadcast(hits), "doc_id").select((F.col("rank") - 1).alias("index"), F.round(held / len(terms), 6).alias("rerank_score"))
    return fusion.reranked(fusion.checked_results(hits, written(results, "reranked")), key="doc_id")


@query(ORACLE["context_build"].replace("AS context, count(*) AS citations", "AS context") .replace("SELECT string_agg", f"SELECT '{fusion.GROUNDING}' || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg").replace("AS context FROM", f"|| chr(10) || chr(10) || 'Question: {QUESTION}' AS prompt FROM"))
def grounded_prompt(spark, sf_dir):
    """What a generator is asked: the rules, the numbered context of the best five chunks, and the question."""
    chunks = chunk_once(spark, sf_dir)
    hits = chunks.join(F.broadcast(asked(spark, sf_dir, "chunk", "chunk_id")), "chunk_id")  # five rows
    return fusion.build_context(hits).select(fusion.grounded_prompt(F.lit(QUESTION), F.col("context")).alias("prompt"))


# ------------------------------------------------------------------------------------------------- store

_STORED = f"{_CHUNK_ONCE}, base AS (SELECT chunk_id, source, text FROM chunk_once WHERE coalesce(trim(source), '') <> '' AND coalesce(trim(text), '') <> '')"
_SEVERAL = "several AS (SELECT source FROM source_state GROUP BY source HAVING count(DISTINCT source_hash) > 1)"


def _base_store(spark, sf_dir):
    """A new store with every chunk that has a source and a text."""
    import uuid

    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    rows = chunk_once(spark, sf_dir).where(filled("source") & filled("text")).select("chunk_id", "source", "text")
    store = ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "chunk_id string, source string, text string")
    store.upsert(rows)
    return store, rows


def _several_hashes(spark, sf_dir):
    states = read_table(spark, sf_dir, "source_state")
    return states, states.groupBy("source").agg(F.countDistinct("source_hash").alias("n")).where("n > 1").select("source")


@query(f"""WITH {_STORED}, c AS (SELECT DISTINCT s.chunk_id AS chunk_id FROM (SELECT unnest(sources) AS s FROM answers)),
n AS (SELECT chunk_id, source, 'Cited: ' || text AS text FROM base WHERE chunk_id IN (SELECT chunk_id FROM c WHERE chunk_id IS NOT NULL)
  UNION ALL SELECT x AS chunk_id, min(source) AS source, 'Listed only.' AS text FROM (SELECT source, unnest(chunk_ids) AS x FROM source_state) WHERE x IS NOT NULL AND source IS NOT NULL AND x NOT IN (SELECT chunk_id FROM base) GROUP BY x)
SELECT chunk_id, source, md5(text) AS text FROM n UNION ALL SELECT chunk_id, source, md5(text) FROM base WHERE chunk_id NOT IN (SELECT chunk_id FROM n)""")
def store_upsert(spark, sf_dir):
    """A store of all chunks after cited ones were stored anew and listed ones without a row were added."""
    store, base = _base_store(spark, sf_dir)
    cited = read_table(spark, sf_dir, "answers").select(F.explode("sources").alias("s")).select("s.chunk_id").distinct()
    states = read_table(spark, sf_dir, "source_state").where("source IS NOT NULL").select(F.explode("chunk_ids").alias("chunk_id"), "source").where("chunk_id IS NOT NULL")
    listed = states.join(base.select("chunk_id"), "chunk_id", "left_anti").groupBy("chunk_id").agg(F.min("source").alias("source")).withColumn("text", F.lit("Listed only."))
    store.upsert(base.join(cited, "chunk_id", "left_semi").withColumn("text", F.concat(F.lit("Cited: "), "text")).unionByName(listed))
    return store.read().select("chunk_id", "source", F.md5("text").alias("text"))


@query(f"""WITH {_STORED}, {_SEVERAL}, n AS (SELECT DISTINCT x AS chunk_id, source, 'State of ' || source AS text FROM (SELECT source, unnest(chunk_ids) AS x FROM source_state) JOIN several USING (source) WHERE x IS NOT NULL)
SELECT source, count(*) AS chunks, min(chunk_id) AS first, max(md5(text)) AS text FROM (SELECT * FROM n UNION ALL SELECT * FROM base WHERE source NOT IN (SELECT source FROM several)) GROUP BY source""")
def store_replace(spark, sf_dir):
    """Chunks by source after every source with several hashes was replaced by the ids that its states list."""
    store, _ = _base_store(spark, sf_dir)
    states, several = _several_hashes(spark, sf_dir)
    rows = states.join(several, "source").select(F.explode("chunk_ids").alias("chunk_id"), "source", F.concat(F.lit("State of "), "source").alias("text"))
    store.replace_sources(rows.where("chunk_id IS NOT NULL").distinct())
    return store.read().groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk_id").alias("first"), F.max(F.md5("text")).alias("text"))


@query(f"WITH {_STORED}, {_SEVERAL} SELECT source, count(*) AS chunks FROM base WHERE source NOT IN (SELECT source FROM several) GROUP BY source")
def store_delete(spark, sf_dir):
    """Chunks by source after every source with several hashes was deleted."""
    store, _ = _base_store(spark, sf_dir)
    store.delete_sources(_several_hashes(spark, sf_dir)[1])
    return store.read().groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


# ----------------------------------------------------------------------------------------------- answers

_LAST = "la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY received_at DESC, created_at DESC) AS rn FROM answers WHERE answer_id IS NOT NULL) WHERE rn = 1)"


@query(f"WITH {_LAST} SELECT answer_id, coalesce(evidence_score, 0) >= coalesce(evidence_threshold, 0.05) AS passed, coalesce(evidence_passed, false) <> (coalesce(evidence_score, 0) >= coalesce(evidence_threshold, 0.05)) AS differs FROM la")
def evidence_gate(spark, sf_dir):
    """The evidence gate recomputed for every answer."""
    passed = fusion.evidence_passed(F.col("evidence_score"), F.coalesce("evidence_threshold", F.lit(fusion.EVIDENCE)))
    return sessions.distinct_answers(read_table(spark, sf_dir, "answers")).select("answer_id", passed.alias("passed"), (F.coalesce("evidence_passed", F.lit(False)) != passed).alias("differs"))


@query(f"""WITH {_LAST} SELECT answer_id, round(total_seconds, 4) AS total_seconds, nullif(trim(error), '') AS error, CASE WHEN nullif(trim(error), '') IS NULL THEN NULL WHEN contains(lower(error), '429') OR contains(lower(error), 'too many requests') THEN 'rate_limit'
WHEN contains(lower(error), 'timeout') OR contains(lower(error), 'timed out') THEN 'timeout' ELSE 'api_error' END AS error_type FROM la""")
def answer_responses(spark, sf_dir):
    """Response records: rounded times, errors and their types."""
    return fusion.response(sessions.distinct_answers(read_table(spark, sf_dir, "answers"))).select("answer_id", "total_seconds", "error", "error_type")


@query(f"""WITH {_LAST} SELECT session_id, place, answer_id, question FROM (SELECT session_id, answer_id, question, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, answer_id DESC) AS place FROM la WHERE session_id IS NOT NULL) WHERE place <= 5""")
def history_last5(spark, sf_dir):
    """The newest five answers of each session."""
    return sessions.latest_history(read_table(spark, sf_dir, "answers"))


@query(f"WITH {_LAST} SELECT answer_id, question FROM la WHERE contains(replace(lower(question), 'ß', 'ss'), 'release record')")
def history_search(spark, sf_dir):
    """Answers whose question names the release record."""
    return sessions.search_questions(read_table(spark, sf_dir, "answers"), " Release Record ")


_CITED = "ci AS (SELECT answer_id, coalesce(s.number, i)::INTEGER AS number, s.source AS source, s.page AS page, s.chunk_id AS chunk_id FROM (SELECT answer_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS i FROM la))"


@query(f"WITH {_LAST}, {_CITED} SELECT * FROM ci")
def cited_sources(spark, sf_dir):
    """The sources of every answer."""
    return sessions.cited_sources(read_table(spark, sf_dir, "answers"))


@query(f"""WITH {_LAST}, {_CITED}, t AS (SELECT chunk_id, min(text) AS text FROM chunk WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
SELECT answer_id, number, ci.chunk_id FROM ci LEFT JOIN t USING (chunk_id) WHERE contains(replace(lower(coalesce(source, '') || chr(10) || coalesce(text, '')), 'ß', 'ss'), 'handbook')""")
def source_search(spark, sf_dir):
    """Cited sources whose name or text has the word handbook."""
    return sessions.search_sources(read_table(spark, sf_dir, "answers"), read_table(spark, sf_dir, "chunk"), "Handbook")


@query(f"""WITH {_LAST}, g AS (SELECT answer_id, coalesce(regexp_extract_all(regexp_replace(answer, '\\[[0-9, ]+\\]\\(', '', 'g'), '\\[([0-9]{{1,3}}(?:\\s*,\\s*[0-9]{{1,3}})*)\\]', 1), []) AS g,
  list_transform(coalesce(sources, []), lambda s, i: coalesce(s.number, i)::VARCHAR) AS known FROM la),
n AS (SELECT *, list_transform(g, lambda x: list_transform(string_split(x, ','), lambda y: trim(y))) AS gn FROM g)
SELECT answer_id, len(g) AS groups, len(list_filter(gn, lambda x: len(list_filter(x, lambda y: NOT list_contains(known, y))) = 0)) AS valid_groups, len(list_filter(list_distinct(flatten(gn)), lambda y: NOT list_contains(known, y))) AS dangling FROM n""")
def citation_groups(spark, sf_dir):
    """Citation groups of each answer, those that are valid, and numbers without a source."""
    return sessions.citation_report(read_table(spark, sf_dir, "answers"))


_GROUP = "\\[[0-9]{1,3}(?:\\s*,\\s*[0-9]{1,3})*\\]"
_NUMBERS = "list_transform(string_split(x[2:-2], ','), lambda y: trim(y))"


@query(f"""WITH {_LAST}, p AS (SELECT answer_id, string_split(regexp_replace(answer, '({_GROUP})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p, list_transform(coalesce(sources, []), lambda s, i: coalesce(s.number, i)::VARCHAR) AS known FROM la)
SELECT answer_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN regexp_full_match(x, '{_GROUP}') AND NOT starts_with(coalesce(p[i + 1], ''), '(') AND len(list_filter({_NUMBERS}, lambda n: NOT list_contains(known, n))) = 0
  THEN array_to_string(list_transform({_NUMBERS}, lambda n: '[[' || n || ']](#' || 'source-' || regexp_replace(answer_id::VARCHAR, '[^a-zA-Z0-9_-]', '-', 'g') || '-' || n || ')'), ' ') ELSE x END), '') AS linked FROM p""")
def linked_answers(spark, sf_dir):
    """Answers with links to their sources."""
    return sessions.linked_answers(read_table(spark, sf_dir, "answers"))


@query(f"WITH {_LAST} SELECT answer_id, array_to_string(list_sort(list_distinct(regexp_extract_all(translate(question, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[0-9]+(?:[.:][0-9]+)*'))), ' ') AS numbers FROM la WHERE question IS NOT NULL")
def number_refs(spark, sf_dir):
    """The numbers of every question."""
    return sessions.distinct_answers(read_table(spark, sf_dir, "answers")).where("question IS NOT NULL").select("answer_id", F.array_join(X.numbers(F.col("question")), " ").alias("numbers"))


@query(f"""WITH {_LAST} SELECT answer_id, regexp_matches(question, '[\\x{{0600}}-\\x{{06FF}}]') AS arabic, regexp_matches(regexp_replace(question, '\\P{{L}}', '', 'g'), '\\p{{Arabic}}') AS arabic_letters,
CASE WHEN regexp_matches(question, '[\\x{{0600}}-\\x{{06FF}}]') THEN '{fusion.INSUFFICIENT["ar"]}' ELSE '{fusion.INSUFFICIENT["en"]}' END AS message FROM la WHERE question IS NOT NULL""")
def question_languages(spark, sf_dir):
    """Arabic tests of every question, and the message for one without evidence."""
    q = F.col("question")
    return sessions.distinct_answers(read_table(spark, sf_dir, "answers")).where("question IS NOT NULL").select("answer_id", X.is_arabic(q).alias("arabic"), X.has_arabic_letter(q).alias("arabic_letters"), fusion.insufficient_message(q).alias("message"))


_FLAT = _strip(f"regexp_replace(question, '[{_B}]+', ' ', 'g')")


@query(f"WITH {_LAST}, f AS (SELECT answer_id, {_FLAT} AS q FROM la WHERE question IS NOT NULL) SELECT answer_id, CASE WHEN length(q) <= 62 THEN q ELSE {_strip('substr(q, 1, 61)')} || '…' END AS short FROM f")
def short_questions(spark, sf_dir):
    """Questions cut for display."""
    return sessions.distinct_answers(read_table(spark, sf_dir, "answers")).where("question IS NOT NULL").select("answer_id", X.short_text(F.col("question")).alias("short"))


@query(f"WITH {_LAST} SELECT answer_id, CASE WHEN isfinite(total_seconds) AND total_seconds >= 0 THEN round(total_seconds::VARCHAR::DECIMAL(18, 8), 2)::DECIMAL(18, 2)::VARCHAR || ' s' ELSE '—' END AS duration, CASE WHEN isfinite(evidence_score) AND evidence_score >= 0 THEN round(evidence_score::VARCHAR::DECIMAL(18, 8), 4)::DECIMAL(18, 4)::VARCHAR ELSE '—' END AS score FROM la")
def shown_figures(spark, sf_dir):
    """Times and scores as they are displayed."""
    return sessions.distinct_answers(read_table(spark, sf_dir, "answers")).select("answer_id", X.shown(F.col("total_seconds"), 2, " s").alias("duration"), X.shown(F.col("evidence_score"), 4).alias("score"))


@query(f"WITH {_LAST} SELECT answer_id, CASE WHEN regexp_extract(question, '\\p{{L}}') = '' THEN 'ltr' WHEN regexp_matches(regexp_extract(question, '\\p{{L}}'), '[\\p{{Hebrew}}\\p{{Arabic}}\\p{{Syriac}}\\p{{Thaana}}\\p{{Nko}}]') THEN 'rtl' ELSE 'ltr' END AS direction FROM la WHERE question IS NOT NULL")
def text_direction(spark, sf_dir):
    """Writing direction of every question."""
    return sessions.distinct_answers(read_table(spark, sf_dir, "answers")).where("question IS NOT NULL").select("answer_id", X.first_strong_direction(F.col("question")).alias("direction"))


@query("SELECT date_trunc('day', ingested_at)::TIMESTAMP AS day, coalesce(quality, 'unknown') AS quality, count(*) AS pages FROM pages WHERE ingested_at IS NOT NULL GROUP BY ALL")
def streamed_quality(spark, sf_dir):
    """Stored labels per day, counted by a stream over the page files."""
    import uuid

    from ..streaming.pages import page_stream, quality_by_day

    folder = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    stream = quality_by_day(page_stream(spark, f"{sf_dir}/pages.parquet"))
    # the whole result of each trigger takes the place of the one before, as a table
    table = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/table"))
    table.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table").select(F.col("day").cast("timestamp_ntz").alias("day"), "quality", "pages")
