import pytest
from pyspark.sql import functions as F

from paperloom.operators import chunking, extraction, fusion, lexical, sessions, sync, vectors

ATTEMPT = "source string, page int, stage_ord int, loader string, quality string, score int, reasons array<string>, error string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_best_candidate_ties_and_gaps(spark):
    df = spark.createDataFrame([("a", 1, 1, "pypdf", "suspicious", 60, [], None), ("a", 1, 2, "pymupdf", "suspicious", 60, [], None), ("a", 2, 1, "pypdf", "empty", 0, [], None), ("a", 3, 1, "pypdf", None, None, [], "broke"), (None, 1, 1, "pypdf", "good", 90, None, None)], ATTEMPT)
    assert rows(extraction.best_candidate(df)) == rows(spark.createDataFrame([("a", 1, 1, "pypdf", "suspicious", 60), (None, 1, 1, "pypdf", "good", 90)], "source string, page int, stage_ord int, loader string, quality string, score int"))
    assert rows(extraction.page_status(df), "page", "status") == [(1, "accepted"), (1, "rejected_low_quality"), (2, "failed_extraction"), (3, "failed_extraction")]
    blank = spark.createDataFrame([("a", 1), ("a", 2)], "source string, page int")
    assert ("blank" in {r["status"] for r in extraction.page_status(df, blank).where("source = 'a' AND page = 1").collect()})
    assert rows(extraction.attempt_errors(df).where("page = 3"), "error") == [("broke",)]


def test_file_rollup(spark):
    df = spark.createDataFrame([("t", 1, "accepted", "pypdf"), ("t", 2, "blank", None), ("m", 1, "accepted", "pymupdf"), ("m", 2, "accepted", "tesseract"), ("m", 3, "failed_extraction", None), ("n", 1, "rejected_low_quality", "pypdf")], "source string, page int, status string, loader string")
    assert rows(extraction.file_rollup(df), "source", "pdf_type", "file_status", "fallback") == [("m", "mixed", "partial", 2), ("n", "unknown", "failed", 0), ("t", "text", "success", 0)]
    assert extraction.file_rollup(df.limit(0)).count() == 0


def test_noise_edges(spark):
    body = [f"line {i} of the text" for i in range(20)]
    text = "\n".join(["12", *body[:3], "iv", *body[3:], "© ISO 2026 - All rights reserved", "ISO 19011:2026(en)"])
    out = chunking.without_noise(spark.createDataFrame([(text,), (None,), ("",)], "text string")).select("denoised", "noise_lines_removed").collect()
    assert out[0]["noise_lines_removed"] == 3 and "iv" in out[0]["denoised"].split("\n")  # fifth line is no edge
    assert [tuple(r) for r in out[1:]] == [("", 0), ("", 0)]


def test_splitter_invariants():
    text = "\n\n".join("Sentence number %d is here. " % i * (i % 5 + 1) for i in range(60))
    for size, overlap in ((800, 120), (100, 20), (50, 0)):
        pieces = chunking.split_text(text, size, overlap)
        assert pieces and all(0 < len(p) <= size for p in pieces)
        assert "".join(text.split()) in "".join("".join(pieces).split()) or overlap
    assert chunking.split_text("x" * 50, 20, 5) and all(len(p) <= 20 for p in chunking.split_text("x" * 50, 20, 5))


def test_join_short():
    assert chunking.join_short(["a", "b" * 150], 800) == ["a\n\n" + "b" * 150]
    assert chunking.join_short(["b" * 750, "a" * 99], 800) == ["b" * 750, "a" * 99]
    assert chunking.join_short(["b" * 150, "a"], 800) == ["b" * 150 + "\n\na"]
    assert chunking.join_short([" ", ""], 800) == []


def test_chunk_documents(spark):
    pages = spark.createDataFrame([("s", 1, "First page. " * 200), ("s", 1, "First page. " * 200), ("s", 2, "  "), (None, 3, "no source"), ("s", None, "no page")], "source string, page int, text string")
    out = chunking.chunk_documents(pages).collect()
    assert {r["page"] for r in out} == {1} and max(r["char_count"] for r in out) <= 800
    assert sorted(r["chunk_index"] for r in out) == list(range(1, len(out) + 1)) and len({r["chunk_id"] for r in out}) == len(out)
    with pytest.raises(ValueError):
        chunking.chunk_documents(pages, 10, 10)


def test_sync_plan(spark):
    new = spark.createDataFrame([("same", "h", "1"), ("newv", "h", "2"), ("newh", "h2", "1"), ("fresh", "h", "1")], "source string, source_hash string, pipeline_version string")
    old = spark.createDataFrame([("same", "h", "1"), ("newv", "h", "1"), ("newh", "h", "1"), ("gone", "h", "1"), ("kept", "h", "1")], "source string, source_hash string, pipeline_version string")
    present = spark.createDataFrame([(s,) for s in ("same", "newv", "newh", "fresh", "kept")], "source string")
    assert rows(sync.sync_plan(new, old, present)) == [("fresh", "ADD"), ("gone", "DELETE"), ("newh", "REPLACE"), ("newv", "REPROCESS"), ("same", "SKIP")]
    assert rows(sync.sync_plan(new.limit(0), old.limit(0), present)) == []


def test_audit_of_empty_and_broken(spark):
    schema = "chunk_id string, source string, page int, chunk_index int, text string, source_hash string, pipeline_version string, ocr_used boolean"
    assert sync.corpus_audit(spark.createDataFrame([], schema)).first()["status"] == "PASS"
    df = spark.createDataFrame([("x", "s", 0, 1, "t", "h", "1", True), ("x", "s", 1, 1, " ", None, "1", None)], schema)
    got = sync.corpus_audit(df).first()
    assert (got["status"], got["duplicate_ids"], got["empty_chunks"]) == ("FAIL", 1, 1)
    assert {r["violation"] for r in sync.chunk_violations(df).collect()} == {"invalid page", "chunk_id mismatch", "empty document"}


def test_bm25_by_hand(spark):
    import math

    df = spark.createDataFrame([("a", "audit plan"), ("b", "audit audit record"), ("c", "other words here"), ("d", "more other text"), ("e", None)], "chunk_id string, text string")
    got = {r["chunk_id"]: r["bm25_score"] for r in lexical.bm25_search(df, "the audit audit").collect()}
    avg = (2 + 3 + 2 + 3) / 4  # 'here' and 'more' are words, stopwords are not
    n = {r["chunk_id"]: len(r["terms"]) for r in lexical.tokenized(df, "chunk_id").collect()}
    avg = sum(n.values()) / 4
    idf = math.log(4 - 2 + 0.5) - math.log(2 + 0.5)
    every = [math.log(4 - d + 0.5) - math.log(d + 0.5) for d in _dfs(spark, df)]
    idf = 0.25 * sum(every) / len(every) if idf < 0 else idf
    for key, tf in (("a", 1), ("b", 2)):
        want = 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n[key] / avg))
        assert got[key] == pytest.approx(want, abs=1e-6)
    assert lexical.bm25_search(df, "the of").count() == 0


def _dfs(spark, df):
    return [r["n"] for r in lexical.tokenized(df, "chunk_id").select("chunk_id", F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()]


def test_exact_tokens():
    assert lexical.exact_tokens("The ＩＳＯ 9001:2015 Straße ٩.٢ كـتاب") == ["iso", "9001:2015", "strasse", "9.2", "كتاب"]


def test_fusion(spark):
    v = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.2), ("a", 3, 0.3)], "chunk_id string, rank int, distance double")
    b = spark.createDataFrame([("b", 1, 9.0), ("c", 2, 8.0)], "chunk_id string, rank int, bm25_score double")
    got = [tuple(r) for r in fusion.fuse(v, b).select("rank", "chunk_id", "vector_rank", "bm25_rank").orderBy("rank").collect()]
    assert got == [(1, "b", 2, 1), (2, "a", 1, None), (3, "c", None, 2)]
    assert fusion.search_stats(v, b.limit(0), v).first()["mode"] == "vector_only"
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            fusion.positive(bad, "k")


def test_gate_and_errors(spark):
    df = spark.createDataFrame([(0.05, "HTTP 429"), (0.0499, "read timed out"), (None, "odd"), (1.0, " ")], "s double, e string")
    got = df.select(fusion.evidence_passed(F.col("s")).alias("p"), fusion.error_type(F.col("e")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(True, "rate_limit"), (False, "timeout"), (False, "api_error"), (True, None)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0])], "vec_id bigint, embedding array<float>")
    assert rows(vectors.vector_search(df, [0.9, 0.0], k=2), "rank", "vec_id") == [(1, 2), (2, 3)]
    assert rows(vectors.nearest_for_all(df.where("vec_id = 1"), df, k=1), "query", "vec_id") == [(1, 2)]
    assert rows(vectors.dimension_report(df)) == [(1, 1), (2, 3), (None, 1)]


def test_history(spark):
    schema = "answer_id bigint, session_id string, created_at timestamp, received_at timestamp, question string, answer string, sources array<struct<number int, source string, page int, chunk_id string>>"
    import datetime as d

    t = lambda i: d.datetime(2030, 1, 1, 0, i)
    df = spark.createDataFrame([(i, "s", t(i), t(i), f"q{i}", "see [1] and [7]", [(1, "x", 1, "c")]) for i in range(7)] + [(6, "s", t(6), t(6), "q6", "see [1] and [7]", [(1, "x", 1, "c")])], schema)
    assert rows(sessions.latest_history(df), "place", "answer_id") == [(1, 6), (2, 5), (3, 4), (4, 3), (5, 2)]
    assert {tuple(r)[1:] for r in sessions.citation_report(df).collect()} == {(2, 1, 1)}
    assert sessions.latest_history(df.limit(0)).count() == 0


def test_session_index_is_made_once_and_again_when_its_files_are_gone(spark, data):
    from paperloom.plans import registry
    from paperloom.session import drop_written

    first = registry.text_index(spark, data, "documents", "doc_id")
    drop_written(spark)  # what a session keeps stays
    assert registry.text_index(spark, data, "documents", "doc_id") is first
    before = [tuple(r) for r in registry.QUERIES["bm25_topk"](spark, data).collect()]
    at = spark._jvm.org.apache.hadoop.fs.Path(first.postings.inputFiles()[0]).getParent()
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    again = registry.text_index(spark, data, "documents", "doc_id")
    assert again is not first and [tuple(r) for r in registry.QUERIES["bm25_topk"](spark, data).collect()] == before


def test_index_in_several_folders_finds_the_same(spark, data, monkeypatch):
    from paperloom.session import read_table

    tokens = lexical.tokenized(read_table(spark, data, "documents"), "doc_id")
    terms = ["audit", "plan", "audit", "the", "xyzzy"]
    found = []
    for size in (10**9, 500):
        monkeypatch.setattr(lexical, "BUCKET_TERMS", size)
        index = lexical.build_index(tokens, "doc_id")
        found.append((index.buckets, [tuple(r) for r in lexical.search_index(index, "doc_id", terms, k=20).collect()]))
    assert found[0][0] == 1 < found[1][0] and found[0][1] == found[1][1] and len(found[0][1]) == 20
