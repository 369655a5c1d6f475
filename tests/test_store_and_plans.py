import pytest

from paperloom.adapters import FirstBlockGenerator, HashEmbedder, checked_translation, embed_rows
from paperloom.plans import pipeline
from paperloom.plans.search import HybridSearcher, answer, settings_in_range
from paperloom.sources.files import changed_files, source_files
from paperloom.sources.store import ChunkStore

PAGE = "source string, page int, text string, source_hash string"


def page_rows(spark, *sources, hash_="h1"):
    return spark.createDataFrame([(s, 1, f"The {s} audit plan is kept. " * 10, hash_) for s in sources], PAGE)


def test_synchronise(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), pipeline.STORE_SCHEMA, parts=4)
    with pytest.raises(FileNotFoundError):
        store.guard()
    pages = page_rows(spark, "a", "b")
    present = pages.select("source")
    actions = lambda df: {r["source"]: r["action"] for r in df.collect()}
    assert actions(pipeline.synchronise(pages, present, store, dry_run=True)) == {"a": "ADD", "b": "ADD"} and not store.exists()
    pipeline.synchronise(pages, present, store)
    assert {r["source"] for r in store.read().collect()} == {"a", "b"}
    assert actions(pipeline.synchronise(pages, present, store)) == {"a": "SKIP", "b": "SKIP"}
    again = page_rows(spark, "a", hash_="h2")
    assert actions(pipeline.synchronise(again, again.select("source"), store)) == {"a": "REPLACE", "b": "DELETE"}
    assert {(r["source"], r["source_hash"]) for r in store.read().collect()} == {("a", "h2")}
    assert store.of_source("a").count() == store.read().count() and store.of_source("b").count() == 0
    with pytest.raises(RuntimeError):
        pipeline.synchronise(again.limit(0), again.limit(0).select("source"), store)


def test_synchronise_embeds_new_rows(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), pipeline.EMBEDDED_SCHEMA, parts=2)
    pages, embedder = page_rows(spark, "a", "b"), HashEmbedder(16)
    pipeline.synchronise(pages, pages.select("source"), store, embedder=embedder)
    rows = store.read().collect()
    assert rows and all(r["embedding_model"] == "hash-16" and len(r["embedding"]) == 16 for r in rows)
    hits = HybridSearcher(store.read(), embedder).search("audit plan", 2, 5).collect()
    assert hits and hits[0]["vector_rank"] is not None

    class Fails(HashEmbedder):
        def documents(self, texts):
            raise RuntimeError("no service")

    again = page_rows(spark, "a", "b", hash_="h2")
    with pytest.raises(Exception, match="no service"):
        pipeline.synchronise(again, again.select("source"), store, embedder=Fails(16))
    assert {r["source_hash"] for r in store.read().collect()} == {"h1"}


def test_store_writes(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), "chunk_id string, source string, text string", parts=2)
    rows = spark.createDataFrame([("1", "a", "x"), ("2", "a", "y")], "chunk_id string, source string, text string")
    assert store.insert_absent(rows) == 2 and store.insert_absent(rows) == 0
    store.upsert(spark.createDataFrame([("2", "a", "z"), ("3", "b", "w")], "chunk_id string, source string, text string"))
    assert sorted((r["chunk_id"], r["text"]) for r in store.read().collect()) == [("1", "x"), ("2", "z"), ("3", "w")]
    store.replace_source("a", spark.createDataFrame([("9", "a", "n")], "chunk_id string, source string, text string"))
    assert sorted(r["chunk_id"] for r in store.read().collect()) == ["3", "9"]
    assert store.delete_sources(spark.createDataFrame([("b",)], "source string")) == 1
    for bad in ([("1", "a", " ")], [("1", "a", "x"), ("1", "a", "x")]):
        with pytest.raises(RuntimeError):
            store.upsert(spark.createDataFrame(bad, "chunk_id string, source string, text string"))


ROWS = "chunk_id string, source string, text string"


def test_a_lost_writer_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "s"), ROWS, parts=2)
    store.upsert(spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], ROWS))
    rows = lambda: sorted((r["chunk_id"], r["text"]) for r in store.read().collect())
    before = rows()

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # between the data and the list
        m.setattr(store, "_write_list", dies)
        with pytest.raises(KeyboardInterrupt):
            store.replace_source("a", spark.createDataFrame([("9", "a", "n")], ROWS))
    assert rows() == before and store.exists()
    (tmp_path / "s" / "state" / "000000000002.json").write_text('{"parts": 2, "fold')  # within the list
    again = ChunkStore(spark, str(tmp_path / "s"), ROWS, parts=2)
    assert rows() == before and again.exists()
    (tmp_path / "s" / "state" / "000000000002.json").unlink()
    store.replace_source("a", spark.createDataFrame([("9", "a", "n")], ROWS))
    assert rows() == [("2", "y"), ("9", "n")]


def test_of_two_writers_the_second_is_refused(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), ROWS, parts=2)
    store.upsert(spark.createDataFrame([("1", "a", "x")], ROWS))
    other = ChunkStore(spark, str(tmp_path / "s"), ROWS)

    def meanwhile(rows):
        other.upsert(spark.createDataFrame([("5", "c", "z")], ROWS))
        return rows

    with pytest.raises(RuntimeError, match="another writer"):
        store.replace_sources(spark.createDataFrame([("2", "a", "y")], ROWS), embed=meanwhile)
    assert sorted(r["chunk_id"] for r in store.read().collect()) == ["1", "5"]
    with pytest.raises(RuntimeError, match="another writer"):
        store._write_list(1, 2, {})


def test_a_store_that_grows_is_laid_out_anew(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), ROWS, parts=1, part_bytes=1500)
    for n in range(3):
        store.upsert(spark.createDataFrame([(f"{n}-{i}", f"s{i}", "x" * 50) for i in range(20)], ROWS))
    assert store.read().count() == 60 and store.parts > 1 and store.of_source("s7").count() == 3
    used = {v.split("/")[0] for _, state in store._versions() for v in state["folders"].values()}
    assert len(store._versions()) <= 2 and used


def test_source_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    (tmp_path / "sub").mkdir()
    files = source_files(spark, str(tmp_path))
    import hashlib

    assert [(r["source"], r["source_hash"]) for r in files.collect()] == [("a.pdf", hashlib.sha256(b"one").hexdigest())]
    states = files.select("source", "source_hash").selectExpr("*", "'2' AS pipeline_version")
    assert changed_files(files, states, "2").count() == 0 and changed_files(files, states, "3").count() == 1


def test_ingest_folder(spark, tmp_path):
    from paperloom.operators.cascade import FormFeedText, extract_pages

    class Fallback(FormFeedText):
        def page_text(self, content, page):
            return "The second reader found the audit plan of the site on this page."

    good = "The audit plan is kept by the lead of the site. " * 4
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_text(f"{good}\f\f{good}")
    (tmp_path / "docs" / "b.pdf").write_bytes(b"\xff\xfe")
    readers = [FormFeedText(), Fallback("pymupdf")]
    attempts = extract_pages(source_files(spark, str(tmp_path / "docs")), readers).collect()
    assert sorted((r["page"], r["loader"]) for r in attempts) == [(1, "pypdf"), (2, "pymupdf"), (2, "pypdf"), (3, "pypdf")]
    store = ChunkStore(spark, str(tmp_path / "store"), pipeline.STORE_SCHEMA, parts=2)
    actions = lambda df: {r["source"]: r["action"] for r in df.collect()}
    assert actions(pipeline.ingest(spark, str(tmp_path / "docs"), readers, store)) == {"a.pdf": "ADD"}
    assert store.read().select("page").distinct().count() == 3
    assert actions(pipeline.ingest(spark, str(tmp_path / "docs"), readers, store)) == {"a.pdf": "SKIP"}
    (tmp_path / "docs" / "a.pdf").write_text(good)
    assert actions(pipeline.ingest(spark, str(tmp_path / "docs"), readers, store)) == {"a.pdf": "REPLACE"}
    assert {r["page"] for r in store.read().collect()} == {1}


def test_unreadable_files_do_not_stop_an_ingestion(spark, tmp_path):
    from paperloom.operators.cascade import FormFeedText
    from paperloom.sources.files import failed_files, listed_files

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_text("The audit plan is kept by the lead of the site. " * 4)
    (tmp_path / "docs" / "b.pdf").write_text("x" * 5000)
    store = ChunkStore(spark, str(tmp_path / "store"), pipeline.STORE_SCHEMA, parts=2)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        folder = str(tmp_path / "docs")
        failed = failed_files(listed_files(spark, folder), source_files(spark, folder)).collect()
        assert [(r["source"], r["error"]) for r in failed] == [("b.pdf", "SHA-256 failed: the file is too long")]
        plan = pipeline.ingest(spark, folder, [FormFeedText()], store)
        assert {r["source"]: r["action"] for r in plan.collect()} == {"a.pdf": "ADD", "b.pdf": "FAILED"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_blank_check_errors(spark):
    from paperloom.operators.cascade import blank_checks
    from paperloom.operators.extraction import NO_TEXT, attempt_errors

    rows = [("a", 1, 2, 2, bytearray(b"1234")), ("a", 2, 2, 2, bytearray(b"123")), ("a", 3, None, None, None)]
    checks = blank_checks(spark.createDataFrame(rows, "source string, page int, width int, height int, pixels binary"))
    attempts = spark.createDataFrame([("a", p, 1, e) for p, e in ((1, None), (2, " "), (3, None), (4, "broken"), (2, None))], "source string, page int, stage_ord int, error string")
    got = {r["page"]: r["error"] for r in attempt_errors(attempts, checks=checks).collect()}
    assert got == {1: NO_TEXT, 2: "Visual blank-page check failed: the image has another size than stated", 3: "Visual blank-page check failed: no image", 4: "broken"}


def test_blank_pages(spark):
    from paperloom.operators.cascade import blank_pages

    white, dark = bytes([255] * 10000), bytes([255] * 9000 + [0] * 1000)
    rows = [("a", 1, 100, 100, bytearray(white)), ("a", 2, 100, 100, bytearray(dark)), ("a", 3, 100, 99, bytearray(white)), ("a", 4, None, None, None)]
    images = spark.createDataFrame(rows, "source string, page int, width int, height int, pixels binary")
    assert [tuple(r) for r in blank_pages(images).collect()] == [("a", 1)]


def test_answer(spark):
    rows = spark.createDataFrame([(f"c{i}", "s", i, t) for i, t in enumerate(["The audit plan is kept by the lead.", "Calibration takes ten days.", "Other words stand here."])], "chunk_id string, source string, page int, text string")
    corpus = embed_rows(rows, HashEmbedder(32)).cache()
    got = answer("Who keeps the audit plan?", HybridSearcher(corpus, HashEmbedder(32)), FirstBlockGenerator(), k=3, candidates=10)
    assert got["evidence_passed"] and got["answer"].endswith("[1]") and got["sources"][0]["chunk_id"] == "c0"
    searcher = HybridSearcher(corpus, HashEmbedder(32))
    first, index = [tuple(r) for r in searcher.search("audit plan").collect()], searcher.index
    assert [tuple(r) for r in searcher.search("audit plan").collect()] == first and searcher.index is index and len(first) == 3
    with pytest.raises(RuntimeError):
        HybridSearcher(corpus, HashEmbedder(16)).search("audit plan")
    none = answer("zebra giraffe", HybridSearcher(corpus, HashEmbedder(32)), FirstBlockGenerator(), candidates=10)
    assert not none["evidence_passed"] and none["sources"] == []


def test_adapters():
    assert checked_translation("plain", None) == "plain"
    assert checked_translation("بند ٩.٢", lambda t: "clause 9.2") == "clause 9.2"
    for bad in ("clause 9.3", "بند 9.2", "9.2"):
        with pytest.raises(ValueError):
            checked_translation("بند ٩.٢", lambda t: bad)
    assert settings_in_range() == (5, 20)
    with pytest.raises(ValueError):
        settings_in_range(10, 5)


def test_drop_written(spark):
    from paperloom.session import drop_written, written

    drop_written(spark)
    df = written(spark.range(3), "t")
    assert df.count() == 3 and drop_written(spark) == 1 and drop_written(spark) == 0


def test_rerank_results_are_checked(spark):
    from paperloom.operators import fusion

    hits = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "chunk_id string, rank int")
    of = lambda *rows: spark.createDataFrame(list(rows), "index int, rerank_score double")
    out = fusion.reranked(fusion.checked_results(hits, of((0, 0.1), (1, 0.9), (2, 0.1))), n=2).collect()
    assert [(r["rank"], r["chunk_id"], r["hybrid_rank"]) for r in out] == [(1, "b", 2), (2, "a", 1)]
    for bad in ([(0, 0.1), (1, 0.9), (3, 0.1)], [(0, 0.1), (1, 0.9), (1, 0.1), (2, 0.3)], [(0, 0.1), (1, 0.9)]):
        with pytest.raises(RuntimeError):
            fusion.checked_results(hits, of(*bad))


def test_vectors_of_several_lengths(spark):
    from paperloom.operators.vectors import nearest_for_all

    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 5.0]), (3, [1.0, 1.0, 1.0]), (4, [1.0, 1.0, 2.0]), (5, None), (6, []), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query"], r["rank"]): (r["vec_id"], r["distance"]) for r in nearest_for_all(df, df, k=2).collect()}
    assert got[0, 1] == (7, 0.0) and got[0, 2] == (1, 1.0) and got[3, 1] == (4, 1.0) and (3, 2) not in got and (5, 1) not in got
    assert got == {(r["query"], r["rank"]): (r["vec_id"], r["distance"]) for r in nearest_for_all(df, df, k=2, sent_bytes=40).collect()}


def test_cached_translation():
    from paperloom.adapters import CachedTranslator

    class Counting:
        asked = 0

        def translate(self, text):
            self.asked += 1
            return text.upper()

    inner = Counting()
    cached = CachedTranslator(inner)
    assert [cached.translate("x"), cached.translate("x"), cached.translate("y")] == ["X", "X", "Y"] and inner.asked == 2


def test_registry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
