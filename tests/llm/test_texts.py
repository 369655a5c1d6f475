import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm import bisect_split, leak_scan, mixing, ocr_repair, quality_stats, site_lines, spam_pages, vectext


def test_cuts_cover_and_fit():
    r = random.Random(3)
    for n in (0, 1, 5, 400, 5000):
        text = "".join(r.choice("ab c.\n,é") for _ in range(n))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for limit, overlap in ((50, 10), (800, 120), (1, 0), (7, 3)):
            found = bisect_split.cuts(codes, limit, overlap)
            assert [a for a, _ in found] == [0] + [b for _, b in found[:-1]] and found[-1][1] == n
            assert all(b - max(0, a - overlap) <= limit for a, b in found)


def test_cut_at_paragraphs():
    text = "First part of it. More.\n\nSecond part of it. More."
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    assert bisect_split.cuts(codes, 30, 0)[0] == (0, text.index("Second"))


def test_split_cases(spark):
    rows = [("a", "x" * 10, 10, 2), ("b", "x" * 11, 10, 2), ("b", "x" * 11, 10, 2), ("c", "y" * 801, None, None), ("d", None, 5, 1), ("e", "", 5, 1), ("f", "abc", 0, -1), (None, "z" * 30, 10, 50)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, chunk_size int, chunk_overlap int").withColumn("piece", F.lit("clash"))
    out = bisect_split.split_oversized(df).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["piece"]):
        got[r["chunk_id"]].append(r["text"])
    assert got["a"] == ["x" * 10] and got["e"] == [""] and "d" not in got and got["f"] == ["a", "b", "c"]
    assert len(got["b"]) == 2 and all(len(t) <= 10 for t in got["b"]) and sum(map(len, got["b"])) == 13
    assert sum(map(len, got["c"])) == 801 + 120 and all(len(t) <= 10 for t in got[None])


def test_overlaps_up_to_the_limit(spark):
    text = "One two three. Four five six, seven eight. " * 3
    df = spark.createDataFrame([("a", text, 20, 19), ("b", text, 20, 15), ("c", text, 20, 99)], "chunk_id string, text string, chunk_size int, chunk_overlap int")
    got = defaultdict(list)
    for r in sorted(bisect_split.split_oversized(df).collect(), key=lambda r: r["piece"]):
        got[r["chunk_id"]].append((r["start"], r["end"], r["text"]))
    for key, overlap in (("a", 19), ("b", 15), ("c", 19)):
        pieces = got[key]
        assert pieces[-1][1] == len(text) and all(len(t) <= 20 and t == text[a:b] for a, b, t in pieces)
        assert all(y[0] == max(0, x[1] - overlap) and y[1] > x[1] for x, y in zip(pieces, pieces[1:]))


def comparable(line):
    return re.sub(r"[0-9]+", "#", re.sub(r"[ \t\r]+", " ", line.lower()).strip(" "))


def test_site_lines_against_brute_force(spark):
    r = random.Random(5)
    notices = ["© Press 2030 - rights", "Ed", "Part 7 of 9", "12 34", "Share\tthis  page", "x"]
    rows = []
    for i in range(400):
        body = [" ".join(r.choice("abcdefgh") * r.randrange(1, 6) for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(0, 5))]
        lines = body + [n for n in notices if r.random() < 0.15]
        r.shuffle(lines)
        rows.append((f"k{i}", r.choice(["s", "s", "t", None]), "\n".join(lines)))
    rows += [(f"u{i}", "small", "only line") for i in range(7)] + [(f"v{i}", "eight", "only line 5") for i in range(8)] + [("k0", "s", rows[0][2])] * 3 + [("n", "s", None), (None, "s", "Ed")]
    df = spark.createDataFrame(rows, "chunk_id string, source string, text string").withColumn("line", F.lit("clash")).withColumn("piece", F.lit(1))
    docs, seen = defaultdict(set), defaultdict(set)
    for k, s, t in rows:
        if k is None or s is None:
            continue
        docs[s].add(k)
        for line in (t or "").split("\n"):
            if t is not None:
                seen[s, comparable(line)].add(k)
    want = {(s, x) for (s, x), k in seen.items() if len(k) >= 8 and 10 * len(k) >= len(docs[s]) and re.search(r"[^\W\d_]", x)}
    found = site_lines.repeated_lines(df)
    assert {(r["source"], r["line"]) for r in found.collect()} == want and ("eight", "only line #") in want
    cleaned = {(r["chunk_id"], r["source"]): r for r in site_lines.remove_repeated_lines(df, found).where("chunk_id LIKE 'v%'").collect()}
    assert all(r["text"] == "" and r["removed"] == 1 for r in cleaned.values()) and len(cleaned) == 8
    assert site_lines.repeated_lines(df.limit(0)).count() == 0


def test_notices_are_cut_inside_lines(spark):
    notice = "© North Press 2030. All rights are kept by us"
    lines = spark.createDataFrame([("s", comparable(notice)), ("s", "ed"), ("t", comparable(notice)), (None, "x")], "source string, line string")
    rows = [
        ("1", "s", f"A first line.\n{notice}\nA last line."), ("2", "s", f"Before it. {notice.upper().replace('2030', '7')} After it, Ed and more.\nEd"), ("3", "s", f"x{notice[2:]}y\n\nEd \n"),
        ("4", "u", notice), ("5", "s", None), ("6", None, notice), ("7", "s", ""), ("8", "s", f"{notice}\n {notice} "), ("2", "s", "Ed\nshort"), ("2", "s", "Ed\nshort"), ("2", "s", "short"), ("9", "t", f"Read: {notice}"),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, source string, text string").withColumn("lines", F.lit("clash")).withColumn("removed", F.lit(9))
    got = sorted(map(tuple, site_lines.remove_repeated_lines(df, lines).collect()), key=str)
    want = [
        ("1", "s", "A first line.\nA last line.", 1), ("2", "s", "Before it.  After it, Ed and more.", 2), ("3", "s", f"x{notice[2:]}y", 1), ("4", "u", notice, 0), ("5", "s", None, 0), ("6", None, notice, 0),
        ("7", "s", "", 0), ("8", "s", "", 2), ("2", "s", "short", 1), ("2", "s", "short", 0), ("9", "t", "Read: ", 1),
    ]
    assert got == sorted(want, key=str)
    assert site_lines.remove_repeated_lines(df, lines.limit(0)).where("removed > 0").count() == site_lines.remove_repeated_lines(df.limit(0), lines).count() == 0


def test_leaks_against_brute_force(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(5, 40)))) for i in range(20)] + [(99, None), (98, "")]
    docs = []
    for i in range(120):
        text = [r.choice(words) for _ in range(r.randrange(0, 900))]
        if r.random() < 0.6:
            w = items[r.randrange(20)][1].split()
            n = r.choice((11, 12, 13, 14, len(w)))
            a = r.randrange(max(1, len(w) - n + 1))
            text[r.randrange(len(text) + 1) : 0] = [x.upper() + r.choice(("", ",", " -", "\n")) for x in w[a : a + n]]
        docs.append((i, " ".join(text)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    runs = lambda t: {tuple(w[k : k + 13]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for k in range(len(w) - 12)}
    want = {(d, i) for d, x in docs for i, y in items if runs(x) & runs(y)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    assert {(r["doc_id"], r["item_id"]) for r in leak_scan.leaks(df, it).collect()} == want and want
    assert {(r["doc_id"], r["item_id"]) for r in leak_scan.leaks(df, it, block_words=80).collect()} == want
    assert leak_scan.leaks(df, it.limit(0)).count() == leak_scan.leaks(df.limit(0), it).count() == 0


def test_mixing(spark):
    docs = spark.createDataFrame([(i, s, ("term " if s == "b" else "word ") * 10) for i, s in enumerate(["a"] * 5 + ["b"] * 5 + [None] * 2)] + [(90, "a", None), (91, "a", "")], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 3.0, 2), ("b", 3.0, 2), ("c", 0.1, 5), ("d", None, 1), (None, 1.0, 1)], "source string, weight double, max_repeat int")
    # T = 100, W = 4.1: targets 24.4, 73.2, 2.4; held 50, 50, 0
    assert {r["source"] for r in mixing.short_sources(docs, targets).collect()} == {"c"}
    report = {r["source"]: r for r in mixing.mixture_report(docs, targets).collect()}
    assert abs(report["a"]["reached"] - 100 / 4.1) < 0.1 and abs(report["b"]["reached"] - 300 / 4.1) < 0.1 and report["c"]["short"]
    copies = mixing.mixed_documents(docs, targets).where("source = 'b'").agg(F.max("copies")).first()[0]
    assert copies in (None, 1)  # five copies of one text share a cap of two
    assert mixing.short_sources(docs, targets.limit(0)).count() == mixing.mixed_documents(docs.limit(0), targets).count() == 0


def test_fit_reaches_soft_targets(spark):
    groups = spark.createDataFrame([(True, [0 * 32 + 16], 5.0, 100), (False, [0 * 32 + 8, 1 * 32 + 8], 5.0, 100), (True, [1 * 32 + 16], 1.0, 10)], "own boolean, member array<int>, cap double, size bigint")
    fit = mixing.fit_rates(groups, np.array([120.0, 60.0]))
    assert np.allclose(fit.reached, [120, 60], rtol=0.02) and (fit.own <= fit.reached).all() and fit.own[1] <= 10
    rates = {tuple(r["member"]): r["rate"] for r in fit.groups.collect()}
    assert abs(rates[(16,)] * 100 + rates[(8, 40)] * 50 - fit.reached[0]) < 0.1 and max(rates.values()) <= 5


def test_classifier_on_held_out_rows(spark):
    r = random.Random(2)
    make = lambda s: " ".join(r.choice([f"{s}{i}" for i in range(40)] + ["and", "the"]) for _ in range(50))
    train = spark.createDataFrame([(i, s, make(s)) for i, s in enumerate("ab" * 60)], "doc_id bigint, source string, text string")
    model = mixing.train_classifier(train, ["a", "b"], 80)
    post = model.posteriors(pa.array([make("a"), make("b"), None]))
    assert post[0, 0] > 0.9 and post[1, 1] > 0.9 and abs(post[2].sum() - 1) < 1e-9


def test_spam(spark):
    prose = "The audit lead reviews the plan before each shift, so that nobody relies on memory. " * 4
    rows = [
        (1, prose, "a"), (2, "cheap audit, cheap audit, " * 10, "a"), (3, "\n".join(f"http://x{i}.example/a" for i in range(9)), "b"), (4, "#plan #audit #lead\n" * 5, "b"),
        (5, "- plan for the lead\n- note of a site\n- form with a sign\n- shift of the group\n", "b"), (6, "cheap cheap", "a"), (7, None, "a"), (8, "", None), (9, prose + "See https://x.example/a", "c"),
        (10, " | ".join(f"item {i} word" for i in range(15)), None), (2, "cheap audit, cheap audit, " * 10, "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("words", F.lit("clash")).withColumn("host", F.lit(1))
    assert sorted(r["doc_id"] for r in spam_pages.spam_pages(df).collect()) == [2, 3, 4, 10]
    assert spam_pages.spam_pages(df.limit(0)).count() == 0


def test_keywords_dressed_as_sentences(spark):
    stuffed = lambda k: f"Order {k}, {k} offers, new {k}. {k}? {k}! Our {k} is the {k} of all. " * 6
    prose = "Teams that compare their plan early rarely need to update a record later. The lead of the site keeps the record in the hall. "
    long = " ".join(f"Form {i} lists which record the lead of site {i % 7} may update without the plan of group {i % 11}." for i in range(60))
    rows = [(1, stuffed("cheap audit plan"), "a"), (2, prose, "a"), (3, long, "b"), (4, prose + stuffed("audit plan"), "b"), (5, prose * 3 + "Our plan. Our plan.", None)]
    got = {r["doc_id"]: r for r in spam_pages.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert sorted(got) == [1, 4] and got[1]["listed"] > 0.6 * got[1]["words"]


def test_short_stretches_have_phrases(spark):
    # labels of three words, each on three hosts: shingles go over the ends of the lines
    labels = "\n".join(f"a{i} b{i} c{i}" for i in range(8))
    rows = [(i, f"{labels}\nonly here{i}", f"h{i}") for i in range(3)]
    got = spam_pages.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted((r["doc_id"], r["replicated"], r["carried"]) for r in got) == [(i, 25, 25) for i in range(3)]


def test_replicated_phrases(spark):
    phrase = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{phrase} u{i} v{i}", f"h{i}") for i in range(3)] + [(9, " ".join(f"z{i}" for i in range(30)), "h1")]
    found = spam_pages.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 1, 2]
    copies = spark.createDataFrame([(i, phrase, f"h{i}") for i in range(3)], "doc_id bigint, text string, source string")
    assert spam_pages.spam_pages(copies).count() == 0  # copies of one page do not vouch for each other


COMMON = [("en", w) for w in "the of and to in a is that for it as was with be by on not this are before each so".split()]


def common(spark):
    return spark.createDataFrame([*COMMON, ("en", None)], "lang string, word string")


def test_page_profiles(spark):
    prose = "The audit lead reviews the plan before each shift, so that it is\nkept in the form of a note and not in the mind of a person.\n" * 4
    rows = [
        ("s", 1, prose), ("s", 2, "\n".join(f"- check of plan {i}" for i in range(9))), ("s", 3, "\n".join(f"a{i} | {i} % | n/a" for i in range(9))), ("s", 4, "1.1 Plan ........ 12\n" * 6),
        ("s", 5, "{!<>}#^~|\\=%&*\n" * 6), ("s", 6, None), ("s", 7, " \n "), ("s", 1, prose), (None, 8, "\n".join("xqz kvbw ptrw lmnq zzk wqp" for _ in range(6))), ("s", 9, "\r\n".join(prose.split("\n"))),
    ]
    df = spark.createDataFrame(rows, "source string, page int, text string").withColumn("profile", F.lit("clash"))
    assert sorted((r["page"] for r in quality_stats.structured_pages(df, common(spark)).collect())) == [2, 3, 4, 5, 8]
    stats = {r["page"]: r for r in quality_stats.page_statistics(df, common(spark)).collect()}
    assert stats[6]["profile"] == stats[7]["profile"] == "empty" and stats[1]["words"] == len(prose.split()) and stats[1]["lines"] == 8
    assert stats[1]["punctuated_lines"] == 0.5 and stats[9]["words"] == stats[1]["words"]
    assert quality_stats.page_statistics(df.limit(0), common(spark)).count() == 0


def test_divergence_decides_the_profile(monkeypatch):
    """Each kind of line goes to its own profile; without divergences every line would be prose."""
    text = "\n".join([*(f"- check of plan {i}" for i in range(4)), *(f"a{i} | {i} % | n/a" for i in range(4)), *("1.1 Plan ........ 12",) * 4, "{!<>}#^~|\\=%&*", "The lead of the site keeps the record in the hall of the group."])
    words = quality_stats.word_keys([w for _, w in COMMON])
    assert quality_stats.read_lines(pa.array([text]), words).kinds.tolist() == [1] * 4 + [3] * 4 + [2] * 4 + [4, 0]
    monkeypatch.setattr(quality_stats, "divergence", lambda rows, *_: np.full(len(rows), 0.5))
    assert not quality_stats.read_lines(pa.array([text]), words).kinds.any()


def test_divergence():
    a, b = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.0, 1.0])
    assert np.isclose(quality_stats.divergence(a, b), 1.0) and np.isclose(quality_stats.divergence(a, a[0]), 0.0)


def test_repair(spark):
    sentence = "The calibration technician reviews the training matrix of the packing hall before each shift so that the decision is kept in the record"
    words = sentence.split()
    r = random.Random(4)
    rows = []
    for p in range(1, 61):
        body = [" ".join(r.sample(words, len(words))) + "." for _ in range(6)]
        rows.append(("north_audit_guide_01.pdf", p, "\n".join([f"North Audit Guide | {p}", *body])))
    rows[4] = (*rows[4][:2], rows[4][2] + "\nThe calibrati0n of the rccord is kept by the tech-\nnician in the hall of the cross-\nfunctional group.")
    rows[5] = (*rows[5][:2], rows[5][2] + "\nThe cross-functional group is in the hall before each cross-functional shift.")
    rows += [(None, None, None), ("x", 1, ""), rows[4], ("y", 2, "\n".join("{!<>}#^~|\\=%&*" for _ in range(6)))]
    df = spark.createDataFrame(rows, "source string, page int, text string").withColumn("kind", F.lit("clash")).withColumn("id", F.lit(7))
    got = {(r["page"], r["kind"], r["item"]) for r in ocr_repair.found_noise(df, common(spark)).collect()}
    assert {x for x in got if x[1] == "mended"} == {(5, "mended", "calibration"), (5, "mended", "record"), (5, "mended", "technician"), (5, "mended", "cross-functional")}
    lines = {x[2] for x in got if x[1] == "line"}
    assert len(lines & {f"North Audit Guide | {p}" for p in range(1, 61)}) >= 58 and len(lines) <= 60
    assert ocr_repair.found_noise(df.limit(0), common(spark)).count() == 0


def test_editor_turns_candidates_down(spark):
    """Frequent words stay; of rare ones that share the strokes of a frequent word only misreadings are mended."""
    plain = "contract record which calibration early closing review training matrix without someone deputy matter check visit file all au an the".split()
    editor = ocr_repair.train_editor([(w, 500) for w in plain] * 4)
    sent = spark.sparkContext.broadcast(editor)
    counts = {w: 4000 for w in plain} | {"the": 90_000, "an": 9000, "file": 3000, "all": 700, "au": 170, "wbich": 5, "chcck": 3, "rec0rd": 2, "fi1e": 1, "ehoek": 2, "tlie": 3, "fiie": 1}
    known = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r["word"]: r["right"] for r in ocr_repair._misread(known, sent).collect()}
    assert got == {"wbich": "which", "chcck": "check", "rec0rd": "record", "fi1e": "file", "tlie": "the", "fiie": "file"}
    skeletons = {r["word"]: r["s"] for r in known.select("word", ocr_repair.skeleton(F.col("word")).alias("s")).collect()}
    assert skeletons["file"] == skeletons["the"] and skeletons["all"] == skeletons["an"]  # the counts alone would mend them
    margins = ocr_repair.edit_margin(editor.model, ["review", "check", "matter", "wbich"], ["revicw", "cbeck", "mattcr", "which"])
    assert (margins[:3] < editor.threshold).all() and margins[3] > editor.threshold


def test_editor_prefers_misreadings():
    words = [(w, 100) for w in "calibration technician reviews training matrix packing before decision record shift".split()] * 8
    editor = ocr_repair.train_editor(words).model
    margin = ocr_repair.edit_margin(editor, ["calibrati0n", "rccord", "rccord"], ["calibration", "record", "matrix"])
    assert margin[0] > 0 and margin[1] > -20 and margin[2] == -np.inf


def test_repaired_pages(spark):
    sentence = "The calibration technician reviews the training matrix of the packing hall before each shift so that the decision is kept in the record"
    words = sentence.split()
    r = random.Random(4)
    rows = []
    for p in range(1, 61):
        body = [" ".join(r.sample(words, len(words))) + "." for _ in range(6)]
        rows.append(("north_audit_guide_01.pdf", p, "\n".join([f"North Audit Guide | {p}", *body])))
    last = "The Calibrati0n of the (rccord) is kept by the tech-\r\nnician, and it is kept in the hall of the cross-\nfunctional group as it\nis.\n\n8.5 Control of records\nThe decision is in the record."
    rows[4] = (*rows[4][:2], rows[4][2] + "\n\n" + last)
    rows[5] = (*rows[5][:2], rows[5][2] + "\nThe cross-functional group is in the hall before each cross-functional shift.")
    junk = "\n".join("{!<>}#^~|\\=%&*" for _ in range(6))
    listed = "\n".join(f"- check of plan {i}" for i in range(9))
    rows += [(None, None, None), ("x", 1, ""), rows[4], ("y", 2, junk), ("z", 3, listed)]
    df = spark.createDataFrame(rows, "source string, page int, text string").withColumn("kind", F.lit("clash")).withColumn("id", F.lit(7))
    out = ocr_repair.repaired_pages(df, common(spark)).collect()
    got = {(x["source"], x["page"]): x["text"] for x in out}
    assert len(out) == len(got) == 64 and got[None, None] is None and got["x", 1] == "" and got["y", 2] == junk and got["z", 3] == listed
    page = got["north_audit_guide_01.pdf", 5].split("\n\n")
    assert page[-3] == "The Calibration of the (record) is kept by the technician, and it is kept in the hall of the cross-functional group as it is."
    assert page[-2:] == ["8.5 Control of records", "The decision is in the record."]
    assert sum("North Audit Guide" in (t or "") for t in got.values()) <= 2
    assert ocr_repair.repaired_pages(df.limit(0), common(spark)).count() == 0


def test_line_ends():
    text = "A first line of the text that is as wide as it\ngets, and the end.\nA new paragraph of the same page begins here and\n\n7\n\ngoes on after the number of\nthe page."
    lines = quality_stats.read_lines(pa.array([text]), quality_stats.word_keys(["the", "of", "a", "that", "is"]))
    kept, ends = ocr_repair.kept_lines(lines, np.zeros(1, int), np.array([lines.text(i) == "7" for i in range(len(lines.starts))]))
    assert ocr_repair.rebuilt(kept[0], ends[0], {}, {}) == "A first line of the text that is as wide as it gets, and the end.\n\nA new paragraph of the same page begins here and goes on after the number of the page."


def test_phrases_of_all_pages_count_their_hosts(spark):
    bits = [" ".join(f"p{k}x{i}" for i in range(8)) for k in range(12)]
    lone = "\n".join(bits)
    prose = lambda k: f"The lead wrote that {bits[2 * k]} and {bits[2 * k + 1]} were kept in the record of the site. " * 2
    links = "\n".join(f"http://x{i}.example/a" for i in range(60))
    rows = [(1, lone, "h0"), (2, "\n".join(" ".join(f"q{k}y{i}" for i in range(8)) for k in range(12)), "h1")]
    rows += [(10 + 10 * h + k, prose(k), f"o{h}") for h in range(2) for k in range(4)] + [(90, links + "\n" + "\n".join(bits[:8]), "spam")]
    found = spam_pages.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got = {r["doc_id"]: r for r in found.collect()}
    # eight of the twelve phrases are on ordinary pages of two hosts and on a page of links; all their words count
    assert sorted(got) == [1, 90] and got[1]["replicated"] == 64 and got[1]["words"] == 96


def test_memberships_add_up(spark):
    """No document drops out of a mixture, however many domains share it."""
    domains = [f"d{i}" for i in range(60)]
    model = mixing.DomainClassifier(np.zeros((60, mixing.BUCKETS)), np.log(np.full(60, 1 / 60)))
    docs = spark.createDataFrame([(1, "d3", "a b"), (2, "other", "a b"), (3, None, None), (4, None, "")], "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r for r in mixing.memberships(docs, domains, [float(i % 5) for i in range(60)], model).collect()}
    assert all(sum(m & 31 for m in r["member"]) == 16 for r in got.values()) and len(got) == 4
    assert got[1]["own"] and got[1]["member"] == [3 * 32 + 16] and got[1]["cap"] == 3.0 and not got[2]["own"] and got[2]["cap"] == 0.0


def test_drawn_shares(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"text {i} of {'ab'[i % 2]} " * 5) for i in range(200)] + [(900, None, None)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 3), ("b", 3.0, 3), ("none", 1.0, 2)], "source string, weight double, max_repeat int")
    got = {r["source"]: r for r in mixing.drawn_shares(docs, targets).collect()}
    copies = mixing.mixed_documents(docs, targets).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r["source"]: r["n"] * 20 for r in copies} == {k: got[k]["used"] for k in "ab"} and got["none"]["used"] == 0
    assert abs(got["b"]["used"] / got["b"]["target"] - 1) < 0.1 and abs(sum(r["used_share"] for r in got.values()) - 1) < 1e-9
    assert mixing.drawn_shares(docs, targets.limit(0)).count() == 0


def test_copies_share_one_cap(spark):
    # of target "a" more is wanted than its texts may give: every text is used exactly max_repeat times
    many = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("many copies of one text").alias("text"))
    few = [(100_000 + i, "a", f"text {i % 5} in four copies") for i in range(20)] + [(200_000, "a", "alone")]
    few += [(300_000 + i, "b", f"another text {i}") for i in range(3)] + [(400_000, "b", "text 0 in four copies")]
    docs = many.unionByName(spark.createDataFrame(few, "doc_id bigint, source string, text string"))
    targets = spark.createDataFrame([("a", 5.0, 3), ("b", 1e-9, 3)], "source string, weight double, max_repeat int")
    out = mixing.mixed_documents(docs, targets).join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.sum("copies").alias("uses"), F.max("copies").alias("most")).collect()
    got = {r["text"]: (r["uses"], r["most"]) for r in out}
    assert got["many copies of one text"] == (3, 1) and got["alone"] == (3, 3)
    assert all(got[f"text {k} in four copies"] == (3, 1) for k in range(1, 5)) and max(x for x, _ in got.values()) <= 3


def test_lines_of_function_words_ask_no_profile(monkeypatch):
    asked, real = [], quality_stats.divergence
    monkeypatch.setattr(quality_stats, "divergence", lambda rows, profile, own=None: asked.append(len(rows)) or real(rows, profile, own))
    common = quality_stats.word_keys(["the", "of", "and", "is"])
    page = "The end of the road is near and dear.\n" * 50
    assert not quality_stats.read_lines(pa.array([page]), common).kinds.any() and sum(asked) == 0
    # a mark of layout, or no function word, and they are asked
    assert quality_stats.read_lines(pa.array([page + "- the end of the road is here and there"]), common).kinds[-1] == 1 and sum(asked) > 0


def test_pieces_need_few_passes():
    """The cuts follow the plain definition, and the arrays made on the way stay few."""
    r = random.Random(8)
    texts = ["".join(r.choice("abcde \n") for _ in range(n)) for n in (0, 3, 39, 40, 41, 700, 40_000, 0)]
    codes, offsets = site_lines.comparable(*vectext.code_points(pa.array(texts)))
    stream = np.array([c for a, b in zip(offsets, offsets[1:]) for c in [10] * 40 + [x for c in codes[a:b].tolist() for x in ([10] * 40 if c == 10 else [c])] + [10] * 40], np.uint32)
    plain = np.zeros(len(stream) - 7, np.uint64)
    for k in range(8):
        plain = plain * np.uint64(0x100000001B3) + stream[k : len(plain) + k]
    assert np.array_equal(site_lines.rolling_hashes(stream), plain)
    high = vectext.mix(plain) >> np.uint64(32)
    cuts = {k + 31 - int(np.argmin(high[k : k + 32][::-1])) for k in range(len(high) - 31)}
    _, owner, first, end = site_lines.content_pieces(codes, offsets)
    at = np.flatnonzero(stream != 10)  # places of the characters
    of = np.searchsorted(np.cumsum(codes != 10), np.arange(len(at)), side="right")
    place = dict(zip(of.tolist(), at.tolist()))
    begins = {place[int(f)] for f in first}
    assert all((place[int(f)] in cuts or stream[place[int(f)] - 1] == 10) and codes[f] != 10 and codes[e - 1] != 10 for f, e in zip(first, end))
    assert np.array_equal(owner, np.searchsorted(offsets, first, side="right") - 1)
    inside = [c for c in sorted(cuts) if stream[c - 1] != 10 and stream[c] != 10]
    assert set(inside) <= begins
    tracemalloc.start()
    site_lines.content_pieces(codes, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(stream)


def test_a_slice_reads_its_own_bytes_only():
    texts = pa.array(["plain words " * 80, "mots accentués " * 80] * 10_000)  # 20 MB
    for first in (0, 9_000):
        part = texts[first : first + 10]
        tracemalloc.start()
        codes, offsets = vectext.code_points(part)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert codes.tobytes().decode("utf-32-le") == "".join(part.to_pylist())
        assert np.diff(offsets).tolist() == [len(t) for t in part.to_pylist()] and peak < 1 << 20


def test_keywords_against_plain_counts():
    r = random.Random(4)
    texts = [" ".join(r.choice("ab cd ef gh ij kl mn op".split()[: r.choice((2, 4, 8))]) for _ in range(r.choice((0, 1, 2, 12, 60)))) for _ in range(60)]
    hashes, docs, _, _ = vectext.words(*vectext.code_points(pa.array(texts)))
    sizes = np.array([len(t.split()) for t in texts])
    want = []
    for text in texts:
        words, places = text.split(), defaultdict(list)
        for k, pair in enumerate(zip(words, words[1:])):
            places[pair].append(k)
        under = [False] * len(words)
        for at in places.values():
            near = sum(b - a <= spam_pages.KEYWORD_NEAR for a, b in zip(at, at[1:]))
            if near >= spam_pages.KEYWORD_COUNT - 1 and 2 * len(at) >= spam_pages.KEYWORD_SHARE * len(words):
                for k in at:
                    under[k] = under[k + 1] = True
        want += under
    assert spam_pages.keyword_cover(hashes, docs, sizes).tolist() == want and any(want) and not all(want)
