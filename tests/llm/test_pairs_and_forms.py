import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm import near_dup, vectext
from paperloom.llm.canonical import Canonicalizer, canonicalize, form_classes, look_alike_pairs
from paperloom.llm.keyfilter import key_filter

SCHEMA = "chunk_id string, text string"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_forms():
    one = Canonicalizer()
    texts = ["ﬁrst ｆｕｌｌ", "é со​p‑1", None, "", "m² ½ x₂", "a\tb\nc", "résume", "a–b", "ＡＢ　ｃ", "ﻻ"]
    want = ["first full", "é cop-1", None, "", "m² ½ x₂", "a\tb\nc", "résume", "a–b", "AB c", "لا"]
    assert one(pa.array(texts)).to_pylist() == want
    assert one(pa.array(want)).to_pylist() == want  # a second time changes nothing
    assert one(pa.array([], pa.string())).to_pylist() == []


def test_canonicalize_keeps_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "ﬂ", 1), ("a", "ﬂ", 1)], "canonical string, text string, x int")
    out = canonicalize(df)
    assert sorted(out.columns) == ["canonical", "text", "x"] and sorted(map(str, (r["canonical"] for r in out.collect()))) == ["None", "fl", "fl"]


def test_look_alikes(spark):
    rows = [("1", "cop"), ("2", "сор"), ("2", "сор"), ("3", "cop"), ("4", "côp"), ("5", None), (None, "сор"), ("6", ""), ("7", "​"), ("8", "COP")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(look_alike_pairs(df)) == {("1", "2"), ("2", "3"), ("6", "7")}
    assert {r["chunk_id"]: r["records"] for r in form_classes(df).collect()} == {"1": 3, "2": 3, "3": 3, "4": 1, "6": 2, "7": 2, "8": 1}
    assert look_alike_pairs(df.limit(0)).count() == 0


def triples(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    out = set()
    rows = sorted({r for r in rows if None not in r})
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            s, t = triples(x), triples(y)
            if a != b and (x == y or s and t and len(s & t) >= 0.5 * len(s | t)):
                out.add((a, b))
    return out


def documents(n, seed):
    r = random.Random(seed)
    word = lambda: r.choice("audit plan lead check form note line site shift group record sheet".split()) + str(r.randrange(60))
    rows = []
    for i in range(n):
        base = [word() for _ in range(60)]
        rows.append((f"{len(rows):05d}", " ".join(base)))
        for _ in range(r.randrange(4)):
            near = list(base)
            for _ in range(r.randrange(1, 5)):
                near[r.randrange(len(near))] = word()
            rows.append((f"{len(rows):05d}", " ".join(near)))
    return rows


def test_join_against_brute_force(spark):
    rows = documents(150, 1) + [("x1", "two words"), ("x2", "two words"), ("x3", "two word"), ("n", None), (None, "two words"), ("00000", documents(1, 1)[0][1]), ("e1", ""), ("e2", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("set_id", F.lit("q")).withColumn("node", F.lit(0))
    want = brute(rows)
    clear = {p for p in want}
    got = pairs(near_dup.near_duplicate_pairs(df))
    assert not got - want
    assert len(clear - got) <= 0.005 * len(clear)
    groups = near_dup.class_links(near_dup.near_duplicates(df)).collect()
    assert {r["chunk_id"] for r in groups} == {k for k, t in rows if k and t is not None}
    assert near_dup.near_duplicate_pairs(df.limit(0)).count() == 0


def test_many_copies_do_not_multiply(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(f"c{i}", text) for i in range(9)] + [("near", text + " w30"), ("x1", "ａ b"), ("x2", "a b"), ("x3", "a b"), ("x4", "a b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pairs(near_dup.near_duplicate_pairs(df, expanded=4))
    assert {p for p in got if p[0][0] == "c"} == {("c0", f"c{i}") for i in range(1, 9)} | {("c0", "near")}
    assert pairs(look_alike_pairs(df, expanded=2)) == {("x1", "x2")} and len(pairs(look_alike_pairs(df))) == 3
    groups = {r["chunk_id"]: (r["group_id"], r["group_size"]) for r in near_dup.class_links(near_dup.near_duplicates(df)).collect()}
    assert groups["near"] == groups["c5"] == ("c0", 10) and groups["x2"][1] == 4


def test_all_copies_are_paired_however_many(spark):
    """More copies of one text than the 200 up to which they once were paired; a key of two texts brings no pair twice."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(f"c{i:03d}", text) for i in range(205)] + [("n1", text + " w30"), ("n2", text + " w30 w31")]
    keys = sorted(k for k, _ in rows)
    want = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    for more in ([], [("c000", text + " w30")]):
        got = near_dup.near_duplicate_pairs(spark.createDataFrame(rows + more, SCHEMA)).collect()
        assert sorted(map(tuple, got)) == want


def test_different_texts_of_one_class_are_all_paired(spark):
    """Texts that differ in punctuation only have one triple set; none of their links is lost where copies are many."""
    words = [f"w{i}" for i in range(20)]
    rows = [(f"a{i}", " ".join(words)) for i in range(6)] + [(f"b{i}", ", ".join(words) + "." * i) for i in range(5)] + [("n", " ".join(words) + " more"), ("o", "; ".join(words) + "; more")]
    got = pairs(near_dup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), expanded=3))
    loud = ["a0", *(f"b{i}" for i in range(5)), "n", "o"]
    assert got == {(x, y) for x in loud for y in loud if x < y} | {("a0", f"a{i}") for i in range(1, 6)}


def test_trees_follow_from_the_depth():
    for depth in range(1, 8):
        s = near_dup.JoinSettings(max_depth=depth)
        assert all((1 - s.meets(depth, x)) ** s.trees <= 0.03 for x in (0.5, 0.58, 0.7)) and (1 - s.meets(depth, 0.5)) ** (s.trees - 1) > 0.03
    assert near_dup.JoinSettings().trees == 6


def test_recall_at_the_deepest_level(spark):
    """Planted pairs at the threshold and a little above it; leaves of no record force every tree to its last depth."""
    r = random.Random(12)
    rows, planted = [], {0.5: set(), 0.58: set()}
    for similarity, changed in ((0.5, 20), (0.58, 16)):
        for i in range(150):
            base = [f"v{r.randrange(10**6)}" for _ in range(62)]  # 60 triples
            near = base[: 62 - changed] + [f"x{r.randrange(10**6)}" for _ in range(changed)]
            a, b = f"{similarity}-{i:03d}a", f"{similarity}-{i:03d}b"
            rows += [(a, " ".join(base)), (b, " ".join(near))]
            planted[similarity].add((a, b))
    assert min(len(triples(x[1]) & triples(y[1])) / len(triples(x[1]) | triples(y[1])) for x, y in zip(rows[::2], rows[1::2])) >= 0.5
    sets = near_dup.sketch_texts(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", 3).withColumn("id", F.monotonically_increasing_id()).persist()
    names = {x["id"]: x["chunk_id"] for x in sets.select("id", "chunk_id").collect()}
    for depth in (4, 7):
        s = near_dup.JoinSettings(leaf_size=0, max_depth=depth)
        got = {tuple(sorted((names[x["id_a"]], names[x["id_b"]]))) for x in near_dup.candidate_pairs(sets, s).collect()}
        share = {k: len(v & got) / len(v) for k, v in planted.items()}
        print("recall at depth", depth, share)
        assert share[0.5] >= 0.9 and share[0.58] >= 0.97, share


def test_connected_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r["id"]: r["group"] for r in near_dup.connected(spark.createDataFrame(chain, "id_a bigint, id_b bigint")).collect()}
    assert set(got) == {*range(41), 100, 101, 102} and {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_large_leaves_go_by_blocks(spark):
    """Many records that are all alike: leaves stay large to the last depth."""
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(90):
        text = list(base)
        text[i % 40] = f"x{i}"
        rows.append((f"{i:04d}", " ".join(text)))
    df = spark.createDataFrame(rows, SCHEMA)
    s = near_dup.JoinSettings(leaf_size=8, max_depth=3)
    sets = near_dup.sketch_texts(df, "chunk_id", "text", 3).withColumn("id", F.monotonically_increasing_id())
    sets = sets.persist()
    found = {tuple(r) for r in near_dup.candidate_pairs(sets, s, block=16).collect()}
    want = brute(rows)
    names = {r["id"]: r["chunk_id"] for r in sets.collect()}
    got = {tuple(sorted((names[a], names[b]))) for a, b in found}
    assert len(want - got) <= 0.01 * len(want)


def test_small_leaves_stay_whole_beside_large_ones(spark):
    """A group of records fills large leaves; pairs of small ones are found as well, and the partitioning they need is asked for, not taken over from a join."""
    base = [f"w{i}" for i in range(40)]
    alike = [(f"z{i:03d}", " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(40)]
    rows = documents(400, 3) + alike
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = near_dup.sketch_texts(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", 3).withColumn("id", F.xxhash64("chunk_id")).persist()
        names = {r["id"]: r["chunk_id"] for r in sets.select("id", "chunk_id").collect()}
        s = near_dup.JoinSettings(leaf_size=0, max_depth=3)
        found = near_dup.candidate_pairs(sets, s, block=16)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {tuple(sorted((names[r["id_a"]], names[r["id_b"]]))) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = brute(rows)
    assert "REPARTITION_BY_COL" in plan and len(want - got) <= 0.01 * len(want)


def test_walk_by_joins_finds_the_same(spark):
    rows = documents(120, 8)
    sets = near_dup.sketch_texts(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", 3).withColumn("id", F.xxhash64("chunk_id")).persist()
    for leaf in (1, 64):
        by_filter = near_dup.JoinSettings(leaf_size=leaf)
        by_join = near_dup.JoinSettings(leaf_size=leaf, filter_nodes=0 if leaf == 1 else -1)
        assert near_dup._counted(sets, by_join) is None or leaf == 64
        a = {tuple(r) for r in near_dup.candidate_pairs(sets, by_filter).collect()}
        leaves, _ = near_dup._walked(sets, by_join)
        found = leaves.repartition("node").sortWithinPartitions("node").mapInArrow(near_dup._compare_sorted(by_join.bits), "id_a bigint, id_b bigint")
        b = {tuple(r) for r in found.distinct().collect()}
        assert a and len(a ^ b) <= 0.01 * len(a)


def test_words_and_hashes():
    texts = ["Ab c_d", None, "", "ab-C D 1é"]
    codes, offsets = vectext.code_points(pa.array(texts))
    hashes, docs, starts, ends = vectext.words(codes, offsets)
    assert docs.tolist() == [0, 0, 0, 3, 3, 3, 3]
    assert hashes[:3].tolist() == hashes[3:6].tolist()
    grams, at = vectext.ngrams(hashes, docs, 3)
    assert at.tolist() == [0, 3, 4] and grams[0] == grams[1]
    assert vectext.code_points(pa.array(["xx", "ab", "é"]).slice(1))[1].tolist() == [0, 2, 3]


def test_key_filter(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    f = key_filter(keys, "k", 1000)
    assert f.maybe(np.array([r["k"] for r in keys.collect()])).all()
    other = np.array([r["k"] for r in spark.range(5000, 9000).select(F.xxhash64("id").alias("k")).collect()])
    assert f.maybe(other).mean() < 0.05
    assert not key_filter(keys.limit(0), "k", 0).maybe(other).any()
