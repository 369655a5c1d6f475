"""Near-duplicate records with small edits (problem 1): chosen-path set similarity join.

1. Each text becomes a set of word triples in the one form of problem 5, each set a *sketch*: 64 minwise
   tokens of 16 bits for choosing paths, and 128 one-bit minwise values for comparing.  Equal sets are
   joined to one representative first, so copies cost nothing later.
2. Independent trees are walked.  A node is a chosen path; the coordinates a node branches on follow from
   its own hash, so every record that comes by makes the same choice.  How many records a node holds is
   counted by Spark; only nodes above ``leaf_size`` branch on, and which ones these are goes to the tasks
   as a fixed-size filter.  A false positive of the filter merely makes all records of a node branch once more.
   The deeper a tree, the smaller the chance of a pair to meet in it: the number of trees follows from the
   target recall at the last depth, whatever depth a collection needs.
3. Records are shuffled once, to their leaves.  Small leaves are compared exhaustively by sketch.  Leaves that
   are still large at the last depth hold records that agree in all tokens of a path, so most of their pairs are
   results; they are cut into blocks, and each task compares two blocks: no task ever holds such a group.
4. Candidate pairs are checked exactly on the triple sets of their texts, as sets of 44-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import vectext as V
from .canonical import Canonicalizer
from .keyfilter import KeyFilter, key_filter

COORDINATES, BINS = 64, 128
#: A filter that lets every key through.
EVERY = KeyFilter(np.full(1, np.iinfo(np.uint64).max, np.uint64))
_ROUNDS = 8  # one-permutation hashings of 16 bins each


@dataclass(frozen=True)
class JoinSettings:
    """``branches`` branches a node: at Jaccard j a pair that meets in the rest of a tree with probability q meets
    with 1-(1-j*q)**branches one level higher.  ``recall`` is the share of the pairs at the threshold itself that
    the trees bring together at the last depth; pairs above it, and in smaller nodes, are missed far less often."""

    threshold: float = 0.5
    recall: float = 0.97
    branches: int = 2
    leaf_size: int = 64
    #: All nodes of the first depth branch on, whatever their size; those of the last depth are leaves.
    max_depth: int = 4
    #: Share of the 128 sketch bits that must agree: that expected at the threshold, less two standard deviations.
    bits: int = 86
    #: Width of the word shingles.
    width: int = 3
    #: Large nodes of one depth that a filter may hold; beyond, the walk goes by joins.
    filter_nodes: int = 1 << 22

    def meets(self, depth: int, similarity: float) -> float:
        """Chance of a pair of that similarity to meet in one tree of that depth."""
        q = 1.0
        for _ in range(depth):
            q = 1 - (1 - similarity * q) ** self.branches
        return q

    @property
    def trees(self) -> int:
        """Trees that bring the target share of the pairs at the threshold together at the last depth."""
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - self.meets(self.max_depth, self.threshold))))


def _triple_sets(texts: pa.Array, width: int):
    """Distinct shingle hashes of each text of one slice: (hashes, texts' numbers), sorted by text."""
    codes, offsets = V.code_points(texts)
    hashes, docs, _, _ = V.words(codes, offsets)
    grams, at = V.ngrams(hashes, docs, width)
    owner = docs[at]
    # a text of fewer words than a shingle is the set of its one whole form, so that equal texts meet
    n = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero(n == 0)
    if len(short):
        starts, ends = offsets[short], offsets[short + 1]
        grams = np.concatenate([grams, V.span_hashes(codes, starts, ends) ^ np.uint64(1)])
        owner = np.concatenate([owner, short])
    # one sort of whole numbers: the text's number above 44 bits of the hash
    both = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20)))
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]
    both = both[keep]
    return both & np.uint64((1 << 44) - 1), (both >> np.uint64(44)).astype(np.int64)


def _digests(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """128-bit digests of n sets, the same whatever the order of their tokens."""
    first = np.searchsorted(owner, np.arange(n))
    return np.stack([np.add.reduceat(V.mix(grams + np.uint64(k)), first) for k in (11, 12)], axis=1)


def _sketches(grams: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit set digests, 64 coordinates of 16 bits and 128 sketch bits of n sets."""
    digest = _digests(grams, owner, n)
    per = BINS // _ROUNDS
    low = np.full((n, BINS), np.iinfo(np.uint64).max, np.uint64)
    for r in range(_ROUNDS):
        h = V.mix(grams ^ np.uint64(0x9E37 * (r + 1)))
        flat = owner * BINS + r * per + (h & np.uint64(per - 1)).astype(np.int64)
        np.minimum.at(low.reshape(-1), flat, h >> np.uint64(4))
    empty = np.iinfo(np.uint64).max
    for r in range(_ROUNDS):  # an empty bin borrows from the next filled one of its round, re-mixed by the distance
        block = low[:, r * per : (r + 1) * per]
        filled = block != empty
        for step in range(1, per):
            if filled.all():
                break
            from_next, has = np.roll(block, -step, axis=1), np.roll(filled, -step, axis=1)
            take = (block == empty) & has
            block[take] = V.mix(from_next[take] + np.uint64(step))
    values = V.mix(low + np.arange(BINS, dtype=np.uint64))
    # coordinates come from all rounds; low bits and high bits of a value serve different purposes
    coordinates = (values[:, :: BINS // COORDINATES] >> np.uint64(48)).astype(np.uint16)
    bits = np.packbits((values & np.uint64(1)).astype(bool), axis=1)
    return digest, coordinates, bits


def sketch_texts(df: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """(key, set_id, coordinates, bits, stored) of each record with a key and a text; ``stored`` is a hash of the text."""

    def run(batches):
        one_form = Canonicalizer()
        for batch in batches:
            for a, b in V.slices(batch.column(1), V.SLICE_CHARS // 2):
                grams, owner = _triple_sets(one_form(batch.column(1)[a:b]), width)
                digest, coordinates, bits = _sketches(grams, owner, b - a)
                columns = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (digest, coordinates, bits)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns, batch.column(2)[a:b]], [key, "set_id", "coordinates", "bits", "stored"])

    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(column).cast("string").alias("text"))
    return rows.withColumn("stored", F.xxhash64("text")).mapInArrow(run, f"`{key}` string, set_id binary, coordinates binary, bits binary, stored bigint")


def _roots(s: JoinSettings) -> np.ndarray:
    """The root nodes of the trees."""
    return V.mix(np.arange(s.trees, dtype=np.uint64) + np.uint64(77))


def _children(coordinates: np.ndarray, nodes: np.ndarray, rows: np.ndarray, depth: int, branches: int) -> np.ndarray:
    """The nodes that records reach from their nodes, branch after branch; a node's hash chooses the coordinates."""
    seed = V.mix(nodes + np.uint64(depth))
    # distinct coordinates of a node: an odd step through all of them visits each once
    at, step = seed & np.uint64(COORDINATES - 1), (seed >> np.uint64(8)) | np.uint64(1)
    out = []
    for branch in range(branches):
        i = ((at + step * np.uint64(branch)) & np.uint64(COORDINATES - 1)).astype(np.int64)
        value = coordinates[rows, i].astype(np.uint64) | (i.astype(np.uint64) << np.uint64(16))
        out.append(V.mix(V.mix(nodes) ^ V.mix(value + np.uint64(1 << 40))))
    return np.concatenate(out)


def _paths(coordinates: np.ndarray, s: JoinSettings, large: list[KeyFilter]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks the trees with the records of one batch: (nodes, records, is at last depth).

    ``large[k]`` says which nodes of depth k + 1 branch on; the nodes returned are those where a record stops.
    """
    n = len(coordinates)
    done_nodes, done_rows, done_last = [], [], []
    nodes = np.repeat(_roots(s), n)
    rows = np.tile(np.arange(n), s.trees)
    for depth in range(len(large) + 1):
        nodes, rows = _children(coordinates, nodes, rows, depth, s.branches), np.tile(rows, s.branches)
        goes_on = large[depth].maybe(nodes.view(np.int64)) if depth < len(large) else np.zeros(len(nodes), bool)
        stop = ~goes_on
        done_nodes.append(nodes[stop])
        done_rows.append(rows[stop])
        done_last.append(np.full(stop.sum(), depth == len(large)))
        nodes, rows = nodes[goes_on], rows[goes_on]
        if not len(nodes):
            break
    return np.concatenate(done_nodes), np.concatenate(done_rows), np.concatenate(done_last)


def _once(nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the distinct (node, row) pairs, by one sort of 64-bit keys."""
    return np.unique(V.mix(nodes ^ V.mix(V.spread(rows))), return_index=True)[1]


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), width)


def _node_counts(sets: DataFrame, s: JoinSettings, large: list[KeyFilter]) -> DataFrame:
    """(node, records) of the nodes at depth len(large) + 1."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                nodes, _, last = _paths(_matrix(batch.column(0), np.uint16, COORDINATES), s, large)
                found, counts = np.unique(nodes[last], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int32))], ["node", "records"])

    per_batch = sets.select("coordinates").mapInArrow(run, "node bigint, records int")
    return per_batch.groupBy("node").agg(F.sum("records").alias("records"))


def _leaves(sets: DataFrame, s: JoinSettings, large: list[KeyFilter], shared: list[KeyFilter]) -> DataFrame:
    """(node, id, bits_a, bits_b): each record at each of its leaves that other records may share."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                nodes, rows, _ = _paths(_matrix(batch.column(1), np.uint16, COORDINATES), s, large)
                met = np.zeros(len(nodes), bool)
                for level in shared:
                    met |= level.maybe(nodes.view(np.int64))
                nodes, rows = nodes[met], rows[met]
                bits = _matrix(batch.column(2), np.int64, 2)
                ids = np.asarray(batch.column(0))
                once = _once(nodes, rows)
                at = rows[once]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[once].view(np.int64), ids[at], bits[at, 0], bits[at, 1])], ["node", "id", "bits_a", "bits_b"])

    return sets.select("id", "coordinates", "bits").mapInArrow(run, "node bigint, id bigint, bits_a bigint, bits_b bigint")


def _alike(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Positions (i, j) where rows of two sketch arrays agree in enough bits."""
    out = []
    step = max(1, (1 << 22) // max(1, len(right)))
    for a in range(0, len(left), step):
        same = 128 - np.bitwise_count(left[a : a + step, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero(same >= bits)
        out.append(np.stack([i + a, j], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _compare_sorted(bits: int):
    """Compares the records of each small leaf; rows come sorted by node, and a leaf may go over batches."""

    def pairs_of(nodes, ids, sketch):
        """All leaves of a batch at once: compares each row with those 1, 2, 3 ... rows further in its leaf."""
        found = []
        for step in range(1, len(nodes)):
            at = np.flatnonzero(nodes[step:] == nodes[:-step])
            if not len(at):
                break
            same = 128 - np.bitwise_count(sketch[at] ^ sketch[at + step]).sum(axis=1, dtype=np.int16)
            at = at[same >= bits]
            found.append(np.stack([np.minimum(ids[at], ids[at + step]), np.maximum(ids[at], ids[at + step])], axis=1))
        out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        out = np.unique(out[out[:, 0] != out[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["id_a", "id_b"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.stack([np.asarray(batch.column(2)), np.asarray(batch.column(3))], axis=1).view(np.uint64)]
            if rest is not None:
                now = [np.concatenate([x, y]) for x, y in zip(rest, now)]
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
            rest = [x[cut:] for x in now]
            yield pairs_of(*(x[:cut] for x in now))
        if rest is not None:
            yield pairs_of(*rest)

    return run


def _compare_blocks(bits: int):
    """Compares two blocks of one large leaf; a group is a (node, block, block) of at most two blocks of rows."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids = table.column("id").to_numpy()
        sketch = np.stack([table.column("bits_a").to_numpy(), table.column("bits_b").to_numpy()], axis=1).view(np.uint64)
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)  # side 1: both, a block against itself
        at = _alike(sketch[left], sketch[right], bits)
        a, b = ids[left[at[:, 0]]], ids[right[at[:, 1]]]
        out = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.table({"id_a": pa.array(out[:, 0], pa.int64()), "id_b": pa.array(out[:, 1], pa.int64())})

    return run


def _counted(sets: DataFrame, s: JoinSettings) -> tuple[DataFrame, DataFrame | None] | None:
    """(leaves, counts of the last depth or None); None if there are more large nodes than a filter can hold."""
    large = [EVERY]  # small nodes of the first depth hold records that share a single token, hardly a pair among them
    shared: list[KeyFilter] = []
    while True:
        # nodes of one record go no further: they are dropped here and never reach the shuffle of the leaves
        counts = written(_node_counts(sets, s, large).where("records > 1"), "nodes")
        last = len(large) >= s.max_depth - 1
        ends = counts if last else counts.where(F.col("records") <= s.leaf_size)
        sizes = counts.agg(F.count_if(F.col("records") > s.leaf_size).alias("big"), F.count(F.lit(1)).alias("all")).first()
        if sizes["big"] > s.filter_nodes and not last:
            return None
        # a full filter of the ends only lets more rows into the shuffle, where they meet nobody
        shared.append(key_filter(ends.select("node"), "node", sizes["all"] if last else sizes["all"] - sizes["big"]))
        if last or not sizes["big"]:
            return _leaves(sets, s, large, shared), counts if last else None
        large.append(key_filter(counts.where(F.col("records") > s.leaf_size).select("node"), "node", sizes["big"]))


def _walked(sets: DataFrame, s: JoinSettings) -> tuple[DataFrame, DataFrame | None]:
    """The same leaves by joins: at each depth, records meet the size of their node in a shuffle.

    For collections whose large nodes are too many for a filter.  A node of many records is a hot key of the
    join's larger side only, which adaptive execution splits; its sizes are partial aggregates.
    """

    def step(depth: int):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                coordinates = _matrix(batch.column(2), np.uint16, COORDINATES)
                rows = np.arange(batch.num_rows)
                if depth == 0:
                    nodes, rows = np.repeat(_roots(s), len(rows)), np.tile(rows, s.trees)
                else:
                    nodes = np.asarray(batch.column(0)).view(np.uint64)
                nodes, rows = _children(coordinates, nodes, rows, depth, s.branches), np.tile(rows, s.branches)
                once = _once(nodes, rows)
                at = pa.array(rows[once])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[once].view(np.int64)), *(batch.column(k).take(at) for k in (1, 2, 3))], ["node", "id", "coordinates", "bits"])

        return run

    schema = "node bigint, id bigint, coordinates binary, bits binary"
    now = sets.select(F.lit(0).cast("bigint").alias("node"), "id", "coordinates", "bits")
    leaves, counts = None, None
    for depth in range(s.max_depth):
        now = written(now.mapInArrow(step(depth), schema), "walk")
        last = depth == s.max_depth - 1
        if depth == 0:
            continue
        counts = now.groupBy("node").agg(F.count(F.lit(1)).alias("records")).where("records > 1")
        met = now.join(counts, "node")
        ends = met if last else met.where(F.col("records") <= s.leaf_size)
        ends = ends.mapInArrow(_unpacked, "node bigint, id bigint, bits_a bigint, bits_b bigint")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        now = met.where(F.col("records") > s.leaf_size).select("node", "id", "coordinates", "bits")
    return leaves, written(counts, "nodes")


def _unpacked(batches):
    for batch in batches:
        if batch.num_rows:
            bits = _matrix(batch.column(batch.schema.get_field_index("bits")), np.int64, 2)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")), batch.column(batch.schema.get_field_index("id")), pa.array(bits[:, 0]), pa.array(bits[:, 1])], ["node", "id", "bits_a", "bits_b"])


def _parted(hot: KeyFilter, wanted: bool):
    """The rows whose node the filter takes for one of its own, or the others."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(hot.maybe(np.asarray(batch.column(0))) == wanted))

    return run


def candidate_pairs(sets: DataFrame, s: JoinSettings, block: int = 8192) -> DataFrame:
    """(id_a, id_b) of sets whose sketches agree, found through the trees; ``sets`` has id, coordinates, bits."""
    leaves, counts = _counted(sets, s) or _walked(sets, s)
    small, rows = leaves, None
    if counts is not None:
        # leaves of the last depth that hold more than a block of records go through block against block
        nodes = counts.where(F.col("records") > block).select("node", F.ceil(F.col("records") / block).cast("int").alias("blocks"))
        if many := nodes.count():
            # A filter parts the rows, not a join: the planner takes the partitions and the order of a join for those asked
            # for, and when adaptive execution plans the join anew, leaves are torn.  A few small ones pass as one block.
            hot = key_filter(nodes.select("node"), "node", 100 * many)
            small = leaves.mapInArrow(_parted(hot, False), leaves.schema)
            rows = leaves.mapInArrow(_parted(hot, True), leaves.schema).join(nodes, "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    found = small.repartition("node").sortWithinPartitions("node").mapInArrow(_compare_sorted(s.bits), "id_a bigint, id_b bigint")
    if rows is not None:
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int"))
        pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.select(
            "node", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
            F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2).alias("side"), "id", "bits_a", "bits_b",
        )
        found = found.unionByName(pairs.groupBy("node", "first", "second").applyInArrow(_compare_blocks(s.bits), "id_a bigint, id_b bigint"))
    return found.distinct()


#: Bytes of a stored shingle hash, which has 44 bits.
_GRAM = 6


def _exact_sets(df: DataFrame, key: str, column: str, width: int, wanted: KeyFilter) -> DataFrame:
    """(set_id, grams): sorted shingle hashes of the records whose key the filter lets through."""

    def run(batches):
        one_form = Canonicalizer()
        for batch in batches:
            keep = wanted.maybe(np.asarray(batch.column(2)))
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            for a, b in V.slices(batch.column(1), V.SLICE_CHARS // 2):
                found, owner = _triple_sets(one_form(batch.column(1)[a:b]), width)
                raw = np.ascontiguousarray(found).view(np.uint8).reshape(-1, 8)[:, :_GRAM]
                at = np.searchsorted(owner, np.arange(b - a + 1))
                ids = pa.array([row.tobytes() for row in _digests(found, owner, b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array([raw[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["set_id", "grams"])

    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(column).cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64(key)).mapInArrow(run, "set_id binary, grams binary")


def _jaccard(batches):
    """Adds the exact similarity of two gram columns; the pairs of some thousand rows are compared in one sort."""

    def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _GRAM)
        return np.pad(rows, ((0, 0), (0, 8 - _GRAM))).view(np.uint64).reshape(-1), pc.binary_length(column).to_numpy() // _GRAM

    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            (a, na), (b, nb) = grams(part.column(2)), grams(part.column(3))
            pair = np.arange(part.num_rows, dtype=np.uint64) << np.uint64(44)
            both = np.sort(np.concatenate([a | np.repeat(pair, na), b | np.repeat(pair, nb)]))
            same = both[1:][both[1:] == both[:-1]]
            common = np.bincount((same >> np.uint64(44)).astype(np.int64), minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(common / (na + nb - common))], ["id_a", "id_b", "similarity"])


@dataclass
class NearDuplicates:
    """``heads`` (id, head, rows): each class of equal shingle sets with its smallest key and its stored rows;
    ``several`` (key, id, stored): the records of the classes of more than one stored row, with a hash of their text; ``links`` (id_a, id_b,
    similarity): all pairs of classes at or above the threshold; ``linked`` (id, head, rows): the classes that may
    have a link."""

    heads: DataFrame
    several: DataFrame
    links: DataFrame
    linked: DataFrame
    key: str

    @property
    def members(self) -> DataFrame:
        """(key, id): the class of each record.  A class of one stored row is its head, which needs no join."""
        alone = self.heads.where("rows = 1").select(F.col("head").alias(self.key), "id")
        return alone.unionByName(self.several.select(self.key, "id").distinct())


def near_duplicates(df: DataFrame, key: str = "chunk_id", column: str = "text", settings: JoinSettings = JoinSettings()) -> NearDuplicates:
    """Chosen-path similarity join of the texts of a table.

    Rows with a null key or text belong to no class.  Rows repeated under one key count once; if a key comes
    with several texts, each of its texts is compared and the key is a member of each class.  A text of fewer
    words than a shingle is similar only to texts equal in their one form.  An empty table gives empty results.
    """
    s = settings
    sketched = written(sketch_texts(df, key, column, s.width), "sketches")
    sets = sketched.groupBy("set_id").agg(F.min(key).alias("head"), F.count(F.lit(1)).alias("rows"), F.first("coordinates").alias("coordinates"), F.first("bits").alias("bits"))
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    candidates = written(candidate_pairs(sets, s), "candidates")
    heads = sets.select("id", "head", "rows", "set_id")
    involved = candidates.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    linked = written(heads.join(involved, "id"), "linked")
    chosen = key_filter(linked.select(F.xxhash64("head").alias("h")), "h", linked.count())
    # one exchange by set serves the removal of repeats and the join
    grams = _exact_sets(df, key, column, s.width, chosen).groupBy("set_id").agg(F.first("grams").alias("grams"))
    grams = written(grams.join(linked.select("set_id", "id"), "set_id").select("id", "grams"), "grams")
    both = candidates.join(grams.select(F.col("id").alias("id_a"), F.col("grams").alias("grams_a")), "id_a")
    both = both.join(grams.select(F.col("id").alias("id_b"), F.col("grams").alias("grams_b")), "id_b")
    links = both.select("id_a", "id_b", "grams_a", "grams_b").mapInArrow(_jaccard, "id_a bigint, id_b bigint, similarity double")
    links = written(links.where(F.col("similarity") >= s.threshold), "links")
    several = sketched.select(key, "set_id", "stored").join(sets.where("rows > 1").select("set_id", "id"), "set_id").select(key, "id", "stored").distinct()
    return NearDuplicates(heads, written(several, "several"), links, linked, key)


#: Records of one class that one task pairs with as many others.
PAIRED = 2000


def near_duplicate_pairs(df: DataFrame, key: str = "chunk_id", column: str = "text", settings: JoinSettings = JoinSettings(), expanded: int | None = None) -> DataFrame:
    """(key_a, key_b): pairs of records at or above the threshold, the smaller key first.

    All records of a class (equal shingle sets) are paired with each other and with all records of linked classes,
    however many copies there are; the rows grow with the square of the copies.  With ``expanded`` the exact copies
    of one stored text, where there are more than that, are spoken for by the first of them, which is paired with
    each of the others; ``class_links`` gives the class of every record in one row each.
    """
    found = near_duplicates(df, key, column, settings)
    several, spokes = found.several.select("id", F.col(key).alias("k")).distinct(), None
    if expanded is not None:
        copies = written(found.several.groupBy("id", "stored").agg(F.min(key).alias("head"), F.count(F.lit(1)).alias("n")), "copies")
        many = copies.where(F.col("n") > expanded).select("id", "stored", "head")
        rest = found.several.join(many.select("id", "stored"), ["id", "stored"], "left_anti").select("id", F.col(key).alias("k"))
        several = rest.unionByName(many.select("id", F.col("head").alias("k"))).distinct()
        spokes = found.several.join(many, ["id", "stored"]).select(F.col("head").alias("a"), F.col(key).alias("b"))
    several = written(several, "several-speaking")
    alone = found.linked.where("rows = 1").select("id", F.col("head").alias("k"))
    speaking = alone.unionByName(several)
    a, b = (speaking.select(F.col("id").alias(f"id_{x}"), F.col("k").alias(x)) for x in "ab")
    between = found.links.select("id_a", "id_b").join(a, "id_a").join(b, "id_b").select("a", "b")
    # a class of very many different texts goes block against block
    sizes = several.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / PAIRED).cast("int").alias("blocks"))
    sized = several.join(sizes, "id")
    own = sized.select("id", F.col("k").alias("a"), F.pmod(F.xxhash64("k"), F.col("blocks").cast("bigint")).cast("int").alias("block"))
    other = sized.select("id", F.col("k").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    within = own.join(other, ["id", "block"]).where("a < b").select("a", "b")
    pairs = between.unionByName(within)
    if spokes is not None:
        pairs = pairs.unionByName(spokes)
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))
    # a pair comes twice only by a spoke or where a key is in several classes; else the rows, which may be far more than the records, need no shuffle
    once = spokes is None and speaking.groupBy("k").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").isEmpty()
    return pairs if once else pairs.distinct()


def connected(links: DataFrame) -> DataFrame:
    """(id, group): the smallest id that each end of the links (id_a, id_b) is connected with.

    Alternating large-star and small-star steps: neighbours are moved to the smallest neighbour until nothing
    changes, in about the logarithm of the longest path.  Each step is a grouped minimum and a join; no list of
    neighbours is ever built, and every step is written so that lineages stay short.
    """
    edges = written(links.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("group"))
    return ends.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group"))).groupBy("id").agg(F.min("group").alias("group"))


def class_links(found: NearDuplicates, key: str = "chunk_id") -> DataFrame:
    """(key, class_id, copies, links, group_id, group_size): one row per record.

    The class holds the records of equal shingle sets, links counts the other classes it is linked to, and the
    group holds all records that links connect; ids are the smallest keys in them.
    """
    links = found.links.select("id_a", "id_b")
    ends = links.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    names = found.members.groupBy("id").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    named = names.join(ends, "id", "left").join(connected(links), "id", "left")
    named = written(named.select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "id").alias("group")), "classes")
    groups = named.groupBy("group").agg(F.min("class_id").alias("group_id"), F.sum("copies").alias("group_size"))
    out = found.members.join(named.join(groups, "group"), "id")
    return out.select(key, "class_id", "copies", "links", "group_id", "group_size")
