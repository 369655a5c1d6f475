"""Mixing sources to target weights (problem 8): soft membership and fitted document rates.

A classifier trained on a bounded sample of labelled rows gives each document without a usable label its
posterior over the target domains; a document whose own source is a target belongs to it with certainty.
Nonnegative rates (how often a document is used) are fitted by projected-gradient least squares so that the
expected size of each domain meets its target, no rate above the cap.

The gradient of a document is its size times a function of its membership alone, and with the diagonal
preconditioner used here the size cancels: documents of equal membership and cap have equal rates at every
step.  They are therefore aggregated before the fit, and each step is one small Spark aggregate over membership
groups, of which certain membership gives one per domain; only a vector of one number per domain visits the
driver.  Groups and rates are tables in the shared folder, rates are written anew every few steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import vectext as V

#: Rows of the labelled sample the classifier is fitted on, and hash buckets of its word features.
TRAIN_ROWS, BUCKETS = 4000, 4096
#: Posteriors are rounded to this many steps, so that documents of nearly equal membership share a group.
STEPS = 16
MAX_DOMAINS = 5000


def word_size(column: str = "text") -> Column:
    """Size of a text as its number of runs of non-space characters; zero for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"\S+")), F.lit(0)).cast("bigint")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import base64

    import tiktoken

    # fixed value: the published split pattern of the byte-level vocabulary
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})


#: Bytes of the largest rank file that is sent to the tasks.
MAX_VOCABULARY = 16 << 20


def token_sizes(df: DataFrame, vocabulary: str, column: str = "text", to: str = "size") -> DataFrame:
    """Adds the number of tokens of a public byte-level vocabulary; null counts zero.

    ``vocabulary`` is the path of its rank file, which the driver reads and sends to the tasks.
    """
    kept = [c for c in df.columns if c != to]
    with open(vocabulary, "rb") as file:
        ranks = file.read(MAX_VOCABULARY + 1)
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary has more than {MAX_VOCABULARY} bytes")
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        encoding = _encoding(sent.value)
        for batch in batches:
            texts = batch.column(kept.index(column)).to_pylist()
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*kept, to])

    source = df.select(*kept)
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(to, T.LongType())]))


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeat, domain): targets with a source and a weight, one row a source.

    Of rows repeated for a source the largest weight and the largest cap hold; negative weights count as zero;
    a null max_repeat stays null and means no repetition limit is known: it counts as one.
    """
    rows = targets.where("source IS NOT NULL AND weight IS NOT NULL").groupBy("source").agg(F.max(F.greatest("weight", F.lit(0.0))).alias("weight"), F.max("max_repeat").alias("max_repeat"))
    return rows.withColumn("max_repeat", F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(0)).cast("int"))


@dataclass
class DomainClassifier:
    """Multinomial naive Bayes over hashed words; ``logs`` is (domains, buckets), ``prior`` (domains,)."""

    logs: np.ndarray
    prior: np.ndarray

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        """(texts, domains) posteriors; a text without words has the prior."""
        out = np.empty((len(texts), len(self.prior)))
        for a, b in V.slices(texts):
            hashes, docs, _, _ = V.words(*V.code_points(texts[a:b]))
            flat = docs * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
            cells, counts = np.unique(flat, return_counts=True)
            score = np.tile(self.prior, (b - a, 1))
            step = max(1, (1 << 22) // max(1, len(self.prior)))  # cells x domains of one step stay small
            for first in range(0, len(cells), step):
                part, n = cells[first : first + step], counts[first : first + step]
                np.add.at(score, part // BUCKETS, n[:, None] * self.logs[:, part % BUCKETS].T)
            score -= score.max(axis=1, keepdims=True)
            score = np.exp(score)
            out[a:b] = score / score.sum(axis=1, keepdims=True)
        return out


def hashed_sample(df: DataFrame, rows: int, total: int, *columns: str) -> DataFrame:
    """About the first ``rows`` rows of ``total`` by a hash of some columns.

    A hash threshold leaves a small multiple of them first, so that the final top-k merges few rows whatever
    the number of partitions.
    """
    hashed = F.xxhash64(*columns)
    if total > 3 * rows:
        df = df.where(F.pmod(hashed, F.lit(1 << 40)) < int((1 << 40) * 3 * rows / total))
    return df.orderBy(hashed, *columns).limit(rows)


def train_classifier(docs: DataFrame, domains: list[str], rows: int = TRAIN_ROWS, source: str = "source", column: str = "text", total: int | None = None) -> DomainClassifier:
    """Fits the classifier on at most ``rows`` labelled documents, chosen by a hash of their text; ``total`` is how
    many labelled documents there are, if known.

    Word counts are summed by Spark; what reaches the driver is domains x buckets at most.
    """
    index = {d: i for i, d in enumerate(domains)}
    labelled = docs.where(F.col(source).isNotNull() & F.col(column).isNotNull()).select(F.col(source).alias("source"), F.col(column).alias("text"))
    labelled = labelled.join(_domain_table(docs, domains).select(F.col("domain_source").alias("source")), "source", "left_semi")
    sample = written(hashed_sample(labelled, rows, labelled.count() if total is None else total, "text", "source"), "labelled-sample")

    def count(batches):
        for batch in batches:
            label = np.array([index[s] for s in batch.column(0).to_pylist()], np.int64)
            for a, b in V.slices(batch.column(1)):
                hashes, texts, _, _ = V.words(*V.code_points(batch.column(1)[a:b]))
                flat = label[a:b][texts] * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
                cells, counts = np.unique(flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], ["cell", "n"])

    table = sample.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(domains), BUCKETS))
    counts.ravel()[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    seen = sample.groupBy("source").count().toArrow()
    prior = np.ones(len(domains))
    for name, n in zip(seen.column(0).to_pylist(), seen.column(1).to_pylist()):
        prior[index[name]] += n
    logs = np.log(counts + 0.5) - np.log((counts + 0.5).sum(axis=1, keepdims=True))
    return DomainClassifier(logs, np.log(prior / prior.sum()))


def _domain_table(docs: DataFrame, domains: list[str]) -> DataFrame:
    """(domain_source, domain), to be sent to the tasks: at most MAX_DOMAINS rows, which ``_prepared`` checks."""
    return F.broadcast(docs.sparkSession.createDataFrame(list(zip(domains, range(len(domains)))), "domain_source string, domain int"))


def memberships(docs: DataFrame, domains: list[str], caps: list[float], classifier: DomainClassifier, column: str = "text") -> DataFrame:
    """(all columns but the text, own, member, cap) of each row of ``docs``, which has source and text.

    ``member`` is array<int>: membership of each domain in sixteenths, one entry a domain as ``domain * 32 + steps``;
    the steps of a row add up to 16, by largest remainders.  Documents of a target source are its certain members,
    with a single entry (``own`` is true); others get the classifier's posterior.  ``cap`` is how often the
    strictest of its domains allows the document to be used.
    """
    rows = docs.join(_domain_table(docs, domains), F.col("source") == F.col("domain_source"), "left").drop("domain_source")
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    names, kept = rows.columns, [c for c in rows.columns if c not in (column, "domain")]
    most = np.array(caps, float)

    def run(batches):
        for batch in batches:
            domain = batch.column(names.index("domain"))
            own = np.asarray(pc.is_valid(domain))
            first = np.asarray(pc.fill_null(domain, 0), np.int64)
            entries, sizes, least = first * 32 + STEPS, np.ones(len(own), np.int64), most[first]
            rest = np.flatnonzero(~own)
            if len(rest):
                steps = _in_steps(sent.value.posteriors(batch.column(names.index(column)).take(pa.array(rest))))
                at, of = np.nonzero(steps)
                sizes[rest] = np.bincount(at, minlength=len(rest))
                least[rest] = np.where(steps > 0, most, np.inf).min(axis=1)
                begin = np.r_[0, np.cumsum(sizes)]
                out = np.zeros(begin[-1], np.int64)
                out[begin[:-1][own]] = entries[own]
                inside = np.arange(len(at)) - np.searchsorted(at, at)
                out[begin[rest[at]] + inside] = of * 32 + steps[at, of]
                entries = out
            member = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(entries.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(own), member, pa.array(least)], [*kept, "own", "member", "cap"])

    fields = [f for f in rows.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField("own", T.BooleanType()), T.StructField("member", T.ArrayType(T.IntegerType())), T.StructField("cap", T.DoubleType())])
    return rows.mapInArrow(run, schema)


@dataclass
class FittedRates:
    """``groups`` (own, member, cap, size, rate) and, per domain, the target, what the groups hold, what the rates
    reach, and what of it comes from the domain's own documents."""

    groups: DataFrame
    targets: np.ndarray
    held: np.ndarray
    reached: np.ndarray
    own: np.ndarray
    steps: int


#: Steps after which the rates are written anew, so that no step replays more than so many.
REWRITTEN = 8


def fit_rates(groups: DataFrame, targets: np.ndarray, max_steps: int = 60, tolerance: float = 1e-4) -> FittedRates:
    """Projected-gradient least squares: rates in [0, cap] with expected domain totals nearest to ``targets``.

    ``groups`` has own, member, cap and size.  The error of a domain counts relative to its target; the fit ends
    when no total moves by more than ``tolerance`` of its target.  Steps since the rates were last written are
    replayed inside the tasks from the vectors of totals.
    """
    n = len(targets)
    scale = np.where(targets > 0, targets, 1.0)

    def totals(rows: DataFrame, history: list[np.ndarray], held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """What the groups reach by domain, and what of it is the domains' own."""

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    own, owner, d, p, size, rate = _replayed(batch, history, targets, scale, held)
                    amount = p * (size * rate)[owner]
                    mine = np.bincount(d, weights=amount * own[owner], minlength=n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.bincount(d, weights=amount, minlength=n)), pa.array(mine)], ["d", "v", "mine"])

        table = rows.select("own", "member", "cap", "size", "rate").mapInArrow(run, "d bigint, v double, mine double").groupBy("d").agg(F.sum("v").alias("v"), F.sum("mine").alias("mine")).toArrow()
        out = np.zeros((2, n))
        out[:, table.column("d").to_numpy()] = table.column("v").to_numpy(), table.column("mine").to_numpy()
        return out[0], out[1]

    def rated(rows: DataFrame, history: list[np.ndarray], held: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(_replayed(batch, history, targets, scale, held)[5])], ["own", "member", "cap", "size", "rate"])

        return rows.select("own", "member", "cap", "size", "rate").mapInArrow(run, "own boolean, member array<int>, cap double, size bigint, rate double")

    held, _ = totals(groups.withColumn("rate", F.lit(1.0)), [], None)
    rows = groups.withColumn("rate", F.least(F.lit(1.0), F.col("cap")))
    now, own = totals(rows, [], held)
    history: list[np.ndarray] = []
    steps = 0
    while steps < max_steps:
        history.append(now)
        steps += 1
        after, own = totals(rows, history, held)
        still = np.all(np.abs(after - now) <= tolerance * scale)
        now = after
        if still:
            break
        if len(history) == REWRITTEN:
            rows, history = written(rated(rows, history, held), "rates"), []
    return FittedRates(rated(rows, history, held), targets, held, now, own, steps)


def _replayed(batch: pa.RecordBatch, history: list[np.ndarray], targets: np.ndarray, scale: np.ndarray, held: np.ndarray | None):
    """(own, group of each entry, domain, share, size, rate) of the groups of a batch, after the steps of ``history``."""
    own, cap, size, rate = (np.asarray(batch.column(k)) for k in (0, 2, 3, 4))
    member = batch.column(1)
    owner = np.asarray(pc.list_parent_indices(member), np.int64)
    entries = np.asarray(pc.list_flatten(member), np.int64)
    d, p = entries >> 5, (entries & 31) / STEPS
    if history:
        down = np.bincount(owner, weights=p * held[d] / scale[d] ** 2, minlength=len(rate))
        down[down == 0] = 1.0
        for totals in history:
            slope = np.bincount(owner, weights=p * (totals[d] - targets[d]) / scale[d] ** 2, minlength=len(rate))
            rate = np.clip(rate - slope / down, 0.0, cap)
    return own, owner, d, p, size, rate


def _prepared(docs: DataFrame, targets: DataFrame):
    wanted = clean_targets(targets)
    listed = wanted.orderBy("source").limit(MAX_DOMAINS + 1).toArrow().to_pylist()
    if len(listed) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} target domains")
    return listed, [x["source"] for x in listed]


def _targets(listed: list[dict], total: float) -> np.ndarray:
    weights = np.array([x["weight"] for x in listed], float)
    return total * weights / weights.sum() if weights.sum() > 0 else np.zeros(len(listed))


@dataclass
class Mixture:
    """A fitted mixture: the targets in the order of the domains, the sizes aimed at, the fit, and the documents
    (their columns but the text, own, member, cap)."""

    listed: list[dict]
    aim: np.ndarray
    fit: FittedRates
    members: DataFrame

    @property
    def domains(self) -> list[str]:
        return [x["source"] for x in self.listed]


def fitted_mixture(rows: DataFrame, listed: list[dict], train_rows: int = TRAIN_ROWS, grouped=None) -> Mixture:
    """Classifies, aggregates and fits the documents of ``rows``, which has source, text and size.

    The total to be mixed is the size of all rows of target sources.  ``grouped`` makes the table that is fitted
    (own, member, cap, size) from the members, where rows are not to be fitted one by one.
    """
    domains, caps = [x["source"] for x in listed], [float(x["max_repeat"]) for x in listed]
    labelled = rows.join(_domain_table(rows, domains), F.col("source") == F.col("domain_source"))
    sizes = labelled.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t"), F.count("text").alias("n")).first()
    classifier = train_classifier(rows, domains, train_rows, total=sizes["n"])
    members = written(memberships(rows, domains, caps, classifier), "members")
    table = members if grouped is None else grouped(members)
    groups = written(table.groupBy("own", "member", "cap").agg(F.sum("size").cast("bigint").alias("size")), "membership-groups")
    aim = _targets(listed, float(sizes["t"]))
    return Mixture(listed, aim, fit_rates(groups, aim), members)


REPORT = "source string, weight double, max_repeat int, target_share double, held double, target double, reached double, reached_share double, rate double, short boolean"


def mixture_report(docs: DataFrame, targets: DataFrame, size: Column | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(source, weight, max_repeat, target_share, held, target, reached, reached_share, rate, short): the mixture by domain.

    The total T is what all documents of target sources hold; documents of other or no source join the
    mixture by their posterior, held and reached counting them by expected share.  A null text has size zero.
    """
    listed, _ = _prepared(docs, targets)
    spark = docs.sparkSession
    if not listed:
        return spark.createDataFrame([], REPORT)
    found = fitted_mixture(docs.select("source", "text", (size if size is not None else word_size()).alias("size")), listed, train_rows)
    fit, aim = found.fit, found.aim
    reached = fit.reached.sum() or 1.0
    out = [
        (t["source"], t["weight"], t["max_repeat"], float(aim[i] / (aim.sum() or 1.0)), float(fit.held[i]), float(aim[i]), float(fit.reached[i]), float(fit.reached[i] / reached), float(fit.reached[i] / fit.held[i]) if fit.held[i] else 0.0, bool(fit.reached[i] < aim[i] * (1 - 1e-4)))
        for i, t in enumerate(listed)
    ]
    return spark.createDataFrame(out, REPORT)


def short_sources(docs: DataFrame, targets: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(source): targets that fall short even at their cap.

    The mixture is fitted with all documents, those of other sources by their posterior.  Only a domain whose own
    documents, at their fitted rates, stay below its target can be short: they would stay below it at their cap.
    The sizes of these domains are then compared exactly; every row of documents of a target source counts.
    """
    listed, _ = _prepared(docs, targets)
    spark = docs.sparkSession
    if not listed:
        return spark.createDataFrame([], "source string")
    found = fitted_mixture(docs.select("source", "text", word_size().alias("size")), listed, train_rows)
    left = [(t["source"], t["max_repeat"], float(found.aim[i])) for i, t in enumerate(listed) if found.fit.own[i] < found.aim[i] * (1 + 1e-6)]
    if not left:
        return spark.createDataFrame([], "source string")
    candidates = F.broadcast(spark.createDataFrame(left, "source string, max_repeat int, aim double"))  # at most MAX_DOMAINS rows
    held = found.members.where("own").select("source", "size").join(candidates, "source", "left_semi").groupBy("source").agg(F.sum("size").alias("size"))
    exact = candidates.join(held, "source", "left")
    return exact.where(F.coalesce("size", F.lit(0)) * F.col("max_repeat") < F.col("aim")).select("source").distinct()


def _drawn(docs: DataFrame, listed: list[dict], size: Column | None, seed: int, train_rows: int) -> tuple[Mixture, DataFrame]:
    """The mixture and (doc_id, source, copies, size, member) of the documents used in it."""
    rows = docs.where("text IS NOT NULL").select("doc_id", "source", "text", F.xxhash64("text").alias("text_id"), (size if size is not None else word_size()).alias("size"))
    texts: list[DataFrame] = []

    def whole(members: DataFrame) -> DataFrame:
        texts.append(written(_whole_texts(members), "texts"))
        return texts[0]

    found = fitted_mixture(rows, listed, train_rows, whole)
    rates = written(found.fit.groups.select("own", "member", "cap", "rate"), "rates")
    draw = F.pmod(F.xxhash64("text_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    uses = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    used = texts[0].join(rates, ["own", "member", "cap"]).select("text_id", "n", "member", F.least(uses, F.floor("cap")).alias("uses")).where("uses > 0")
    return found, handed_out(found.members.select("doc_id", "source", "text_id", "size").join(used, "text_id"), seed)


def mixed_documents(docs: DataFrame, targets: DataFrame, size: Column | None = None, seed: int = 1, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, source, copies): how often each document is used in the mixture; unused ones are left out.

    Copies of a text are one text to the fit, with one cap; its rate is rounded up or down by a hash of text and
    seed, so that expected sizes hold, and its whole number of uses is handed out to its rows one by one, in the
    order of a hash of their ids.
    """
    listed, _ = _prepared(docs, targets)
    if not listed:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, copies int")
    return _drawn(docs, listed, size, seed, train_rows)[1].select("doc_id", "source", "copies")


def drawn_shares(docs: DataFrame, targets: DataFrame, size: Column | None = None, seed: int = 1, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(source, target, used, target_share, used_share): for each target the size aimed at and what the drawn
    mixture really holds, the size of each document times its uses, by its membership."""
    schema = "source string, target double, used double, target_share double, used_share double"
    listed, _ = _prepared(docs, targets)
    spark = docs.sparkSession
    if not listed:
        return spark.createDataFrame([], schema)
    found, drawn = _drawn(docs, listed, size, seed, train_rows)
    entries = drawn.select(F.explode("member").alias("m"), (F.col("size") * F.col("copies")).alias("amount"))
    used = entries.groupBy(F.shiftright("m", 5).alias("domain")).agg((F.sum(F.col("m").bitwiseAND(31) * F.col("amount")) / STEPS).alias("used"))
    aims = spark.createDataFrame([(i, d, float(found.aim[i])) for i, d in enumerate(found.domains)], "domain int, source string, target double")
    both = aims.join(used, "domain", "left").select("source", "target", F.coalesce("used", F.lit(0.0)).alias("used"))
    # the total as one more row: no window over all targets
    total = both.agg(F.sum("target").alias("targets"), F.sum("used").alias("all_used"))
    out = both.join(F.broadcast(total))
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return out.select("source", "target", "used", share("target", "targets").alias("target_share"), share("used", "all_used").alias("used_share"))


def _whole_texts(member: DataFrame) -> DataFrame:
    """(text_id, n, own, cap, size, member): one row per text, with the least cap and the mean membership of its n rows."""
    texts = member.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("own"), F.min("cap").alias("cap"), F.max("size").alias("size"), F.min("member").alias("member"), F.max("member").alias("other"))
    texts = written(texts, "text-copies")
    several = texts.where("member <> other").drop("member", "other")
    entries = member.join(several.select("text_id"), "text_id", "left_semi").select("text_id", F.explode("member").alias("m"))
    entries = entries.groupBy("text_id", F.shiftright("m", 5).alias("domain")).agg(F.sum(F.col("m").bitwiseAND(31)).alias("steps"))

    def run(batches):
        for batch in batches:
            out = []
            for entry in batch.column(1).to_pylist():
                entry = sorted((x["domain"], x["steps"]) for x in entry)
                steps = _in_steps(np.array([[x for _, x in entry]], float))[0]
                out.append([d * 32 + int(x) for (d, _), x in zip(entry, steps) if x])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["text_id", "member"])

    mean = entries.groupBy("text_id").agg(F.collect_list(F.struct("domain", "steps")).alias("entries")).mapInArrow(run, "text_id bigint, member array<int>")
    columns = ["text_id", "n", "own", "cap", "size", "member"]
    return texts.where("member = other").select(*columns).unionByName(several.join(mean, "text_id").select(*columns))


def _in_steps(shares: np.ndarray) -> np.ndarray:
    """Rows of shares as whole steps, STEPS in each row: the largest remainders are rounded up."""
    exact = shares / shares.sum(axis=1, keepdims=True) * STEPS
    steps = np.floor(exact).astype(np.int64)
    rank = np.argsort(np.argsort(steps - exact, axis=1, kind="stable"), axis=1, kind="stable")
    return steps + (rank < STEPS - steps.sum(axis=1, keepdims=True))


def handed_out(rows: DataFrame, seed: int) -> DataFrame:
    """The rows with ``copies``, the uses of each text, as even as they go over its n rows; unused rows are left out.

    A text with more rows than uses needs only its first rows; these are found in parts first, so that no task
    ranks all rows of a text with very many copies.
    """
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    part = F.row_number().over(Window.partitionBy("text_id", "part").orderBy(*order))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_id"), F.lit(64))).withColumn("place", part).where("uses >= n OR place <= uses")
    rank = F.row_number().over(Window.partitionBy("text_id").orderBy(*order))
    copies = F.floor(F.col("uses") / F.col("n")) + F.when(rank <= F.col("uses") % F.col("n"), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("int")).where("copies > 0").drop("part", "place", "text_id", "n", "uses")
