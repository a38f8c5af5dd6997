"""Toxicity by non-negative positive-unlabelled learning.

Fit on bounded samples (``MOST_TOXIC``, ``MOST_UNLABELLED`` rows, drawn by a hash of
``doc_id``): confirmed toxic documents and unlabelled text; clean labels are used only
to estimate the class prior. Features are hashes of words and of their first four to
six bytes (which carry stems and compounds) in ``BINS`` bins, each at four levels: it
occurs, occurs again, and is at least every 200th or every 100th word. The
``FEATURES`` of these that the toxic sample's distinct texts hold most in excess of the
unlabelled one's are kept, however few of the toxic documents that is. Linear classifiers are trained in numpy under the risk
``prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic))`` with logistic loss,
from several seeds, and their probabilities are averaged.

Only features and weights of fixed size reach the driver and the executors; every whole
text is scored.

Defined results: a null or empty text has no feature and gets the bias's score, a low
one. Null labels are dropped, labels of unknown documents count for the class prior only; a
document with both labels counts as toxic. Without any toxic label all scores are 0. Repeated
rows of documents get the same score; different texts under one doc_id (or none) are scored by their own
text, and of those of a labelled doc_id the sample takes one, by a hash. Features tied in evidence are taken in
the order of their bin. An empty table gives no rows. Very long texts are read word by word in slices. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .textkit import LOWER_AZ, buffer, slices, words

BINS = 1 << 26
FEATURES = 512
MOST_TOXIC = 4000
MOST_UNLABELLED = 12000
LEAST_TOXIC = 3  # distinct toxic texts that a feature must occur in: copies of one are no evidence
LEAST_G = 24.0  # of the likelihood-ratio test: about one in a million by chance
PREFIXES = (4, 5, 6)
SEEDS = (0, 1, 2)
EPOCHS = 300
THRESHOLD = 0.3

LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    bins: np.ndarray  # ascending; the level is in the lowest two bits
    weights: np.ndarray  # seeds x features
    bias: np.ndarray
    prior: float


def fold(doc_id: str | Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(parts))


def bins_of(data: np.ndarray, bounds: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of the distinct features of each row; ``of`` keeps those bins only."""
    w = words(data, bounds, lut=LOWER_AZ, inside_table=LETTERS, prefixes=PREFIXES)
    keys = []
    for h in w.hashes:
        base, row = (h >> np.uint64(38)).astype(np.int64), w.row
        if of is not None:
            bases = np.unique(of >> 2)
            hit = bases[np.minimum(np.searchsorted(bases, base), len(bases) - 1)] == base if len(bases) else np.zeros(len(base), bool)
            base, row = base[hit], row[hit]
        keys.append(row * BINS + base)
    keys, n = np.unique(np.concatenate(keys), return_counts=True)
    row, base = keys // BINS, keys % BINS
    size = w.counts()[row]
    levels = (n >= 1, n >= 2, (n >= 2) & (200 * n >= size), (n >= 3) & (100 * n >= size))
    return np.concatenate([row[x] for x in levels]), np.concatenate([base[x] * 4 + i for i, x in enumerate(levels)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by bin and kind (1: toxic), of a slice of texts."""
    for batch in batches:
        for part in slices(batch):
            row, b = bins_of(*buffer(part.column(1)))
            keys, n = np.unique(b * 2 + part.column(2).to_numpy()[row], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // 2), pa.array(keys % 2), pa.array(n.astype(np.int64))], ["bin", "kind", "n"])


def _present(bins: np.ndarray):
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(bins, *buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["kind", "bits"])

    return present


def features(bins: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the model's bins each row has."""
    row, b = bins_of(data, bounds, bins)
    x = np.zeros((len(bounds) - 1, len(bins)), bool)
    if len(bins):
        spot = np.minimum(np.searchsorted(bins, b), len(bins) - 1)
        good = bins[spot] == b
        x[row[good], spot[good]] = True
    return x


def excess(toxic: int, free: int) -> Column:
    """The likelihood-ratio statistic of a bin that n_toxic and n_free documents of the samples hold."""
    a, b = F.col("n_toxic"), F.col("n_free")
    share = (a + b) / F.lit(toxic + free)
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    g = part(a, toxic * share) + part(b, free * share) + part(toxic - a, toxic * (1 - share)) + part(free - b, free * (1 - share))
    return F.when(a * free > b * toxic, 2 * g).otherwise(0.0)


def train(toxic: np.ndarray, free: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk; full batches, Adam."""
    rng = np.random.default_rng(seed)
    p, u = toxic.astype(np.float32), free.astype(np.float32)
    w = rng.normal(0, 0.01, p.shape[1] + 1).astype(np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    grad = lambda x, g: np.r_[x.T @ g, g.sum()].astype(np.float32)
    for step in range(1, EPOCHS + 1):
        fp, fu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        negative = loss(-fu).mean() - prior * loss(-fp).mean()
        up = prior * grad(p, -sigmoid(-fp) / len(p))
        down = grad(u, sigmoid(fu) / len(u)) - prior * grad(p, sigmoid(fp) / len(p))
        # below zero, the corrected risk is undone instead of followed
        g = up + down if negative >= 0 else -down
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic); ``may_learn`` picks label rows by their doc_id."""
    known = labels.where(may_learn).where("doc_id is not null and toxic is not null")
    known = storage.keep(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "labels")
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.5, max(0.01, n_toxic / n)) if n else 0.01
    empty = Model(np.empty(0, np.int64), np.zeros((1, 0), np.float32), np.array([-30.0]), prior)
    if not n_toxic:
        return empty
    draw = lambda share, *more: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9), *more), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    toxic = known.where("toxic = 1").where(draw(MOST_TOXIC / n_toxic)).select("doc_id", F.lit(1).cast("long").alias("kind"))
    # repeated rows count once, and rows without a doc_id are drawn by their text
    free = docs.where(draw(MOST_UNLABELLED / max(1, docs.count()), F.when(F.col("doc_id").isNull(), F.col("text")))).dropDuplicates(["doc_id", "text"]).select("doc_id", "text", F.lit(0).cast("long").alias("kind"))
    # at most MOST_TOXIC rows, up to chance: one text for each doc_id
    chosen = docs.join(F.broadcast(toxic), "doc_id").groupBy("doc_id", "kind").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "kind")
    sample = storage.keep(chosen.union(free), "sample")
    distinct = sample.dropDuplicates(["kind", "text"]).select("doc_id", "text", "kind")
    sizes = {r["kind"]: r["n"] for r in distinct.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return empty
    counts = distinct.mapInArrow(_count, "bin long, kind long, n long").groupBy("bin").agg(F.sum(F.col("n") * F.col("kind")).alias("n_toxic"), F.sum(F.col("n") * (1 - F.col("kind"))).alias("n_free"))
    best = counts.where(F.col("n_toxic") >= LEAST_TOXIC).withColumn("g", excess(sizes[1], sizes[0])).where(F.col("g") >= LEAST_G)
    with storage.batches(docs.sparkSession, storage.TEXT_ROWS):
        bins = np.sort(np.array([r["bin"] for r in best.orderBy(F.desc("g"), "bin").limit(FEATURES).collect()], np.int64))
    if not len(bins):
        return empty
    with storage.batches(docs.sparkSession, storage.TEXT_ROWS):
        rows = sample.mapInArrow(_present(bins), "kind long, bits binary").toPandas().sort_values(["kind", "bits"])
    x = np.unpackbits(np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1), axis=1, count=len(bins)).astype(bool)
    kind = rows["kind"].to_numpy()
    trained = [train(x[kind == 1], x[kind == 0], prior, seed) for seed in SEEDS]
    return Model(bins, np.array([w for w, _ in trained]), np.array([b for _, b in trained]), prior)


def scores(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    x = features(model.bins, data, bounds).astype(np.float32)
    z = x @ model.weights.T.astype(np.float32) + model.bias
    return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(axis=1).astype(np.float64)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of each document."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(model, *buffer(part.column(1))))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rate, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of the held-out fold are not looked at."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fold("doc_id", parts) != held_out)
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", parts) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score below the threshold; they are mapped where they lie."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fold("doc_id", parts) != held_out)
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(scores(model, *buffer(part.column(text))) < threshold))

    return docs.mapInArrow(keep, docs.schema)
