"""Quality by nearest-neighbour voting in a latent semantic space.

Texts become counts of hashed byte trigrams and of a few repetition features (damped by a
logarithm, unit length). A truncated singular value decomposition of a bounded sample of labelled
documents (``MOST_LABELLED`` rows of each label, drawn by a hash of ``doc_id``) gives
``DIMENSIONS`` latent directions. The sample's latent vectors, of fixed size, are sent to
the executors; cosines of every document with all of them are computed in blocks, exactly,
and the ``NEIGHBOURS`` most similar ones vote with their similarity as weight.

Defined results: a null or empty text has no direction; it scores as low as junk,
``EMPTY_SCORE``. Labels that are null or of unknown documents are dropped, of repeated
labels the lowest counts. With no label at all every score is 0.5. Ties among
neighbours fall to the earlier one in the sample's order. Repeated rows score alike; different texts under one
doc_id (or none) score by their own text, and of those of a labelled doc_id the sample takes one, by a hash. An
empty table gives no rows. Very long texts are counted span by span. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .op9_toxicity import fold
from .textkit import buffer, mix, slices, words

BINS = 4096
EXTRA = 16
DIMENSIONS = 48
MOST_LABELLED = 1500
NEIGHBOURS = 15
SHARPNESS = 8
EMPTY_SCORE = 0.0
BLOCK = 256
SPAN = 1 << 20


@dataclass
class Model:
    directions: np.ndarray  # (BINS + EXTRA) x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, unit length
    labels: np.ndarray


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Unit rows of damped counts."""
    n = len(bounds) - 1
    x = np.zeros((n, BINS + EXTRA), np.float32)
    size = np.diff(bounds)
    flat = x.reshape(-1)
    for at in range(0, max(0, len(data) - 2), SPAN):
        to = min(len(data) - 2, at + SPAN)
        part = data[at : to + 2].astype(np.uint32)
        code = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        code = (code * np.uint32(2654435761)) >> np.uint32(20)
        spot = np.arange(at, to)
        row = np.searchsorted(bounds, spot, "right") - 1
        inside = spot + 2 < bounds[row + 1]
        key = row[inside] * x.shape[1] + code[inside]
        lo, hi = int(row[0]) * x.shape[1], (int(row[-1]) + 1) * x.shape[1]
        flat[lo:hi] += np.bincount(key - lo, minlength=hi - lo).astype(np.float32)
    x[:, :BINS] = np.log1p(x[:, :BINS])
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x /= np.maximum(length, 1e-6)
    # how much of the text is new: distinct words and word pairs among all, in steps
    w = words(data, bounds)
    counts = w.counts().astype(np.float64)
    for j, reach in enumerate((1, 2)):
        key = w.hashes[0] if reach == 1 else w.hashes[0] ^ np.r_[mix(w.hashes[0][1:]), np.uint64(0)][: len(w.row)]
        order = np.lexsort((key, w.row))
        k, r = key[order], w.row[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        # the share expected of running text falls with its length
        share = np.bincount(r[new], minlength=n) / np.maximum(counts, 1)
        step = np.clip((share * 8).astype(int), 0, 7)
        x[np.arange(n), BINS + 8 * j + step] = 0.35
    x[size == 0] = 0
    return x


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model | None:
    known = labels.where(may_learn).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    draw = lambda n: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(1 << 30)) < int(min(1.0, MOST_LABELLED / n) * (1 << 30))
    rule = F.lit(False)
    for label, n in sizes.items():
        rule = rule | (F.col("quality") == label) & draw(n)
    picked = known.where(rule)  # so many rows of each label, up to chance

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(*buffer(part.column(1))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # one text for each picked doc_id, however many rows repeat it
    sample = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality")
    rows = storage.keep(sample.mapInArrow(project, "doc_id long, quality int, x binary"), "labelled", storage.TEXT_ROWS).orderBy("doc_id").collect()
    if not rows:
        return None
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    y = np.array([r["quality"] for r in rows], np.float64)
    del rows
    # randomised range finder with power steps
    q = np.random.default_rng(0).normal(size=(x.shape[1], DIMENSIONS + 16)).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    directions = (q @ v.T)[:, :DIMENSIONS].astype(np.float32)
    z = x @ directions
    return Model(directions, (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32), y)


def vote(model: Model, x: np.ndarray) -> np.ndarray:
    """Similarity-weighted votes of the nearest labelled vectors, block by block of rows."""
    z = x @ model.directions
    length = np.linalg.norm(z, axis=1)
    z /= np.maximum(length, 1e-9)[:, None]
    out = np.full(len(x), EMPTY_SCORE)
    k = min(NEIGHBOURS, len(model.labels))
    for at in range(0, len(x), BLOCK):
        cosine = z[at : at + BLOCK] @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(cosine, near, 1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((cosine >= edge).sum(axis=1) > k)  # among equal cosines the earlier one
        near[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3).astype(np.float64) ** SHARPNESS
        out[at : at + BLOCK] = (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)
    out[length <= 1e-9] = EMPTY_SCORE
    return np.clip(out, 0, 1)


def quality(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of the held-out fold are not looked at."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, labels.select("doc_id", "quality"), fold("doc_id", parts) != held_out)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = vote(model, features(*buffer(part.column(1)))) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    scored = docs.mapInArrow(rate, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", parts) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
