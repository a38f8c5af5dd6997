"""Removal of exact repeated passages by fixed-block anchors.

A run of ``window`` words that occurs twice holds, in either occurrence, a whole
block of ``window // 2`` words that starts at a multiple of that length. So:

1. *Index and probe.* Non-overlapping blocks of ``block`` words of every text are the
   index; every rolling run of ``block`` words of every text probes it. They meet by
   hash bucket. Only blocks need an answer, so other probes travel as sorted hashes
   alone, and a task sends equal ones once: a passage that a third of all texts share
   costs one entry for each task, not one for each text.
2. *Extend.* Blocks that recur go back to their text and are extended over all windows
   that hold no other block of their own text. These windows are hashed to 96 bits, of two
   independent hashes of their words, and again a task sends only the earliest of equal ones;
   the later ones are known repeats already. The bucket keeps the earliest of all.
3. *Cut.* Overlapping and adjoining repeated windows of a text merge to maximal exact
   repeats, whose words are removed.

Texts are shuffled once; both steps that need them read the same exchange.

Defined results: null or empty text: no words, nothing removed. An empty table gives no rows. A very long
text is one row like others, read in slices of its bytes. A null ``doc_id`` counts as the smallest.
A document is a distinct pair of doc_id and text: rows that repeat it are the same place, so none of
them is the earlier one; different texts under one doc_id (or none) are documents of their own, in
the order of ``xxhash64`` of their text (tied windows of one document: the first start is the earlier). Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textkit import BASES, Words, buffer, int_lists, planes, runs, slices, unplanes, words

WINDOW = 20
BUCKET_BYTES = 8 << 20  # of text for each bucket: above a million words
UNIT = 750_000  # entries that a task gathers before it sends them: about 350 MB of a Python worker
COARSE = 1 << 12  # buckets of one shuffle; more are reached in two steps, or blobs would hold an entry each
NO_ID = -(1 << 63)

_ENTRY = "bucket int, doc_id long, body binary"
_PLACES = "doc_id long, at binary"


def _kept(text: bytes, gone: np.ndarray | None) -> str:
    found = text.split()
    return hashlib.sha256(b" ".join(found if gone is None else compress(found, ~gone))).hexdigest()


def _fits(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words at which a run of ``length`` fits into its row, and their positions in it."""
    n = max(0, len(w.row) - length + 1)
    fits = np.flatnonzero(w.row[:n] == w.row[length - 1 :][:n]) if n else np.empty(0, np.int64)
    return fits, fits - w.first[w.row[fits]]


def _steps(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending, prepend=ascending.dtype.type(0)))


def _pack(h: np.ndarray, doc: np.ndarray, at: np.ndarray, more: np.ndarray, placed: np.ndarray, n_buckets: int, width: type) -> Iterator[tuple[int, bytes]]:
    """One blob for each bucket of the ascending hashes: first those that need their place, then bare ones; ``more`` are further bits of the former."""
    bits = n_buckets.bit_length() - 1
    bucket = h >> np.uint64(64 - bits)
    low = ((h << np.uint64(bits)) >> np.uint64(64 - 8 * np.dtype(width).itemsize)).astype(width)
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cut)):
        part = slice(cut[b], cut[b + 1])
        own = placed[part]
        x, y = low[part][own], low[part][~own]
        head = np.array([len(x), len(y)], np.int64).tobytes()
        yield int(b), b"".join((head, _steps(x), planes(doc[part][own]), planes(at[part][own].astype(np.uint32)), planes(more[part][own]), _steps(y)))


def _unpack(raw: bytes, width: type) -> tuple[np.ndarray, ...]:
    """Hashes, documents, positions and further bits of placed entries; bare hashes."""
    view, k = memoryview(raw), np.dtype(width).itemsize
    n, m = map(int, np.frombuffer(view, np.int64, 2))
    b = np.cumsum([16, n * k, n * 8, n * 4, n * 4])
    x, y = (np.cumsum(unplanes(view[i:], width, c), dtype=width) for i, c in ((b[0], n), (b[4], m)))
    return x, unplanes(view[b[1] :], np.int64, n), unplanes(view[b[2] :], np.uint32, n).astype(np.int64), unplanes(view[b[3] :], np.uint32, n), y


def _open(group: pa.Table, width: type) -> tuple:
    """Of a bucket: the places that tasks have decided, and the entries."""
    decided = np.asarray(group["doc_id"].is_valid())
    known = group.filter(pa.array(decided)).select(["doc_id", "body"]).rename_columns(["doc_id", "at"])
    found = [_unpack(x.as_py(), width) for x in group["body"].filter(pa.array(~decided))]
    if not found:
        return known, np.empty(0, width), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, width)
    return known, *(np.concatenate(x) for x in zip(*found, strict=True))


def _lists(doc: np.ndarray, at: np.ndarray) -> pa.Table:
    order = np.lexsort((at, doc))
    keys, lists = int_lists(doc[order], at[order])
    return pa.table([pa.array(keys, pa.int64()), lists], ["doc_id", "at"])


def _told(known: pa.Table, doc: np.ndarray, at: np.ndarray) -> pa.Table:
    return pa.concat_tables([known, _lists(doc, at)])


def _decided(doc: np.ndarray, at: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Places found in a task; they pass through any bucket."""
    found = _lists(doc, at)
    if found.num_rows:
        bucket = pa.array((found["doc_id"].to_numpy() % n_buckets).astype(np.int32))
        yield pa.RecordBatch.from_arrays([bucket, *(found[c].combine_chunks() for c in ("doc_id", "at"))], ["bucket", "doc_id", "body"])


def _finer(coarse: int, n_buckets: int, width: type):
    """Deal the entries of coarse buckets out to fine ones, many tasks' blobs at a time."""
    bits = coarse.bit_length() - 1

    def send(bucket: int, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        x, doc, at, more, y = (np.concatenate(c) for c in zip(*(_unpack(b, np.uint64) for b in bodies), strict=True))
        h = (np.r_[x, y] >> np.uint64(bits)) | np.uint64(bucket << (64 - bits))
        order, none = np.argsort(h, kind="stable"), np.zeros(len(y), np.uint32)
        placed = np.r_[np.ones(len(x), bool), np.zeros(len(y), bool)]
        yield from _blobs(_pack(h[order], np.r_[doc, none.astype(np.int64)][order], np.r_[at, none][order], np.r_[more, none][order], placed[order], n_buckets, width))

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        size = 0
        for batch in batches:
            decided = np.asarray(batch.column(1).is_valid())
            if decided.any():
                yield batch.filter(pa.array(decided))
            for bucket, body in zip(batch.column(0).filter(pa.array(~decided)).to_pylist(), batch.column(2).filter(pa.array(~decided)), strict=True):
                held.setdefault(bucket, []).append(body.as_py())
                size += len(held[bucket][-1])
            if size >= 8 * UNIT:
                for bucket, bodies in held.items():
                    yield from send(bucket, bodies)
                held, size = {}, 0
        for bucket, bodies in held.items():
            yield from send(bucket, bodies)

    return finer


def _blobs(packed: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for bucket, body in packed:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.nulls(1, pa.int64()), pa.array([body], pa.binary())], ["bucket", "doc_id", "body"])


def _new(h: np.ndarray) -> np.ndarray:
    """Where a run of equal hashes begins."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return new


def _gathered(batches: Iterator[pa.RecordBatch], entries, send) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        for part in slices(batch):
            parts.append(entries(part))
            held += len(parts[-1][0])
            if held >= UNIT:
                yield from send(*map(np.concatenate, zip(*parts, strict=True)))
                parts, held = [], 0
    if held:
        yield from send(*map(np.concatenate, zip(*parts, strict=True)))


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _probe(block: int, n_buckets: int, width: type):
    def entries(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        w = words(*buffer(part.column(1)))
        fits, at = _fits(w, block)
        return runs(w.hashes[0], block)[fits], _ids(part.column(0))[w.row[fits]], at.astype(np.int32)

    def send(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h, kind="stable")
        h, doc, at = h[order], doc[order], at[order]
        own = at % block == 0
        first = np.flatnonzero(_new(h))
        size = np.diff(np.r_[first, len(h)])
        hit = np.repeat(size > 1, size) & own
        yield from _decided(doc[hit], at[hit], n_buckets)
        # of equal runs one goes on, an index block if there is one
        chosen = np.flatnonzero(own)
        lead = first.copy()
        group = np.searchsorted(first, chosen, "right") - 1
        lead[group[::-1]] = chosen[::-1]
        yield from _blobs(_pack(h[lead], doc[lead], at[lead], np.zeros(len(lead), np.uint32), own[lead], n_buckets, width))

    return lambda batches: _gathered(batches, entries, send)


def _meet(key: tuple, group: pa.Table) -> pa.Table:
    """Within a bucket: index blocks whose words occur elsewhere too."""
    known, h, doc, at, _, bare = _open(group, np.uint32)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = _new(s)
    twice = ~new
    twice[:-1] |= ~new[1:]
    bare.sort()
    spot = np.minimum(np.searchsorted(bare, s), max(0, len(bare) - 1))
    hit = order[twice | (bare[spot] == s)] if len(bare) else order[twice]
    return _told(known, doc[hit], at[hit])


def _later(h: np.ndarray, doc: np.ndarray, at: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash and place, and where in it an equal window starts strictly earlier."""
    order = np.lexsort((at, doc, more, h))
    h, doc, at, more = h[order], doc[order], at[order], more[order]
    new = _new(h) | _new(more)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.empty(0, np.int64)
    return order, (doc != doc[lead]) | (at != at[lead])


def _first(key: tuple, group: pa.Table) -> pa.Table:
    """Within a bucket: windows that start earlier too."""
    known, h, doc, at, more, _ = _open(group, np.uint64)
    order, late = _later(h, doc, at, more)
    return _told(known, doc[order[late]], at[order[late]])


def _extend(block: int, window: int, n_buckets: int):
    def entries(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        w, hits = words(*buffer(part.column(1)), n_hashes=2), part.column(2)
        hit = np.zeros(len(w.row) + window, bool)
        for i in range(w.n_rows):
            spots = np.frombuffer(b"".join(hits[i].as_py()), np.int32).astype(np.int64)
            hit[w.first[i] + spots[spots < w.first[i + 1] - w.first[i]]] = True
        fits, at = _fits(w, window)
        # every block of its own text that a repeated window holds recurs: one, or two if it starts with one
        lead = -at % block
        near = hit[fits + lead] & ((lead > 0) | hit[fits + block])
        fits, at = fits[near], at[near]
        one, two = (runs(h, window, b)[fits] if len(fits) else np.empty(0, np.uint64) for h, b in zip(w.hashes, BASES, strict=True))
        return two, _ids(part.column(0))[w.row[fits]], at.astype(np.int32), one.astype(np.uint32)

    def send(h: np.ndarray, doc: np.ndarray, at: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, late = _later(h, doc, at, more)
        yield from _decided(doc[order[late]], at[order[late]], n_buckets)
        go = order[~late]
        yield from _blobs(_pack(h[go], doc[go], at[go], more[go], np.ones(len(go), bool), n_buckets, np.uint64))

    return lambda batches: _gathered(batches, entries, send)


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, bounds), n_words, n_removed, kept = buffer(batch.column(1)), [], [], []
            for i, late in enumerate(batch.column(2)):
                text, gone = data[bounds[i] : bounds[i + 1]].tobytes(), None
                n = len(text.split())
                if late.is_valid:
                    spots = np.unique(np.frombuffer(b"".join(late.as_py()), np.int32))
                    edge = np.zeros(max(n, int(spots[-1]) + window) + 1, np.int64)
                    edge[spots] += 1
                    edge[spots + window] -= 1
                    gone = np.cumsum(edge)[:n] > 0
                n_words.append(n)
                n_removed.append(0 if gone is None else int(gone.sum()))
                kept.append(_kept(text, gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return cut


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """A power of two, in proportion to the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return 1 << max(6, (total // BUCKET_BYTES).bit_length())


def placed(docs: DataFrame) -> DataFrame:
    """Adds ``place`` to (doc_id, text): one number for each document, in their order.

    It is the doc_id itself if none has different texts, which is counted first; otherwise
    the distinct pairs of id and digest are numbered in order, and no text is sorted.
    """
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(NO_ID)))
    facts = docs.select("place", F.xxhash64("text").alias("digest"))
    shared = facts.groupBy("place").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x != y")
    if not shared.limit(1).count():
        return docs
    order = facts.distinct().repartitionByRange("place", "digest").sortWithinPartitions("place", "digest")
    order = storage.keep(order.withColumn("number", F.monotonically_increasing_id()), "places")
    return docs.withColumn("digest", F.xxhash64("text")).join(order, ["place", "digest"]).select("doc_id", "text", F.col("number").alias("place"))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, n_buckets: int | None = None, coarse: int = COARSE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document; see the module."""
    block = window // 2
    n_buckets = n_buckets or buckets_for(docs, text)
    first, two = min(coarse, n_buckets), n_buckets > coarse

    def met(entries: DataFrame, meet, width: type) -> DataFrame:
        if two:
            entries = entries.repartition("bucket").mapInArrow(_finer(first, n_buckets, width), _ENTRY)
        return entries.groupBy("bucket").applyInArrow(meet, _PLACES)

    docs = placed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    gather = lambda places, name: places.groupBy(F.col("doc_id").alias("place")).agg(F.collect_list("at").alias(name))
    probes = docs.select("place", "text").mapInArrow(_probe(block, first, np.uint64 if two else np.uint32), _ENTRY)
    hits = gather(met(probes, _meet, np.uint32), "hits")
    # the same columns on both sides of the two joins, so that they read one exchange of the texts
    near = docs.join(hits, "place").select("place", "text", "hits", "doc_id").mapInArrow(_extend(block, window, first), _ENTRY)
    late = gather(met(near, _first, np.uint64), "late")
    done = docs.join(late, "place", "left").select("doc_id", "text", "late")
    return done.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
