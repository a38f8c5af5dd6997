"""Near-duplicate documents by one-permutation hashing.

1. The distinct word shingles of each whole text are hashed once; ``BANDS * ROWS``
   bins keep their least value, and empty bins copy a bin drawn by a hash of their
   own number and the attempt (optimal densification), so that two sets agree in a
   bin with a probability of their similarity, small sets included.
2. Equal sets (by two 64-bit sums over the set) form a class; its smallest
   ``doc_id`` stands for it. Only these representatives go on.
3. Each band of bins gives a bucket key. In a bucket, all members are candidates of
   one centre only: a star, so pairs grow in proportion to the members. The centre is
   the member that meets most others over all buckets; a text whose copies were edited
   apart meets more of them than they meet of each other. Candidates are confirmed on
   their full sets: of hashes first, and what these link then word for word.
4. A star can miss a link between two members that both differ from the centre. In
   buckets that still hold more than one component, pairs from different components
   that agree in at least ``AGREE`` of ``FINE`` bins are confirmed too, each pair from the
   first bucket that both share.
5. Components by alternating stars.

A pair of similarity s agrees in some band with probability 1 - (1 - s**ROWS)**BANDS:
at 0.8 one pair in ten million is missed.

Defined results: a null or text without words has an empty set, linked with nothing.
Texts with fewer words than a shingle have the whole sequence as their only one. Rows are
numbered first, and sets, links and groups are of rows: a null or shared ``doc_id`` joins
nothing. A null ``doc_id`` counts as the smallest. Repeated rows are equal sets. The rows of a
group's smallest ``doc_id`` are kept; of those without one, the first alone. Centres that tie in whom they meet: the
row of the smallest number. An empty table gives no rows. A very long text is one row, hashed in slices. Other
columns are ignored, whatever their names.

Buckets, classes, groups and centres that hold more than a thousandth of the rows are dealt out in parts
before they are joined (``plans.joins``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_dealt
from . import storage
from .graph import components
from .textkit import LOWER_AZ, buffer, mix, powers, runs, slices, words

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
FINE, AGREE = 1024, 0.75  # 4 standard deviations below 0.8
ATTEMPTS = 512
BLOCK = 4096  # members of a bucket that meet in one task
NO_ID = -(1 << 63)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
LOWER = LOWER_AZ.tobytes()


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted."""
    w = words(data, bounds, lut=LOWER_AZ)
    h, n = w.hashes[0], w.counts()
    last = max(0, len(h) - k + 1)
    fits = np.flatnonzero(w.row[:last] == w.row[k - 1 :][:last])
    row, value = [w.row[fits]], [runs(h, k)[fits]]
    for short in range(1, k):
        of = np.flatnonzero(n == short)
        if len(of):
            row.append(of)
            value.append(mix(runs(h, short)[w.first[of]] + np.uint64(short)))
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def signatures(row: np.ndarray, value: np.ndarray, n_rows: int, bins: int = BINS) -> np.ndarray:
    """The least values in ``bins`` bins of each row, empty ones densified; rows without shingles stay empty."""
    m = mix(value ^ np.uint64(0x5851F42D4C957F2D))
    at = row * bins + ((m >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    sig = np.full(n_rows * bins, EMPTY)
    np.minimum.at(sig, at, m & np.uint64(0xFFFFFFFF))
    sig = sig.reshape(n_rows, bins)
    full = sig != EMPTY
    r, b = np.nonzero(~full & full.any(axis=1)[:, None])
    out = sig.copy()
    for attempt in range(ATTEMPTS):
        if not len(r):
            break
        source = (mix((b.astype(np.uint64) << np.uint64(20)) + np.uint64(attempt + 1)) % np.uint64(bins)).astype(np.int64)
        good = full[r, source]
        out[r[good], b[good]] = sig[r[good], source[good]]
        r, b = r[~good], b[~good]
    for i, j in zip(r, b, strict=True):  # hardly ever: the next full bin
        out[i, j] = sig[i, (j + int(np.argmax(np.roll(full[i], -j)))) % bins]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS) + np.uint64(1)
    keys = (mix(parts) * powers(0xD6E8FEB86659FD93, ROWS)).sum(axis=2, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _sign(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                row, value = shingle_sets(*buffer(part.column(1)), k)
                first = np.searchsorted(row, np.arange(n + 1))
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x369DEA0F31A53F85):
                    total = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(mix(value ^ np.uint64(salt)), out=total[1:])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                keys = band_keys(signatures(row, value, n))
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return sign


def _texts(k: int):
    """What confirms a link: the text, compressed, low bytes of a fine signature, and of each band's key."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, most=1 << 20, rows=256):
                data, bounds = buffer(part.column(1))
                row, value = shingle_sets(data, bounds, k)
                fine = signatures(row, value, part.num_rows, FINE).astype(np.uint8)
                keys = band_keys(signatures(row, value, part.num_rows)).astype(np.uint32)
                raw = data.tobytes()
                body = [squeeze.compress(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(body, pa.binary()), pa.array([x.tobytes() + y.tobytes() for x, y in zip(fine, keys, strict=True)], pa.binary())], ["doc_id", "body", "sig"])

    return texts


def exact_shingles(text: bytes, k: int, known: dict[bytes, int]) -> np.ndarray:
    """A number for each shingle of a text, by the words themselves: ``known`` numbers words and is shared by the texts compared."""
    at = np.array([known.setdefault(w, len(known)) for w in text.split()], np.int64)
    if len(at) < k:
        return np.array([-1 - known.setdefault(b" ".join(text.split()), len(known))] if len(at) else [], np.int64)
    return np.lib.stride_tricks.sliding_window_view(at, k)


def similar(a: bytes, b: bytes, k: int, percent: int) -> bool:
    """Whether the sets of two lower-cased texts reach the similarity, word for word."""
    known: dict[bytes, int] = {}
    x, y = exact_shingles(a, k, known), exact_shingles(b, k, known)
    if x.ndim != y.ndim or x.ndim == 1:
        return x.ndim == y.ndim and len(x) == len(y) == 1 and x[0] == y[0]
    both = np.r_[x, y]
    rank = both[:, 0]
    for j in range(1, k):  # exact: a rank below 2**32 and a word's number make one integer
        rank = np.unique(rank << 32 | both[:, j], return_inverse=True)[1]
    n = int(rank.max()) + 1
    in_x, in_y = np.zeros(n, bool), np.zeros(n, bool)
    in_x[rank[: len(x)]] = in_y[rank[len(x) :]] = True
    return 100 * int((in_x & in_y).sum()) >= percent * int((in_x | in_y).sum())


def _confirm(k: int, percent: int):
    """Rows (a, b, body_a, body_b): those whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        held: tuple[int | None, bytes, np.ndarray] = (None, b"", np.empty(0, np.uint64))

        def whole(body: bytes) -> tuple[bytes, np.ndarray]:
            text = expand.decompress(body).translate(LOWER)
            data = np.frombuffer(text, np.uint8)
            return text, shingle_sets(data, np.array([0, len(data)]), k)[1]

        for batch in batches:
            a, b = _ids(batch.column(0)), _ids(batch.column(1))
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                if held[0] != a[i]:
                    held = (a[i], *whole(batch.column(2)[i].as_py()))
                (text_x, x), (text_y, y) = held[1:], whole(batch.column(3)[i].as_py())
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
                    continue
                # both are sorted and distinct; what their hashes say is then looked up word for word
                spot = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[spot] == y).sum())
                good[i] = 100 * common >= percent * (len(x) + len(y) - common) and similar(text_x, text_y, k, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return confirm


def _across(percent: int):
    """Of one block pair of a bucket: pairs from different components whose signatures agree."""

    def across(key: tuple, group: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        ids, comp, block = (group[c].to_numpy() for c in ("doc_id", "component", "block"))
        n = group["n_shingles"].to_numpy()
        both = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(ids), FINE + 4 * BANDS)
        sig, keys, band = both[:, :FINE], np.ascontiguousarray(both[:, FINE:]).view(np.uint32), int(group["band"][0].as_py())
        left, out = np.flatnonzero(block == x), []
        right = np.flatnonzero(block == y)
        for i in left:
            j = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if x == y:
                j = j[ids[j] > ids[i]]
            if len(j):
                j = j[np.argmax(keys[j] == keys[i], axis=1) == band]
                j = j[(sig[j] == sig[i]).mean(axis=1) >= AGREE]
                out.append(np.c_[np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])])
        found = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return across


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that their full sets confirm; a centre's rows stand together, so its set is made once for each part of them."""
    pairs = storage.keep(pairs, "pairs")
    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b")), "b")
    both = join_dealt(second, texts.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a")), "a", spread="b", how="inner", counts=pairs.groupBy("a").agg(F.count("*").alias("n")))
    return both.select("a", "b", "body_a", "body_b").mapInArrow(_confirm(k, percent), "a long, b long")


def numbered(docs: DataFrame) -> DataFrame:
    """The documents, kept, with a number for each row as ``row``."""
    return storage.keep(docs.withColumn("row", F.monotonically_increasing_id()), "numbered", storage.TEXT_ROWS)


def linked(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """row, n_shingles and component (its least row) of each row of ``docs`` (row, text); see the module."""
    docs = docs.select(F.col("row").alias("doc_id"), "text")
    signed = docs.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")
    signed = storage.keep(signed, "signatures", storage.TEXT_ROWS)
    some = signed.where("n_shingles > 0")
    classes = storage.keep(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "classes")
    heads = some.join(classes, ["set_a", "set_b", "doc_id"], "left_semi").select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    shared = heads.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x != y").select("bucket", "n")
    shared = storage.keep(shared, "shared")  # its sizes tell which buckets are hot in each of the joins below
    met = storage.keep(join_dealt(heads, shared, "bucket", spread="doc_id", how="inner", counts=shared), "buckets")
    meets = met.groupBy("doc_id").agg(F.sum("n").alias("meets"))
    centres = met.join(meets, "doc_id").groupBy("bucket").agg(F.min(F.struct(-F.col("meets"), "doc_id")).alias("best")).select("bucket", F.col("best.doc_id").alias("centre"))
    met = join_dealt(met, centres, "bucket", spread="doc_id", how="inner", counts=shared)
    ids = meets.select("doc_id")
    texts = docs.join(ids, "doc_id", "left_semi").mapInArrow(_texts(shingle), "doc_id long, body binary, sig binary")
    texts = storage.keep(texts, "candidate-texts", storage.TEXT_ROWS)
    met = storage.keep(met, "centres")
    stars = met.where("doc_id != centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = storage.keep(_links(stars, texts, shingle, percent), "links", 500)
    links = links.union(_missed(met, shared, components(links), signed, texts, shingle, percent))
    reach = components(links).withColumnRenamed("node", "doc_id")
    found = classes.join(reach, "doc_id", "left").select("set_a", "set_b", F.coalesce("component", "doc_id").alias("component"))
    none = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    all_docs = join_dealt(some.select("doc_id", "n_shingles", "set_a", "set_b"), found, "set_a", spread="doc_id", how="inner", counts=classes.select("set_a", "n"), also=("set_b",)).select("doc_id", "n_shingles", "component").union(none)
    return all_docs.withColumnRenamed("doc_id", "row")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document; see the module."""
    rows = numbered(docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text")))
    found = storage.keep(linked(rows, shingle, percent).join(rows.select("row", "doc_id"), "row"), "groups")
    least = storage.keep(found.groupBy("component").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"), F.min(F.when(F.col("doc_id") == NO_ID, F.col("row"))).alias("first")), "least")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    kept = F.when(F.col("doc_id") == NO_ID, F.col("row") == F.col("first")).otherwise(F.col("doc_id") == F.col("id"))
    return join_dealt(found, least, "component", spread="row", how="inner", counts=least).select(known("doc_id").alias("doc_id"), "n_shingles", known("id").alias("component_id"), kept.alias("kept"))


def _missed(met: DataFrame, shared: DataFrame, reach: DataFrame, signed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members of a bucket that the stars left in different components."""
    placed = met.join(reach.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_buckets = placed.where("n > 2").groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("bucket")
    # the centre has met all
    rest = join_dealt(placed.where("doc_id != centre"), open_buckets, "bucket", spread="doc_id", how="inner", counts=shared).select("bucket", "band", "doc_id", "component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "band", "block", "doc_id", "component")
    sizes = signed.select("doc_id", "n_shingles").dropDuplicates(["doc_id"])
    rest = rest.join(texts.select("doc_id", "sig").join(sizes, "doc_id"), "doc_id")
    pairs = rest.groupBy("bucket", "x", "y").applyInArrow(_across(percent), "a long, b long").distinct()
    return storage.keep(_links(pairs, texts, k, percent), "links", 500)
