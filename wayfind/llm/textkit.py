"""Vectorised words and hashes over Arrow text buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` and are found on the UTF-8 bytes, so no Python
string is made. Byte buffers are taken in segments of at most ``SEGMENT`` bytes
(cut between words), which bounds memory for very long texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 19
LANES = 16  # eight-byte steps of the vectorised word hash; longer words are digested one by one
CHUNK_BYTES = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)  # the first n bytes of eight
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _eight(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` (at most 8) bytes at each place as one integer; ``data`` has eight bytes more than its words."""
    return np.ndarray(len(data) - 7, "<u8", data, 0, (1,))[at] & _KEEP[n]


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, n_hashes: int, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes of ``data[s:e]``: each eight bytes are mixed with what came before, so no arithmetic of the letters cancels.

    Words above ``LANES * 8`` bytes are hashed by BLAKE2.
    """
    data = np.r_[data, np.zeros(8, np.uint8)]
    size = e - s
    lead = _eight(data, s, np.minimum(size, 8))
    made = [mix(mix(lead ^ np.uint64(BASES[k])) + size.astype(np.uint64) * np.uint64(BASES[1 - k])) for k in range(n_hashes)]
    more, lane = np.flatnonzero(size > 8), 8
    while len(more) and lane < 8 * LANES:
        part = _eight(data, s[more] + lane, np.minimum(size[more] - lane, 8))
        for k in range(n_hashes):
            made[k][more] = mix(made[k][more] ^ mix(part + np.uint64(BASES[k]))) * np.uint64(BASES[k])
        lane += 8
        more = more[size[more] > lane]
    for i in more.tolist():
        digest = np.frombuffer(hashlib.blake2b(data[s[i] : e[i]], digest_size=16).digest(), np.uint64)
        for k in range(n_hashes):
            made[k][i] = digest[k]
    for length in prefixes:
        made.append(mix(mix(lead & _KEEP[np.minimum(size, length)]) + np.uint64(length)))
    return made


@dataclass
class Words:
    """Words of a run of rows: ``row`` of each, byte bounds, and a hash for each base."""

    n_rows: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: list[np.ndarray]
    first: np.ndarray  # n_rows + 1 bounds into the words

    def position(self) -> np.ndarray:
        return np.arange(len(self.row)) - self.first[self.row]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the n + 1 bounds of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    n = len(column)
    if n == 0 or bounds is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` whole rows with about ``most`` bytes of text, one row at least."""
    _, bounds = buffer(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, n, at + rows)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, bounds: np.ndarray, n_hashes: int = 1, lut: np.ndarray | None = None, inside_table: np.ndarray = _IS_WORD, prefixes: tuple[int, ...] = ()) -> Words:
    """Find the words of all rows.

    ``lut`` maps bytes before hashing (case folding), ``inside_table`` marks the bytes of
    words. ``n_hashes`` (at most 2) are independent of each other. ``prefixes`` (at most 8) adds to
    the hashes one of the first so many bytes of each word; of a shorter word, of the whole.
    """
    n_rows = len(bounds) - 1
    rows, starts, ends = [], [], []
    hashes: list[list[np.ndarray]] = [[] for _ in range(n_hashes + len(prefixes))]
    at, size = 0, len(data)
    while at < size:
        to = min(size, at + SEGMENT)
        if to < size:
            # cut at a row bound or just behind a space, whichever comes last
            row_bound = int(bounds[np.searchsorted(bounds, to, "right") - 1])
            gap = np.flatnonzero(~inside_table[data[max(at, to - 65536) : to]])
            space = max(at, to - 65536) + int(gap[-1]) + 1 if len(gap) else at
            cut = max(row_bound, space)
            while cut <= at:  # a word as long as the segment: go on to its end
                ahead = min(size, to + SEGMENT)
                gap = np.flatnonzero(~inside_table[data[to:ahead]])
                nxt = int(bounds[np.searchsorted(bounds, to, "left")])
                stop = min(to + int(gap[0]) + 1 if len(gap) else size, nxt)
                if len(gap) or nxt <= ahead or ahead == size:
                    cut = stop
                else:
                    to = ahead
            to = cut
        part = data[at:to]
        inside = inside_table[part]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        edge = bounds[(bounds >= at) & (bounds < to)] - at
        head[edge] = inside[edge]
        tail = inside.copy()
        tail[:-1] &= ~inside[1:]
        before = edge[edge > 0] - 1
        tail[before] = inside[before]
        s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
        for k, h in enumerate(word_hashes(part if lut is None else lut[part], s, e, n_hashes, prefixes)):
            hashes[k].append(h)
        starts.append(s + at)
        ends.append(e + at)
        rows.append(np.searchsorted(bounds, s + at, "right") - 1)
        at = to
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    row = cat(rows, np.int64)
    return Words(n_rows, row, cat(starts, np.int64), cat(ends, np.int64), [cat(h, np.uint64) for h in hashes], np.searchsorted(row, np.arange(n_rows + 1)))


def runs(word_hash: np.ndarray, length: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of every run of ``length`` consecutive words; runs may cross rows, which the caller masks."""
    n = len(word_hash) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = 1 << 18
    for at in range(0, n, step):
        to = min(n, at + step)
        part = word_hash[at : to + length - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(base, len(part)), out=total[1:])
        out[at:to] = (total[length:] - total[:-length]) * powers(inverse(base), len(part))[: to - at]
    return mix(out)


def planes(values: np.ndarray) -> bytes:
    """Bytes of an integer array plane by plane, so that the shuffle's codec removes constant planes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(raw: memoryview, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


def int_lists(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Group int32 ``values`` by the runs of equal ``keys``: the keys, and the values of each as binary."""
    if not len(keys):
        return keys, pa.array([], pa.binary())
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    bounds = np.r_[cut, len(keys)].astype(np.int32) * 4
    raw = np.ascontiguousarray(values, np.int32)
    return keys[cut], pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes())])
