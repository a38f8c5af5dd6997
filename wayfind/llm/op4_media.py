"""Media columns: what bytes are, by signature and structure, whatever they are declared to be.

An Aho-Corasick automaton over the magic bytes of all formats runs once over the whole
content. A hit is only a candidate: the format's validator walks its structure (chunks, blocks,
lengths, checksums) and returns where the object ends, or nothing. A valid object at the
start decides the type; valid objects further in are carved as embedded media.

The query stores each text as an 8-bit mono WAV file, whose samples are the padded UTF-8
bytes, reads the stored column back, finds its type by sniffing and its samples by the
chunk structure, and describes them.

Defined results: null and empty contents have no type; a null text is an empty one, of 64
zero samples. Objects cut short are not valid. Of objects that start at one place the
longest counts (ties: the greater type name), and carved objects do not overlap: the leftmost counts. Repeated
rows give equal rows, and a null or repeated key stays with each of its rows. An empty table gives no rows.
A very long content is one row like others; it is searched once, and what the formats seek in it once. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textkit import buffer, slices

RATE = 8000
UNIT = 64


def _png(b: bytes, at: int) -> int | None:
    at += 8
    first = True
    while at + 12 <= len(b):
        n = int.from_bytes(b[at : at + 4], "big")
        kind = b[at + 4 : at + 8]
        if first and (kind != b"IHDR" or n != 13) or at + 12 + n > len(b):
            return None
        if zlib.crc32(b[at + 4 : at + 8 + n]) != int.from_bytes(b[at + 8 + n : at + 12 + n], "big"):
            return None
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at
    return None


def _gif(b: bytes, at: int) -> int | None:
    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    if at + 13 > len(b):
        return None
    at += 13 + table(b[at + 10])
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 <= len(b):
            at += 10 + table(b[at + 9]) + 1
        else:
            return None
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    at += 2
    seen = False
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        n = int.from_bytes(b[at + 2 : at + 4], "big")
        if n < 2 or kind < 0xC0 or 0xD0 <= kind <= 0xD9:
            return None
        seen |= kind in (0xC0, 0xC1, 0xC2)
        at += 2 + n
        if kind == 0xDA:
            if not seen:
                return None
            while (at := b.find(b"\xff", at)) >= 0 and at + 1 < len(b):
                if b[at + 1] == 0xD9:
                    return at + 2
                if b[at + 1] != 0 and not 0xD0 <= b[at + 1] <= 0xD7:
                    break
                at += 2
            if at < 0:
                return None
    return None


def _riff(kind: bytes) -> Callable[[bytes, int], int | None]:
    def riff(b: bytes, at: int) -> int | None:
        if at + 12 > len(b) or b[at + 8 : at + 12] != kind:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        spot, parts = at + 12, set()
        while spot + 8 <= min(end, len(b)):
            parts.add(b[spot : spot + 4])
            n = struct.unpack_from("<I", b, spot + 4)[0]
            spot += 8 + n + (n & 1)
        need = {b"WAVE": {b"fmt ", b"data"}, b"WEBP": set(), b"AVI ": set()}[kind]
        return end if end <= len(b) and spot == end and need <= parts else None

    return riff


def _gzip(b: bytes, at: int) -> int | None:
    unpack, view = zlib.decompressobj(31), memoryview(b)
    try:
        for spot in range(at, len(b), 1 << 16):
            data = view[spot : spot + (1 << 16)]
            while data and not unpack.eof:
                unpack.decompress(data, 1 << 20)
                data = unpack.unconsumed_tail
            if unpack.eof:
                return min(spot + (1 << 16), len(b)) - len(unpack.unused_data)
    except zlib.error:
        pass
    return None


class Marks:
    """Where byte strings stand in a content, looked for once: a validator that seeks an end asks here, not in the bytes, so hits don't read the rest again and again."""

    def __init__(self, content: bytes):
        self.content = content
        self.found: dict[bytes, list[int]] = {}
        self.archives: dict[int, int] | None = None

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on, or -1."""
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(re.escape(mark), self.content)]
        places = self.found[mark]
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def zip_end(self, at: int) -> int | None:
        """The end of the archive that begins at ``at``; each end record tells where its archive begins."""
        if self.archives is None:
            b, self.archives, spot = self.content, {}, -1
            while (spot := self.after(b"PK\x05\x06", spot + 1)) >= 0:
                if spot + 22 <= len(b):
                    size, start, note = struct.unpack_from("<IIH", b, spot + 12)
                    begin = spot - size - start
                    if begin >= 0 and spot + 22 + note <= len(b) and (not size or b[begin + start : begin + start + 4] == b"PK\x01\x02"):
                        self.archives.setdefault(begin, spot + 22 + note)
        return self.archives.get(at)


def _zip(b: bytes, at: int, marks: Marks) -> int | None:
    return marks.zip_end(at)


def _pdf(b: bytes, at: int, marks: Marks) -> int | None:
    end = marks.after(b"%%EOF", at)
    return end + 5 if end >= 0 and 0 <= marks.after(b"startxref", at) <= end - 9 else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return at + size if not zero and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size and at + size <= len(b) else None


def _ogg(b: bytes, at: int) -> int | None:
    end = None
    while b[at : at + 5] == b"OggS\0" and at + 27 <= len(b):
        n = b[at + 26]
        at, last = at + 27 + n + sum(b[at + 27 : at + 27 + n]), b[at + 5] & 4
        if at > len(b):
            return end
        end = at if last else end
    return end


def _flac(b: bytes, at: int) -> int | None:
    """Metadata is walked; frames have no length, so the object goes on to the end."""
    at, last, first = at + 4, False, True
    while not last:
        if at + 4 > len(b):
            return None
        last, kind, n = bool(b[at] & 0x80), b[at] & 0x7F, int.from_bytes(b[at + 1 : at + 4], "big")
        if first and (kind, n) != (0, 34) or at + 4 + n > len(b):
            return None
        at, first = at + 4 + n, False
    return len(b) if b[at : at + 1] in (b"", b"\xff") else None


# fixed values: magic bytes and media types
FORMATS: list[tuple[bytes, str, Callable[..., int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _riff(b"WAVE")),
    (b"RIFF", "image/webp", _riff(b"WEBP")),
    (b"RIFF", "video/avi", _riff(b"AVI ")),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"BM", "image/bmp", _bmp),
    (b"OggS", "audio/ogg", _ogg),
    (b"fLaC", "audio/flac", _flac),
]


class Sniffer:
    def __init__(self):
        self.magic = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(FORMATS):
            key = magic.decode("latin-1")
            self.magic.add_word(key, (len(magic), [*self.magic.get(key, (0, []))[1], i]))
        self.magic.make_automaton()

    def objects(self, content: bytes) -> list[tuple[str, int, int]]:
        """(type, start, end) of the valid objects that no earlier one overlaps, but for the one at 0: it may hold others."""
        found, free, marks = [], 0, Marks(content)
        for end, (length, formats) in self.magic.iter(content.decode("latin-1")):
            start = end + 1 - length
            if start and start < free:
                continue
            best = max(((stop, FORMATS[i][1]) for i in formats if (stop := FORMATS[i][2](content, start, marks) if FORMATS[i][2] in (_zip, _pdf) else FORMATS[i][2](content, start)) is not None), default=None)
            if best:
                found.append((best[1], start, best[0]))
                free = best[0] if start else 0
        return found


def sniff(docs: DataFrame, content: str = "content", declared: str = "declared_type", key: str = "id") -> DataFrame:
    """key, declared, media_type (null if unknown), corrected (it differs from the declared one), media_end, and embedded: what can be carved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for said, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = sniffer.objects(data.as_py() or b"")
                head = found[0] if found and found[0][1] == 0 else None
                out[0].append(head and head[0])
                out[1].append(head is not None and head[0] != said)
                out[2].append(head and head[2])
                out[3].append([{"type": t, "start": a, "length": b - a} for t, a, b in found if a])
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["key", "declared", "media_type", "corrected", "media_end", "embedded"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(declared).cast("string").alias("declared"), F.col(content).cast("binary").alias("content"))
    return out.mapInArrow(run, f"key {kind}, declared string, media_type string, corrected boolean, media_end long, embedded array<struct<type: string, start: long, length: long>>").withColumnRenamed("key", key)


def carve(docs: DataFrame, found: DataFrame, content: str = "content", key: str = "id") -> DataFrame:
    """The embedded objects that ``sniff`` found, a row of bytes each."""
    spots = found.select(key, F.explode("embedded").alias("part")).select(key, "part.*")
    return docs.select(key, content).join(spots, key).select(key, "type", "start", F.expr(f"substring({content}, cast(start as int) + 1, cast(length as int))").alias("media"))


def to_wav(payload: bytes) -> bytes:
    """8-bit unsigned mono samples; the payload's length is even, so no pad byte is needed."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    at = 12
    while media[at : at + 4] != b"data":
        n = struct.unpack_from("<I", media, at + 4)[0]
        at += 8 + n + (n & 1)
    return media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, bounds = buffer(part.column(1))
            raw, media = data.tobytes(), []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                media.append(to_wav(raw[a:b] + b"\0" * (-(b - a) % UNIT if b > a else UNIT)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(["application/octet-stream"] * part.num_rows), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared_type", "media"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sniffer = Sniffer()
    for batch in batches:
        rows = []
        for key, n, said, cell in zip(*(batch.column(i) for i in range(4)), strict=True):
            media = cell.as_py()
            found = sniffer.objects(media)
            kind = found[0][0] if found and found[0][1] == 0 else "unknown"
            payload = from_wav(media) if kind == "audio/wav" else b""
            level = np.frombuffer(payload, np.uint8)
            counts = np.bincount(level, minlength=256)
            inside = ",".join(f"{t}@{a}+{b - a}" for t, a, b in found if a)
            feature = f"{kind};was={said.as_py()};samples={len(payload)};sum={int(level.sum(dtype=np.int64))};peak={int(counts.argmax())};distinct={int((counts > 0).sum())};embedded={inside or 'none'}"
            rows.append((key.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared_type and media: each text as a WAV file in a stored column."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return storage.keep(docs.mapInArrow(_store, "doc_id long, n_bytes long, declared_type string, media binary"), "media", storage.TEXT_ROWS)


def describe(stored: DataFrame) -> DataFrame:
    """What the stored media are, read back."""
    return stored.mapInArrow(_describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
