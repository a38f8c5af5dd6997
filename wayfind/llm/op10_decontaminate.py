"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space collapsed. An item of n
characters may differ from a passage by ``n // CHARS_PER_EDIT`` edits. Split into one
piece more than that, at least one piece of any such passage is untouched; an
Aho-Corasick automaton over all pieces finds those in one pass over each whole text.
Around a piece, Myers' bit-parallel algorithm gives the least edit distance of the item
to any passage there.

Documents are only mapped, never shuffled. Items come in blocks of bounded size
(``BLOCK_CHARS``): each block is sent to the executors and meets all documents, and is dropped
before the next one is fetched; with more than one block, the documents' rows are numbered
first and the findings (not the texts) are gathered by row.

Below ``SHORT`` characters the budget is no edits, and word bounds are asked for: at one edit in twelve characters
a piece would have a dozen letters or fewer, ordinary words would be findings, and so would an item inside a
longer word.

Defined results: null or empty texts contain nothing. An empty table of documents gives no rows, one of items finds
nothing. Very long texts are searched whole, in one pass; only what is around a piece is compared. An item is a distinct pair of item_id
and compared text: all texts of an item_id are looked for, and those without an item_id too;
``n_items`` counts these, ``item_ids`` lists their ids. Texts that are null or without words match nothing; items under ``SHORT`` characters must occur exactly and between
word bounds. Of passages that tie, the distance is the same. Repeated documents get equal
rows, and different texts under one doc_id (or none) their own. A null ``doc_id`` stays null. Other columns are
ignored, whatever their names, and kept by ``without_items``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

CHARS_PER_EDIT = 12
SHORT = 32
BLOCK_CHARS = 1 << 20
OUT = "doc_id long, contaminated boolean, n_items long, item_ids string, least_distance long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """Myers' algorithm for one item: vertical differences as bits of a big integer."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.mask, self.top = (1 << self.n) - 1, 1 << (self.n - 1)
        self.places: dict[str, int] = {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def distance(self, passage: str, most: int) -> int:
        """The least distance to a substring of the passage, or most + 1."""
        plus, minus, now, best = self.mask, 0, self.n, most + 1
        get, mask, top = self.places.get, self.mask, self.top
        left = len(passage)
        for c in passage:
            left -= 1
            eq = get(c, 0)
            x = eq | minus
            diagonal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (~(diagonal | plus) & mask)
            down = plus & diagonal
            if up & top:
                now += 1
            elif down & top:
                now -= 1
            up, down = up << 1 & mask, down << 1 & mask
            plus, minus = down | (~(x | up) & mask), up & x
            if now < best:
                best = now
                if not best:
                    break
            elif now - left >= best:
                break
        return best


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [(i, Pattern(t), 0 if len(t) < SHORT else len(t) // CHARS_PER_EDIT) for i, t in items]
        self.pieces = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, p, edits) in enumerate(self.items):
            cuts = [p.n * j // (edits + 1) for j in range(edits + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                places.setdefault(p.text[a:b], []).append((k, a))
        for piece, of in places.items():
            self.pieces.add_word(piece, (len(piece), of))
        if places:
            self.pieces.make_automaton()

    def __reduce__(self):
        return Matcher, ([(i, p.text) for i, p, _ in self.items],)

    def find(self, text: str) -> dict[int, int]:
        """Least distance of the items that the text contains, by their place in ``items``."""
        found: dict[int, int] = {}
        if not self.items or not text:
            return found
        tried: set[tuple[int, int]] = set()
        for end, (length, of) in self.pieces.iter(text):
            for k, offset in of:
                _, pattern, edits = self.items[k]
                if found.get(k) == 0:
                    continue
                start = end + 1 - length - offset
                if start >= 0 and text.startswith(pattern.text, start):
                    stop = start + pattern.n
                    if pattern.n >= SHORT or (start == 0 or text[start - 1] == " ") and (stop == len(text) or text[stop] == " "):
                        found[k] = 0
                elif edits and (k, start) not in tried:
                    tried.add((k, start))
                    near = pattern.distance(text[max(0, start - edits) : start + pattern.n + edits], edits)
                    if near <= edits:
                        found[k] = min(near, found.get(k, near))
        return found


def _scan(matcher: Matcher):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.find(normal(t.as_py())) for t in batch.column(1)]
            ids = [{i for k in f if (i := matcher.items[k][0]) is not None} for f in found]
            columns = [
                batch.column(0),
                pa.array([bool(f) for f in found], pa.bool_()),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(map(str, sorted(i))) for i in ids], pa.string()),
                pa.array([min(f.values()) if f else None for f in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "contaminated", "n_items", "item_ids", "least_distance"])

    return scan


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal(t.as_py()) for t in batch.column(1)], pa.string())], ["item_id", "text"])


def matchers(items: DataFrame, block_chars: int) -> Iterator[Matcher]:
    """The items, by blocks of about ``block_chars``; one is on the driver at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_normal, "item_id long, text string").where("text != ''").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // block_chars
    if blocks > 1:
        items = storage.keep(items, "items")
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield Matcher([(r["item_id"], r["text"]) for r in rows])


def without_items(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, that hold no item; they are mapped where they lie, once for each block."""
    text = docs.columns.index("text")
    for i, matcher in enumerate(matchers(items, block_chars)):
        if i:  # the block before is done with
            docs = storage.keep(docs, "without-items", storage.TEXT_ROWS)

        def keep(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in batch.column(text)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def decontaminate(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending, comma-joined) and least_distance of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = matchers(items, block_chars)
    matcher, more = next(blocks), next(blocks, None)
    if more is None:
        return docs.mapInArrow(_scan(matcher), OUT)
    rows = storage.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered", storage.TEXT_ROWS)
    hits = None
    while matcher:
        part = rows.select("_row", "text").mapInArrow(_scan(matcher), OUT.replace("doc_id", "_row", 1)).where("contaminated")
        part = storage.keep(part, "findings", storage.TEXT_ROWS)
        hits = part if hits is None else hits.union(part)
        matcher, more = more, next(blocks, None)
    ids = F.flatten(F.collect_set(F.transform(F.filter(F.split("item_ids", ","), lambda x: x != ""), lambda x: x.cast("long"))))
    hits = hits.groupBy("_row").agg(F.sum("n_items").alias("n_items"), F.array_sort(F.array_distinct(ids)).alias("ids"), F.min("least_distance").alias("least_distance"))
    joined = rows.select("_row", "doc_id").join(hits, "_row", "left")
    return joined.select("doc_id", F.col("ids").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("item_ids"), "least_distance")
