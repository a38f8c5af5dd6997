"""The positional inverted index and its upkeep.

Words are their own keys, so there is no dictionary to lock. Postings hold the positions
as an array and are made where a page lies, without a shuffle. Document
frequencies are an aggregate of postings, never kept by increments. Written postings are
sorted by word, so that a search reads the row groups of its words only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import analysis, html, urls
from ..functions.analysis import Analyzer
from ..plans.tables import keep


@dataclass(frozen=True)
class Index:
    """Tables of an index; see ``schemas``."""

    pages: DataFrame  # page_id, url, title, description, tokens, page_rank
    postings: DataFrame
    images: DataFrame | None = None
    image_postings: DataFrame | None = None
    edges: DataFrame | None = None

    @property
    def frequencies(self) -> DataFrame:
        return frequencies(self.postings)

    def n_pages(self) -> int:
        return self.pages.count()


def with_words(pages: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Adds ``tokens`` (shown in snippets), ``words`` (indexed, place by place the same) and ``title_set``."""
    shown = analysis.tokens(F.col("body"), analyzer.body_chars)
    out = pages.withColumn("tokens", shown)
    out = out.withColumn("words", analysis.stem_lists("tokens") if analyzer.stem else F.col("tokens"))
    return out.withColumn("title_set", F.array_distinct(analysis.words(F.col("title_words"), analyzer, analyzer.other_chars)))


def _group_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, words, title = (batch.column(i) for i in range(3))
        coded = words.flatten().dictionary_encode()
        n_words = max(1, len(coded.dictionary))

        def rows_of(lists: pa.ListArray) -> np.ndarray:
            return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))

        row, code = rows_of(words), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.searchsorted(row, np.arange(len(page)))
        key = row * n_words + code
        order = np.argsort(key, kind="stable")  # so positions ascend within a word
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        bounds = np.r_[starts, len(key)].astype(np.int32)
        titled = pc.index_in(title.flatten(), coded.dictionary)
        known = np.asarray(titled.is_valid())
        titled = rows_of(title)[known] * n_words + titled.drop_null().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(key[starts] % n_words)),
                page.take(pa.array(key[starts] // n_words)),
                pa.array(np.diff(bounds).astype(np.int64)),
                pa.array(np.isin(key[starts], titled)),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array((order - first[row[order]]).astype(np.int32))),
            ],
            ["word", "page_id", "count", "important", "positions"],
        )


def postings(worded: DataFrame) -> DataFrame:
    """word, page_id, count, important (in the title) and ascending positions, from ``with_words``.

    A page is one row, so its words are grouped where it lies, by sorting Arrow batches; nothing is shuffled.
    """
    return worded.select("page_id", "words", "title_set").mapInArrow(_group_words, schemas.POSTINGS)


def term_counts(worded: DataFrame) -> DataFrame:
    """word, page_id, count."""
    return worded.select("page_id", F.explode_outer("words").alias("word")).where("word is not null").groupBy("word", "page_id").agg(F.count("*").alias("count"))


def frequencies(found: DataFrame) -> DataFrame:
    """In how many pages each word occurs, from postings, which have one row for each."""
    return found.groupBy("word").agg(F.count("*").alias("pages_count"))


def document_frequency(worded: DataFrame) -> DataFrame:
    """The same from ``with_words``, without postings: one count by word."""
    each = worded.select(F.explode_outer(F.array_distinct("words")).alias("word")).where("word is not null")
    return each.groupBy("word").agg(F.count("*").alias("pages_count"))


def positions(found: DataFrame) -> DataFrame:
    """word, page_id, position: one row for each occurrence."""
    return found.select("word", "page_id", F.explode("positions").alias("position"))


def edges(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst) between known pages, from parsed pages; links to itself are none."""
    known = pages.select(urls.normalize(F.col("url")).alias("url"), F.col("page_id").alias("dst"))
    return html.links(docs).join(known, "url").where("page_id != dst").select(F.col("page_id").alias("src"), "dst").distinct()


def image_tables(found: DataFrame, analyzer: Analyzer = Analyzer()) -> tuple[DataFrame, DataFrame]:
    """Images (image_id, url, description) and their words (word, image_id), from ``html.images`` with an image_id."""
    made = analysis.words(F.coalesce(F.col("alt"), F.col("description")), analyzer, analyzer.other_chars)
    words = found.select("image_id", F.explode(F.array_distinct(made)).alias("word")).select("word", "image_id").distinct()
    owner = ["page_id"] if "page_id" in found.columns else []
    return found.select("image_id", *owner, "url", "description"), words


def image_frequencies(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("images_count"))


def from_pages(pages: DataFrame, analyzer: Analyzer = Analyzer(), resolve: bool = False, docs: DataFrame | None = None) -> Index:
    """The index of raw pages (page_id, url, html). They are parsed once, and what all tables are made of is kept in the shared folder; ``docs`` if that was done already."""
    docs = parsed_once(pages, resolve) if docs is None else docs
    flat = docs.select("page_id", "url", "doc.title", "doc.description", "doc.body", "doc.title_words")
    images = html.images(docs)
    # the same image may stand on many pages; each stays an image of its own
    images = images.withColumn("image_id", F.xxhash64("page_id", "url", "description"))
    shown, words = image_tables(images, analyzer)
    return replace(from_texts(flat, analyzer), images=shown, image_postings=words, edges=edges(docs, pages))


def parsed_once(pages: DataFrame, resolve: bool = False, loose: bool = True) -> DataFrame:
    """Parsed pages, kept."""
    return keep(html.parsed(pages, resolve, loose), "parsed")


def from_texts(texts: DataFrame, analyzer: Analyzer = Analyzer()) -> Index:
    """The index of texts (page_id, url, title, description, body, title_words)."""
    worded = with_words(texts, analyzer)
    return Index(worded.select("page_id", "url", "title", "description", "tokens", F.lit(1.0).alias("page_rank")), postings(worded))


def with_ranks(index: Index, ranks: DataFrame) -> Index:
    """Saves ranks (page_id, page_rank); pages without one keep theirs."""
    new = ranks.select("page_id", F.col("page_rank").alias("_rank"))
    pages = index.pages.join(new, "page_id", "left").withColumn("page_rank", F.coalesce("_rank", "page_rank")).drop("_rank")
    return replace(index, pages=pages)


def write(index: Index, path: str, partitions: int | None = None) -> None:
    """Parquet tables; postings are sorted by word within ranges of words, pages by page_id."""

    def write_ordered(table: DataFrame, name: str, *keys: str) -> None:
        # ranges are drawn from a sample, which would make the table once more; kept in the shared folder it outlives executors
        table = keep(table, f"unordered-{name}")
        ranges = table.repartitionByRange(partitions, keys[0]) if partitions else table.repartitionByRange(keys[0])
        ranges.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")

    write_ordered(index.pages, "pages", "page_id")
    write_ordered(index.postings, "postings", "word", "page_id")
    for name in ("images", "edges"):
        if (table := getattr(index, name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    if index.image_postings is not None:
        write_ordered(index.image_postings, "image_postings", "word")


def read(spark: SparkSession, path: str, parts: tuple[str, ...] = ("images", "image_postings", "edges")) -> Index:
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(table("pages"), table("postings"), **{name: table(name) for name in parts})


# Upkeep: tables are snapshots, and each of these gives the next one.


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new are added once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def update(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``rows``, which has each key once, replace those of the same key; nulls replace nothing."""
    changed = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in changed))
    out = table.join(new, keys, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in changed else c for c in table.columns))


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti").select(*table.columns)


def replace_pages(table: DataFrame, rows: DataFrame, of: DataFrame, key: str = "page_id") -> DataFrame:
    """Drops what the pages of ``of`` have contributed, then adds ``rows``."""
    return delete(table, of, [key]).unionByName(rows, allowMissingColumns=True)


def reindex(index: Index, texts: DataFrame, analyzer: Analyzer = Analyzer()) -> Index:
    """The index after these pages were read again, as a rebuild would give it; ranks of known pages stay."""
    new = from_texts(texts, analyzer)
    ranks = index.pages.select("page_id", F.col("page_rank").alias("_rank"))
    new_pages = new.pages.join(ranks, "page_id", "left").withColumn("page_rank", F.coalesce("_rank", "page_rank")).drop("_rank")
    return replace(index, pages=replace_pages(index.pages, new_pages, texts), postings=replace_pages(index.postings, new.postings, texts))


def drop_pages(index: Index, gone: DataFrame) -> Index:
    """Pages and all that refers to them."""
    out = replace(index, pages=delete(index.pages, gone, ["page_id"]), postings=delete(index.postings, gone, ["page_id"]))
    if index.edges is None:
        return out
    ends = lambda c: gone.select(F.col("page_id").alias(c))
    return replace(out, edges=delete(delete(index.edges, ends("src"), ["src"]), ends("dst"), ["dst"]))


def page_states(pages: DataFrame) -> DataFrame:
    """Adds ``state``: CRAWL if never indexed, SKIP if indexed after it was fetched, else RECRAWL."""
    state = F.when(F.col("indexed_time").isNull(), "CRAWL").when(F.col("indexed_time") > F.col("crawled_time"), "SKIP").otherwise("RECRAWL")
    return pages.withColumn("state", state)


def stamped(pages: DataFrame, done: DataFrame, now) -> DataFrame:
    """Sets indexed_time of the pages in ``done``, also of those that could not be read."""
    marks = done.select("page_id", F.lit(now).cast("timestamp").alias("indexed_time")).dropDuplicates(["page_id"])
    return update(pages, marks, ["page_id"])


def statistics(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row: pages, the least page_id, indexed pages, words."""
    one = pages.agg(F.count("*").alias("n_pages"), F.min("page_id").alias("least_id"), F.count("indexed_time").alias("n_indexed"))
    return one.crossJoin(found.agg(F.countDistinct("word").alias("n_words")))
