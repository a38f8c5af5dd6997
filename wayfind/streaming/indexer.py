"""An index that follows a folder of pages.

Each micro-batch reads a bounded number of new files, takes the last version of each page,
and appends its rows under the batch's number. A page's newest batch is the valid one, so
re-indexing appends and readers drop what is superseded; ``compact`` rewrites the tables
without it. A batch that is run again replaces its own folder, so a failure leaves no half.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import Analyzer
from ..operators import index as ix

PAGE_SCHEMA = "page_id long, url string, html string"


def _latest(batch: DataFrame) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy(F.desc("_at"), F.desc("_file"))
    return batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_at", "_file")


def index_batch(path: str, analyzer: Analyzer = Analyzer(), loose: bool = True) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, number: int) -> None:
        docs = ix.parsed_once(_latest(batch), loose=loose)
        made = ix.from_pages(docs.select("page_id", "url"), analyzer, docs=docs)
        for name in ("pages", "postings", "images", "image_postings"):
            getattr(made, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        ix.html.links(docs).write.mode("overwrite").parquet(f"{path}/links/batch={number}")

    return run


def follow(spark: SparkSession, source: str, path: str, checkpoint: str, files_a_batch: int = 100, analyzer: Analyzer = Analyzer(), once: bool = True, loose: bool = True) -> StreamingQuery:
    """Start indexing new Parquet files of pages in ``source``; ``once`` stops when all present ones are read, ``loose`` is the parser's."""
    stream = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    stream = stream.withColumn("_at", F.col("_metadata.file_modification_time")).withColumn("_file", F.col("_metadata.file_path"))
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(index_batch(path, analyzer, loose))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of rows that belong to pages, without those of superseded batches."""
    last = spark.read.parquet(f"{path}/pages").groupBy("page_id").agg(F.max("batch").alias("batch"))
    table = spark.read.parquet(f"{path}/{name}")
    return table.join(last, ["page_id", "batch"], "left_semi").select(*table.columns)


def load(spark: SparkSession, path: str) -> ix.Index:
    """The index as of now, with links resolved among all known pages."""
    pages = current(spark, path, "pages").drop("batch")
    known = pages.select(ix.urls.normalize(F.col("url")).alias("url"), F.col("page_id").alias("dst"))
    edges = current(spark, path, "links").join(known, "url").where("page_id != dst").select(F.col("page_id").alias("src"), "dst").distinct()
    images = current(spark, path, "images").drop("batch")
    image_words = spark.read.parquet(f"{path}/image_postings").drop("batch").distinct().join(images.select("image_id"), "image_id", "left_semi")
    return ix.Index(pages, current(spark, path, "postings").drop("batch"), images, image_words, edges)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the present index anew, sorted by word."""
    ix.write(load(spark, path), to)
