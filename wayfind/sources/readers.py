"""Where pages, lists and tables come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(path)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds it is read in ranges, side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, html) from files named by number, ``12.html``; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"(\d+)\.html$", 1)
    return files.where(number != "").select(number.cast("long").alias("page_id"), F.decode("content", "UTF-8").alias("html"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, tokens) from files of words, ``12.txt``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("name"), "value")
    return files.select(F.regexp_extract("name", r"(\d+)\.txt$", 1).cast("long").alias("page_id"), F.split("value", r"\s").alias("tokens"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are not empty, such as seeds: (url)."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''")


def stop_words(spark: SparkSession, path: str, most: int = 100_000) -> frozenset[str]:
    """A list of stop words, of bounded size."""
    return frozenset(r["url"] for r in lines(spark, path).limit(most).collect())


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """``key = value`` lines of a properties file."""
    pairs = spark.read.text(path).select(F.trim("value").alias("v")).where("v rlike '^[^#!][^=:]*[=:]'").select(F.split("v", "[=:]", 2).alias("p")).limit(10_000).collect()
    return {r["p"][0].strip(): r["p"][1].strip() for r in pairs}


def modified_time(spark: SparkSession, path: str):
    """When a table's newest file was written; null for a table without files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.max("modificationTime")).first()[0]
