"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw pages as one table, not a file for each."""
    pages.write.mode("append").parquet(path)


def write_token_texts(pages: DataFrame, path: str) -> None:
    """Each page's tokens as one line of text, in folders by page_id's last two digits."""
    pages.select(F.pmod("page_id", F.lit(100)).alias("part"), F.concat_ws(" ", "tokens").alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def _files(rows: DataFrame, path: str, ending: str) -> None:
    """A file for each row (page_id, value), named by its number, in folders by the last two digits; written through the file system of ``path``."""
    from pyarrow import fs

    kind = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    base = kind[1]

    def write(batches):
        store = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")[0]
        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{base}/{number % 100}", recursive=True)
                # a task that runs again writes the same file anew
                with store.open_output_stream(f"{base}/{number % 100}/{number}.{ending}") as out:
                    out.write((value or "").encode())
            yield batch.slice(0, 0)

    rows.mapInArrow(write, rows.schema).count()


def write_html_files(pages: DataFrame, path: str) -> None:
    """Each page (page_id, html) as a file, ``12.html``; readers leave out empty files."""
    _files(pages.select("page_id", "html"), path, "html")


def write_token_files(pages: DataFrame, path: str) -> None:
    """Each page's tokens as a file of words, ``12.txt``."""
    _files(pages.select("page_id", F.concat_ws(" ", "tokens").alias("value")), path, "txt")


def to_json(results: DataFrame) -> DataFrame:
    """One JSON object a row, in column ``value``."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("value"))


def json_list(results: DataFrame) -> str:
    """A page of results as a JSON array; the number of rows is bounded by paging."""
    return "[" + ",".join(r["value"] for r in to_json(results).collect()) + "]"


def jdbc_append(df: DataFrame, url: str, name: str, **options: str) -> None:
    df.write.format("jdbc").mode("append").options(url=url, dbtable=name, **options).save()


def create_tables(spark: SparkSession, path: str) -> None:
    """Empty tables of all schemas, in place of any that are there."""
    tables = {
        "pages": schemas.PAGE, "frontier": schemas.FRONTIER, "edges": schemas.EDGES, "postings": schemas.POSTINGS, "document_frequency": schemas.DOCUMENT_FREQUENCY, "images": schemas.IMAGES,
        "image_postings": schemas.IMAGE_POSTINGS, "image_frequency": schemas.IMAGE_FREQUENCY, "users": schemas.USERS, "history": schemas.HISTORY, "queries": schemas.QUERIES,
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")
