r"""A data source that fetches addresses: one row a page, spread over partitions.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("list", "\n".join(urls)).option("partitions", 32).load()

A page that cannot be fetched has a null html, so that it can be queued again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT = "wayfind"
MOST_BYTES = 16 << 20


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("list", "").split("\n") if u]
        self.parts = max(1, int(options.get("partitions", "8")))
        self.seconds = float(options.get("timeout", "5"))

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.urls[i :: self.parts]) for i in range(min(self.parts, len(self.urls)))] or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.urls:
            now, html, changed = datetime.now(UTC).replace(tzinfo=None), None, None
            try:
                with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=self.seconds) as answer:
                    html = answer.read(MOST_BYTES).decode(answer.headers.get_content_charset() or "utf-8", "replace")
                    changed = answer.headers.get("Last-Modified")
            except (OSError, ValueError, LookupError):
                pass
            yield url, html, now, changed


class PageSource(DataSource):
    """(url, html, crawled_time, last_modified); the addresses are lines of the option ``list``, of bounded size like a crawl's round."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string, crawled_time timestamp, last_modified string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
