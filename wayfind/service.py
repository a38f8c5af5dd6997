"""The search service: what a web front end asks for, as methods over one index.

State is held as snapshots in the shared folder; ``n_pages`` is counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions.analysis import Analyzer
from .operators import interactions, pagerank, search
from .operators.index import Index, with_ranks
from .plans.tables import keep
from .sources.writers import json_list


class SearchService:
    def __init__(self, spark: SparkSession, index: Index, analyzer: Analyzer = Analyzer()):
        self.spark, self.index, self.analyzer = spark, index, analyzer
        self.n_pages = index.n_pages()
        self.users = spark.createDataFrame([], schemas.USERS)
        self.history = spark.createDataFrame([], schemas.HISTORY)
        self.queries = spark.createDataFrame([], schemas.QUERIES)

    def save_query(self, text: str) -> None:
        self.queries = keep(interactions.save_query(self.queries, text), "queries")

    def delete_query(self, text: str) -> None:
        self.queries = keep(self.queries.where(F.col("text") != text), "queries")

    def saved_queries(self, page: int = 0, size: int = 20) -> DataFrame:
        return self.queries.orderBy("text").offset(page * size).limit(size)

    def add_user(self) -> int:
        users, number = interactions.add_user(self.users)
        self.users = keep(users, "users")
        return number

    def add_history(self, user: int, page_id: int) -> None:
        click = self.spark.createDataFrame([(user, page_id)], "user int, page_id long")
        self.history = keep(interactions.add_visits(self.history, click), "history")

    def get_results(self, text: str, page: int = 1, user: int | None = None) -> DataFrame:
        return search.search(self.index, text, self.history, user, page, self.analyzer, self.n_pages, at_once=True)

    def get_results_json(self, text: str, page: int = 1, user: int | None = None) -> str:
        return json_list(self.get_results(text, page, user))

    def get_images(self, text: str, page: int = 1, user: int | None = None) -> DataFrame:
        """``user`` is accepted and changes nothing."""
        return search.search_images(self.index, text, page, analyzer=self.analyzer)

    def suggestions(self, text: str, size: int = 5, page: int = 0) -> DataFrame:
        return search.suggestions(self.queries, text, size, page)

    def update_ranks(self) -> None:
        """Ranks from the link graph, saved with the pages."""
        if self.index.edges is not None:
            ranks = keep(pagerank.page_rank(self.index.edges, self.index.pages.select("page_id")), "ranks")
            self.index = with_ranks(self.index, ranks)
