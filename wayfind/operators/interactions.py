"""Users, visits and saved queries, as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import insert_ignore


def add_user(users: DataFrame) -> tuple[DataFrame, int]:
    """The users with one more, and its number: one above the largest."""
    number = (users.agg(F.max("user")).first()[0] or 0) + 1
    return users.unionByName(users.sparkSession.createDataFrame([(number,)], "user int")), number


def user_by_count(users: DataFrame) -> DataFrame:
    """The user whose number is the number of users, as a scalar subquery."""
    return users.sparkSession.sql("SELECT * FROM {users} WHERE user = (SELECT count(user) FROM {users})", users=users)


def visits(clicks: DataFrame) -> DataFrame:
    """(user, page_id, times) from single clicks."""
    return clicks.groupBy("user", "page_id").agg(F.count("*").cast("int").alias("times"))


def add_visits(history: DataFrame, clicks: DataFrame) -> DataFrame:
    """History with new clicks added to the counts."""
    both = history.select("user", "page_id", "times").unionByName(visits(clicks))
    return both.groupBy("user", "page_id").agg(F.sum("times").cast("int").alias("times"))


def save_query(queries: DataFrame, text: str) -> DataFrame:
    return insert_ignore(queries, queries.sparkSession.createDataFrame([(text[:500],)], "text string"), ["text"])
