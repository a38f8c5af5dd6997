"""Crawl, streaming, sources, the load test and the driver's queries."""

import hashlib
import os
import subprocess
import sys
from datetime import datetime
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import duckdb
import pytest

import __spark_entry__ as entry
from wayfind import queries as q
from wayfind import schemas
from wayfind.functions import html
from wayfind.functions.analysis import Analyzer
from wayfind.operators import crawl, index, interactions
from wayfind.plans.loadtest import load_test, request_url
from wayfind.sources import readers, writers
from wayfind.sources.fetch import PageSource
from wayfind.streaming import indexer

from .conftest import ROOT

PLAIN = Analyzer(stem=False)


def page(*hrefs):
    return "<p>x</p>" + "".join(f'<a href="{h}">l</a>' for h in hrefs)


@pytest.fixture
def site(spark):
    rows = [(1, "http://s/1", page("/2", "/3", "/x.pdf")), (2, "http://s/2", page("/4", "/1")), (3, "http://s/3", page("/private/5")), (4, "http://s/4", None), (5, "http://s/private/5", page("/6"))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_crawl(spark, site):
    seeds = spark.createDataFrame([("HTTP://s/1",), ("http://s/1/",)], "url string").where("url like 'http%'")
    visited, rest = crawl.crawl(site, seeds)
    assert sorted(map(tuple, visited.collect())) == [("http://s/1", 0), ("http://s/2", 1), ("http://s/3", 1), ("http://s/4", 2), ("http://s/6", 3), ("http://s/private/5", 2)]
    assert rest.count() == 0
    rules = spark.createDataFrame([("http://s", "http://s/private")], "root string, prefix string")
    assert crawl.crawl(site, seeds, rules)[0].count() == 4
    visited, rest = crawl.crawl(site, seeds, most_visited=2)
    assert visited.count() == 2 and rest.count() > 0
    assert crawl.crawl(site, seeds, most_known=2)[0].count() == 2
    # one address a round, first queued first
    assert [r.url for r in crawl.crawl(site, seeds, take=1, rounds=3)[0].orderBy("round").collect()] == ["http://s/1", "http://s/2", "http://s/3"]


def test_crawl_goes_on(spark, site):
    seeds = spark.createDataFrame([("http://s/1",)], "url string")
    visited, rest = crawl.crawl(site, seeds, rounds=1)
    again, rest = crawl.crawl(site, rest, before=visited)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, crawl.crawl(site, seeds)[0].collect()))


def test_fetch(spark, tmp_path):
    class Quiet(SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=str(tmp_path))

        def log_message(self, *args):
            pass

    (tmp_path / "a.html").write_text("<p>é</p>")
    server = ThreadingHTTPServer(("127.0.0.1", 0), Quiet)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(PageSource)
    got = {r.url: r for r in spark.read.format("pages").option("list", f"{base}/a.html\n{base}/none.html\nno address").option("partitions", 2).load().collect()}
    server.shutdown()
    assert got[f"{base}/a.html"].html == "<p>é</p>" and got[f"{base}/a.html"].last_modified.endswith("GMT")
    assert got[f"{base}/none.html"].html is None and got["no address"].html is None


def test_create_tables(spark, tmp_path):
    writers.create_tables(spark, str(tmp_path / "t"))
    assert readers.table(spark, str(tmp_path / "t/postings")).schema == schemas.POSTINGS
    assert readers.modified_time(spark, str(tmp_path / "t")) is not None


def test_fetch_again(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1L, timestamp'2024-01-01 10:00:00', timestamp'2024-01-01 11:00:00'), (2L, timestamp'2024-01-01 10:00:00', timestamp'2024-01-01 09:00:00'), "
        "(3L, timestamp'2024-01-01 10:00:00', null), (4L, timestamp'2024-01-01 11:30:00', null) t(page_id, crawled_time, last_modified)"
    )
    assert sorted(r.page_id for r in crawl.to_fetch_again(df, datetime(2024, 1, 1, 12)).collect()) == [1, 3]


def test_refreshed(spark):
    pages = spark.sql("SELECT 'a' url, 'old' html, timestamp'2024-01-01' crawled_time UNION ALL SELECT 'b', 'old', timestamp'2024-01-01'")
    new = spark.sql("SELECT 'b' url, 'new' html, timestamp'2024-01-02' crawled_time")
    assert sorted((r.url, r.html) for r in crawl.refreshed(pages, new).collect()) == [("a", "old"), ("b", "new")]


def test_streamed_index_equals_batch(spark, site, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "index")
    site.coalesce(1).write.parquet(source)
    indexer.follow(spark, source, path, str(tmp_path / "state"), analyzer=PLAIN).awaitTermination()
    changed = spark.createDataFrame([(2, "http://s/2", page("http://s/3") + "<p>new words</p>")], "page_id long, url string, html string")
    changed.coalesce(1).write.mode("append").parquet(source)
    indexer.follow(spark, source, path, str(tmp_path / "state"), analyzer=PLAIN).awaitTermination()
    got = indexer.load(spark, path)
    want = index.from_pages(site.where("page_id != 2").unionByName(changed), PLAIN)
    assert sorted(got.postings.collect()) == sorted(want.postings.collect())
    assert sorted(map(tuple, got.edges.collect())) == sorted(map(tuple, want.edges.collect()))
    indexer.compact(spark, path, str(tmp_path / "compact"))
    assert sorted(index.read(spark, str(tmp_path / "compact"), ()).postings.collect()) == sorted(want.postings.collect())


def test_files(spark, tmp_path):
    (tmp_path / "7.html").write_text("<p>é</p>")
    (tmp_path / "x.html").write_text("no number")
    assert [tuple(r) for r in readers.html_files(spark, str(tmp_path)).collect()] == [(7, "<p>é</p>")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/3.txt").write_text("a b c")
    assert [tuple(r) for r in readers.text_files(spark, str(tmp_path / "t")).collect()] == [(3, ["a", "b", "c"])]
    (tmp_path / "seeds").write_text("http://a\n\nhttp://b\n")
    assert sorted(r.url for r in readers.lines(spark, str(tmp_path / "seeds")).collect()) == ["http://a", "http://b"]
    assert readers.stop_words(spark, str(tmp_path / "seeds")) == {"http://a", "http://b"}
    (tmp_path / "conf").write_text("# x\ndb = name\nuser=me\n")
    assert readers.settings(spark, str(tmp_path / "conf")) == {"db": "name", "user": "me"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None)], "page_id long, url string, html string")
    writers.write_pages(df, str(tmp_path / "p"))
    assert readers.table(spark, str(tmp_path / "p")).count() == 1
    assert writers.json_list(df) == '[{"page_id":1,"url":"a","html":null}]'
    writers.write_token_texts(spark.createDataFrame([(1, ["a", "b"])], "page_id long, tokens array<string>"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "a b"


def test_newest_user(spark):
    users = spark.createDataFrame([(1,), (2,)], "user int")
    assert [r.user for r in interactions.user_by_count(users).collect()] == [2]


def test_load_test(spark):
    rows = load_test(spark, lambda: spark.range(3).count(), start=2, step=1, most_seconds=60, most_rounds=2).collect()
    assert [r.threads for r in rows] == [2, 3] and not any(r.timed_out for r in rows)
    assert load_test(spark, lambda: spark.range(3).count(), start=1, most_seconds=0.0).count() == 1
    assert request_url("http://h/q", text="a b", page=1) == "http://h/q?text=a+b&page=1"


def _plain(value):
    if value is None or value != value:
        return None
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_queries_match_sql(spark, sf, name):
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "documents", "events", "part", "lineitem", "orders", "pages", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = connection.sql(q.SQL[name])
    got = q.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(map(str, map(_plain, r))) for r in got.select(*columns).collect()) == sorted(tuple(map(str, map(_plain, r))) for r in want.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_other_queries_run(spark, sf, name):
    assert q.QUERIES[name](spark, sf).columns


def test_every_user_turn_is_asked(spark, sf):
    connection = duckdb.connect()
    for t in ("documents", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    # the registered comparison, with all user turns, numbered, for those of turn 0
    sql = q.SQL["search_many"].replace("FROM conversations WHERE role = 'user' AND turn = 0 GROUP BY conv_id", "FROM a GROUP BY conv_id")
    numbered = "a AS (SELECT conv_id * 1000 + turn AS conv_id, text FROM conversations WHERE role = 'user'),"
    want = connection.sql(sql.replace("WITH ", f"WITH {numbered} ", 1)).fetchall()
    got = q.search_every_turn(spark, sf).selectExpr("conv_id * 1000 + turn", "page_id", "relevance", "important", "place").collect()
    assert sorted(tuple(map(_plain, r)) for r in got) == sorted(tuple(map(_plain, r)) for r in want)
    assert len({r[0] for r in got}) > len({r[0] for r in q.search_many(spark, sf).select("query_id").collect()})


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(q.QUERIES) <= set(entry.queries())


def test_pages_and_tokens_as_files(spark, tmp_path):
    """A file for each page, named by its number, with whatever text; writing again replaces."""
    from wayfind.sources import readers, writers

    rows = [(1, "<p>é\r\n\n x"), (101, ""), (7, None), (12345, "y" * 100_000)]
    for _ in range(2):
        writers.write_html_files(spark.createDataFrame(rows, "page_id long, html string"), f"{tmp_path}/html")
    assert {r.page_id: r.html for r in readers.html_files(spark, f"{tmp_path}/html").collect()} == {i: t for i, t in rows if t}
    writers.write_token_files(spark.createDataFrame([(3, ["a", "b"]), (4, ["c"])], "page_id long, tokens array<string>"), f"{tmp_path}/txt")
    assert {r.page_id: r.tokens for r in readers.text_files(spark, f"{tmp_path}/txt").collect()} == {3: ["a", "b"], 4: ["c"]}


def test_many_pages_without_links_take_the_loop(spark):
    """Nodes count for the one-task path as edges do; the result is the same."""
    from wayfind.operators import pagerank

    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")
    nodes = spark.range(1, 40).withColumnRenamed("id", "page_id")
    assert "FlatMapGroupsInArrow" in pagerank.page_rank(edges, nodes)._jdf.queryExecution().toString()
    by_loop = pagerank.page_rank(edges, nodes, small=10)
    assert "FlatMapGroupsInArrow" not in by_loop._jdf.queryExecution().toString()
    one = {r.page_id: round(r.page_rank, 6) for r in pagerank.page_rank(edges, nodes).collect()}
    assert {r.page_id: round(r.page_rank, 6) for r in by_loop.collect()} == one and len(one) == 39


SEPARATE = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry

conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": sys.argv[1], "spark.executor.memory": "600m", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.master("local-cluster[2,1,1000]").config(map=conf).getOrCreate()
print("ROWS", sorted(map(tuple, entry.queries()["jdbc_table"](spark, sys.argv[2]).collect())) == [(1, "a 'b'", 3), (2, None, None), (3, "", 1)])
"""


def test_jdbc_table_where_executors_are_processes_of_their_own(spark, tmp_path):
    spark.createDataFrame([(1, "a 'b'", 3), (2, None, None), (3, "", 1)], "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    done = subprocess.run([sys.executable, "-B", "-c", SEPARATE, f"file://{tmp_path}/shared", str(tmp_path)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert "ROWS True" in done.stdout, done.stderr[-2000:]


def test_embedded_database_keeps_rows_without_a_key(spark, tmp_path):
    spark.createDataFrame([(None, "x", 3), (4, "y", 1)], "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert sorted(map(str, map(tuple, q.jdbc_table(spark, str(tmp_path)).collect()))) == ["(4, 'y', 1)", "(None, 'x', 3)"]


def test_page_titles_stand_as_typed(spark, tmp_path):
    rows = [(1, "http://a", "<title> a &quot;b&quot; c &am</title>"), (2, "http://a", f"<title>{'x' * 300}&amp</title>"), (3, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.title for r in q.page_titles(spark, str(tmp_path)).collect()} == {1: "a &quot;b&quot; c &am", 2: "x" * 300 + "&amp", 3: None}


def test_pages_of_one_address_are_refreshed_each(spark, tmp_path):
    rows = [(i, "http://a", f"old {i}") for i in range(5)] + [(6, None, "old 6"), (6, None, "old 6")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = sorted((i, hashlib.md5(f"{'old' if i % 3 else 'new'} {i}".encode()).hexdigest()) for i, *_ in rows)
    assert sorted((r.page_id, r.digest) for r in q.pages_refreshed(spark, str(tmp_path)).collect()) == want


@pytest.fixture
def cut(spark, tmp_path):
    """Pages whose titles end within a reference, and tables of their SQL."""
    text = "T token = &quot", "A &copy", "B &am", "C &amp", "D &quot;x&quot; &copy; &middot; &amp;quot; &ampx"
    rows = [(i, f"http://p/{i}", f"<html><title>{t}</title><h1>H {t}</h1><p>one <p><b>two {t}</b>") for i, t in enumerate(text)] + [(9, "http://p/9", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    return lambda name: (sorted(map(str, map(tuple, q.QUERIES[name](spark, str(tmp_path)).collect()))), sorted(map(str, connection.execute(q.SQL[name]).fetchall())))


def test_cut_references_in_text(cut):
    got, want = cut("html_body_text")
    assert got == want


def test_references_as_in_browsers_or_strict():
    assert html.parse("<title>a&quot b&copy;&lt</title>")["title"] == 'a" b©<'
    assert html.parse("<title>a&quot b&copy;&lt;&#33;&#33 &amp</title>", loose=False)["title"] == "a&quot b©<!&#33 &"


@pytest.mark.parametrize("name", ["pages_index", "pages_postings", "streamed_index"])
def test_cut_references_in_indexes(cut, name):
    got, want = cut(name)
    assert got == want
