"""Index, ranks and search against hand-computed values."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfind import schemas
from wayfind.functions.analysis import Analyzer
from wayfind.operators import index, pagerank, search
from wayfind.plans.queryparse import Query
from wayfind.service import SearchService

PLAIN = Analyzer(stem=False, stop_words=frozenset())
PAGES = [(1, "Sort lists", "sort lists fast sort", 2.0), (2, "Data", "sort data lists", 5.0), (3, "Fast data", "fast data", 1.0), (4, "Misc", "nothing here", 1.0)]
TEXTS = "page_id long, url string, title string, description string, body string, title_words string"


def texts(spark, rows):
    return spark.createDataFrame([(i, f"http://p/{i}", t, None, b, t) for i, t, b, *_ in rows], TEXTS)


@pytest.fixture(scope="module")
def made(spark):
    ranks = spark.createDataFrame([(i, r) for i, _, _, r in PAGES], "page_id long, page_rank double")
    return index.with_ranks(index.from_texts(texts(spark, PAGES), PLAIN), ranks)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_words(made):
    got = {r.page_id: r for r in search.words_relevance(made.postings, ["sort", "sort"], 4).collect()}
    assert got[1].relevance == pytest.approx(2 * (1 + math.log(2)) * math.log(3)) and got[1].important == 1
    assert got[2].relevance == pytest.approx(math.log(3)) and got[2].important == 0


def test_phrase(made):
    got = search.phrase_relevance(made.postings, ["sort", "lists"], 4).collect()
    assert [(r.page_id, r.indices, r.important) for r in got] == [(1, [0], 1)]
    assert got[0].relevance == pytest.approx(math.log(5))


def test_phrase_with_a_repeated_word(spark):
    found = index.from_texts(texts(spark, [(1, "", "a a b a a a", 1.0), (2, "", "a b a", 1.0)]), PLAIN)
    assert rows(search.phrase_matches(found.postings, ["a", "a"]), "page_id", "starts") == [(1, [0, 3, 4])]
    assert rows(search.phrase_matches(found.postings, ["a"]).orderBy("page_id"), "page_id", "starts") == [(1, [0, 1, 3, 4, 5]), (2, [0, 2])]


def test_mixed_and_ranks(made):
    got = search.ranked(made, Query(("sort",), (("sort", "lists"),))).collect()
    assert [(r.page_id, r.important, r.is_phrase) for r in got] == [(1, 2, 1), (2, 0, 0)]
    assert [r.score for r in got] == pytest.approx([10.659325, 5.493061], abs=1e-6)


def test_equal_phrases_count_once(made):
    twice = search.ranked(made, Query((), (("sort", "lists"), ("sort", "lists")))).collect()
    assert [r.relevance for r in twice] == pytest.approx([math.log(5)])


def test_visited_pages_come_first(spark, made):
    history = spark.createDataFrame([(7, 2, 1)], "user int, page_id long, times int")
    query = Query(("sort",), (("sort", "lists"),))
    assert rows(search.ranked(made, query, history, 7), "page_id") == [(2,), (1,)]
    assert rows(search.ranked(made, query, history, 8), "page_id") == [(1,), (2,)]
    # the page of results is chosen before ranks count
    assert rows(search.ranked(made, query, size=1), "page_id") == [(1,)]
    assert rows(search.ranked(made, query, history, 7, size=1), "page_id") == [(2,)]
    assert rows(search.ranked(made, query, page=2, size=1), "page_id") == [(2,)]


def test_nothing_asked(made):
    for query in (Query((), ()), Query((), ((),))):
        got = search.ranked(made, query)
        assert got.count() == 0 and "snippet" in got.columns
    assert search.search(made, '"', analyzer=PLAIN).count() == 0
    assert search.search_images(made, "x").count() == 0


def test_many_queries_agree_with_single_ones(spark, made):
    asked = spark.createDataFrame([(1, ["sort", "sort"]), (2, ["data", "fast"]), (3, ["absent"])], "query_id long, words array<string>")
    got = sorted(rows(search.search_many(made, asked), "query_id", "place", "page_id"))
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 2), (2, 3, 1)]


def test_positions_and_counts(made):
    worded = index.with_words(made.pages.select("page_id", F.col("title").alias("title_words"), F.array_join("tokens", " ").alias("body")), PLAIN)
    counts = {(r.word, r.page_id): r["count"] for r in index.term_counts(worded).collect()}
    posts = made.postings.collect()
    assert counts == {(r.word, r.page_id): r["count"] for r in posts}
    assert all(r["count"] == len(r.positions) for r in posts)
    for page in range(1, 5):
        places = sorted(p for r in posts if r.page_id == page for p in r.positions)
        assert places == list(range(len(places)))


def test_written_index_gives_the_same(spark, made, tmp_path):
    index.write(made, str(tmp_path / "i"))
    again = index.read(spark, str(tmp_path / "i"), parts=())
    query = Query(("sort", "data"), (("sort", "lists"),))
    assert search.ranked(again, query).collect() == search.ranked(made, query).collect()
    at_once = search.ranked(again, query, at_once=True)
    assert at_once.collect() == search.ranked(made, query).collect()
    plan = at_once._jdf.queryExecution().executedPlan().toString()
    assert "In(page_id, [1,2,3])" in plan
    assert search.ranked(again, Query(("absent",), ()), at_once=True).collect() == []


def test_words_reach_the_scan(spark, made, tmp_path):
    index.write(made, str(tmp_path / "i"))
    again = index.read(spark, str(tmp_path / "i"), parts=())
    plan = again.postings.where(F.col("word").isin("sort", "data"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(word, [data,sort])]" in plan


def test_reindexing_equals_rebuilding(spark, made):
    changed = [(2, "Data now", "fast sort", 5.0), (9, "New", "data", 1.0)]
    got = index.reindex(made, texts(spark, changed), PLAIN)
    rebuilt = index.from_texts(texts(spark, [r for r in PAGES if r[0] != 2] + changed), PLAIN)
    assert sorted(got.postings.collect()) == sorted(rebuilt.postings.collect())
    assert sorted(got.frequencies.collect()) == sorted(rebuilt.frequencies.collect())
    assert {r.page_id: r.page_rank for r in got.pages.collect()} == {1: 2.0, 2: 5.0, 3: 1.0, 4: 1.0, 9: 1.0}


def test_snapshots(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, index.insert_ignore(t, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, index.update(t, new.where("k = 2"), ["k"]).collect())) == [(1, "a"), (2, "x")]
    assert sorted(map(tuple, index.delete(t, new, ["k"]).collect())) == [(1, "a")]


def test_page_states(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01', null), (2L, timestamp'2024-01-01', timestamp'2024-01-02'), (3L, timestamp'2024-01-01', timestamp'2024-01-01') t(page_id, crawled_time, indexed_time)")
    assert rows(index.page_states(df).orderBy("page_id"), "state") == [("CRAWL",), ("SKIP",), ("RECRAWL",)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_pagerank(spark):
    pairs = [(1, 2), (2, 1), (3, 1)]
    got = {r.page_id: r.page_rank for r in pagerank.page_rank(edges(spark, pairs)).collect()}
    assert [got[i] for i in (1, 2, 3)] == pytest.approx([6.967766, 6.638444, 0.716667], abs=1e-6)
    exact = {r.page_id: r.page_rank for r in pagerank.page_rank_exact(edges(spark, pairs)).collect()}
    assert [exact[i] for i in (1, 2, 3)] == pytest.approx([6.972973, 6.643694, 0.716667], abs=1e-6)


def test_pagerank_self_links_and_dangling(spark):
    got = {r.page_id: r.page_rank for r in pagerank.page_rank(edges(spark, [(1, 1), (1, 2)])).collect()}
    assert [got[1], got[2]] == pytest.approx([0.575, 0.819375])
    alone = spark.createDataFrame([(1,), (2,), (7,)], "page_id long")
    assert {r.page_id for r in pagerank.page_rank(edges(spark, [(1, 2)]), alone).collect()} == {1, 2, 7}


def test_pagerank_loop_of_joins_agrees(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2))})
    table = edges(spark, pairs)
    fast = {r.page_id: r.page_rank for r in pagerank.page_rank(table).collect()}
    slow = {r.page_id: r.page_rank for r in pagerank.page_rank(table, small=-1).collect()}
    assert fast == pytest.approx(slow)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=30, unique=True))
def test_iteration_comes_near_the_fixed_point(pairs):
    nodes = sorted({x for p in pairs for x in p})
    src, dst = (np.searchsorted(nodes, [p[i] for p in pairs]) for i in (0, 1))
    rank, _ = pagerank.iterate(src, dst, len(nodes))
    exact = pagerank.solve(src, dst, len(nodes))
    # the map contracts by 0.85 in the sum of absolute values
    assert np.abs(rank - exact).sum() <= 0.85 / 0.15 * len(nodes) * pagerank.TOLERANCE
    assert rank.min() >= 1 - 0.85 / len(nodes) - 1e-12


def test_pages_to_index(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a/1", '<title>Cats</title><p>Running cats</p><a href="http://a/2/">x</a><a href="http://a/1">me</a><img alt="black cats" src="http://i/1.png">'),
            (2, "https://A/2", '<p>Dogs</p><a href="http://a/1">b</a>'),
            (3, "http://a/3", None),
        ],
        "page_id long, url string, html string",
    )
    made = index.from_pages(pages)
    assert sorted(map(tuple, made.edges.collect())) == [(1, 2), (2, 1)]
    assert {(r.word, r.page_id): (r["count"], r.important) for r in made.postings.collect()} == {("cat", 1): (2, True), ("run", 1): (1, False), ("dog", 2): (1, False)}
    assert rows(search.search_images(made, "black cat"), "url", "matched") == [("http://i/1.png", 2)]
    assert made.pages.count() == 3


def test_service(spark, made):
    service = SearchService(spark, made, PLAIN)
    assert service.add_user() == 1 and service.add_user() == 2
    service.add_history(1, 2)
    service.add_history(1, 2)
    assert rows(service.history, "user", "page_id", "times") == [(1, 2, 2)]
    assert rows(service.get_results('sort "sort lists"', user=1), "page_id") == [(2,), (1,)]
    for text in ("Sorting", "sort lists", "sort lists", "other"):
        service.save_query(text)
    assert rows(service.suggestions("SORT"), "text") == [("Sorting",), ("sort lists",)]
    service.delete_query("other")
    assert service.saved_queries().count() == 2
    assert '"page_id":1' in service.get_results_json("sort")


def test_search_many_in_blocks(spark, monkeypatch):
    """Blocks of pages meet blocks of queries; the pairs that share a word are no rows, whatever their number."""
    for name, n in (("PAGES_OF_BLOCK", 3), ("QUERIES_OF_BLOCK", 4), ("QUERIES_AT_ONCE", 2)):
        monkeypatch.setattr(search, name, n)
    rng = random.Random(5)
    some = [f"w{i}" for i in range(12)]
    bodies = [[rng.choice(some) for _ in range(rng.randrange(1, 15))] for _ in range(30)]
    bodies += [sorted(b) for b in bodies[:10]] + [b[::-1] for b in bodies[:10]]  # the same words in another order: ties
    texts = spark.createDataFrame([(i, "u", b[0], None, " ".join(b), b[0] if i % 3 else "") for i, b in enumerate(bodies)], "page_id long, url string, title string, description string, body string, title_words string")
    asked = [("a", ["w1"]), ("b", ["w1", "w2", "w1"]), ("c", some), ("d", ["none"]), ("e", []), ("f", None)] + [(f"q{i}", rng.sample(some, 4)) for i in range(9)]
    n, df = len(bodies), {w: sum(w in b for b in bodies) for w in some}
    want = []
    for key, words in asked:
        scored = []
        for i, b in enumerate(bodies):
            common = sorted(set(words or ()) & set(b))
            if common:
                relevance = sum(b.count(w) * (1 + math.log(b.count(w))) * math.log(1 + n / df[w]) for w in common)
                scored.append((-sum(w == b[0] and i % 3 > 0 for w in common), -round(relevance, 9), i))
        want += [(key, place, i, round(-r, 6), -m) for place, (m, r, i) in enumerate(sorted(scored)[:4], 1)]
    found = search.search_many(index.from_texts(texts, Analyzer(stem=False)), spark.createDataFrame(asked, "query_id string, words array<string>"), size=4)
    assert sorted((r.query_id, r.place, r.page_id, round(r.relevance, 6), r.important) for r in found.collect()) == sorted(want)
    assert "CoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_search_many_without_pages_or_queries(spark):
    none = spark.createDataFrame([], "page_id long, url string, title string, description string, body string, title_words string")
    asked = spark.createDataFrame([(1, ["a"])], "query_id long, words array<string>")
    assert search.search_many(index.from_texts(none, Analyzer(stem=False)), asked).count() == 0
    page = spark.createDataFrame([(1, "u", "a", None, "a b", "a")], none.schema)
    assert search.search_many(index.from_texts(page, Analyzer(stem=False)), asked.where("false")).count() == 0


def test_equal_pages_have_equal_sums(spark):
    """Pages of the same words, in whatever order and block, differ in no bit, so ties fall to the smaller page_id."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60) for _ in range(i % 7 + 1)]
    pages = []
    for i in range(40):
        rng.shuffle(words)
        pages.append((i, "", " ".join(words)))
    others = [(100 + i, "", " ".join(f"w{j}" for j in range(60) if j % (i + 2) == 0)) for i in range(20)]
    asked = spark.createDataFrame([(1, [f"w{i}" for i in range(60)])], "query_id long, words array<string>")
    found = search.search_many(index.from_texts(texts(spark, pages + others).repartition(5), PLAIN), asked, size=40).collect()
    assert len({r.relevance for r in found}) == 1 and [r.page_id for r in sorted(found, key=lambda r: r.place)] == list(range(40))


def test_pages_that_weigh_the_same_have_equal_sums(spark, monkeypatch):
    """Equal counts at other words of the same frequency add up to the same, so ties fall to the smaller page_id, in blocks of any size."""
    words = [f"w{i}" for i in range(5)]
    pages = list(itertools.permutations((3, 700_001, 1_200_003, 90_007, 4_000_037)))
    hits = [(w, page, count, False, []) for page, counts in enumerate(pages) for w, count in zip(words, counts, strict=True)]
    made = index.Index(spark.range(len(pages)).withColumnRenamed("id", "page_id"), spark.createDataFrame(hits, schemas.POSTINGS).repartition(3))
    asked = spark.createDataFrame([(1, words), (2, words[::-1]), (3, [*words, "none"])], "query_id long, words array<string>")
    want = math.fsum(c * (1 + math.log(c)) * math.log1p(1.0) for c in pages[0])
    for of_block in (4096, 25):
        monkeypatch.setattr(search, "PAGES_OF_BLOCK", of_block)
        found = sorted(search.search_many(made, asked, size=20).collect(), key=lambda r: (r.query_id, r.place))
        assert [(r.query_id, r.page_id) for r in found] == [(q, page) for q in (1, 2, 3) for page in range(20)]
        assert len({r.relevance for r in found}) == 1 and math.isclose(found[0].relevance, want, rel_tol=1e-14)


@pytest.mark.parametrize("lookups", [1, 7, 1 << 20])
def test_exact_sums(monkeypatch, lookups):
    """The sum of each pair of query and page is the exact one, rounded once, in slices of any size."""
    monkeypatch.setattr(search, "LOOKUPS_AT_ONCE", lookups)
    rng = np.random.default_rng(4)
    n_words, n_pages, n_queries = 40, 30, 9
    weights = rng.lognormal(3, 4, (n_words, n_pages)) * (rng.random((n_words, n_pages)) < 0.6)
    keys = np.flatnonzero(weights.ravel())
    of_query = [rng.permutation(n_words)[: rng.integers(1, n_words)] for _ in range(n_queries)]
    first = np.cumsum([0, *map(len, of_query)])
    row, page = np.sort(rng.integers(0, n_queries, 50)), rng.integers(0, n_pages, 50)
    got = search._exact(weights.ravel()[keys], keys, np.concatenate(of_query), first, row, page, n_pages)
    want = [math.fsum(weights[of_query[r], p]) for r, p in zip(row, page, strict=True)]
    assert np.allclose(got, want, rtol=3e-16, atol=1e-18)
    assert search._exact(weights.ravel()[keys], keys, np.concatenate(of_query), first, row[:0], page[:0], n_pages).size == 0
