"""Text analysis, stems, addresses, dates, snippets, query parsing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayfind.functions import analysis, dates, html, snippets, urls
from wayfind.functions.analysis import Analyzer
from wayfind.functions.porter2 import stem
from wayfind.plans.queryparse import parse, query_words, split_quotes

PLAIN = Analyzer(stem=False)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [("a b\\sx c_d é x", ["a", "b", "sx", "c_d", "x"]), ("don't", ["don", "t"]), ("", []), (None, []), ("  ", []), ("مرحبا World", ["مرحبا", "world"]), ("A" * 40, ["a" * 30])],
)
def test_tokens(spark, text, want):
    assert one(spark, analysis.tokens(F.col("t")), t=text) == want


def test_split_before_lower_case(spark):
    # the Kelvin sign would become a k if the text was lower-cased first
    assert one(spark, analysis.tokens(F.col("t")), t="aKb") == ["a", "b"]


def test_arabic_is_neither_lowered_nor_stemmed(spark):
    assert one(spark, analysis.words(F.col("t")), t="كتبing running") == ["كتبing", "run"]


def test_title_words_are_cut_later(spark):
    assert one(spark, analysis.tokens(F.col("t"), 500), t="b" * 40) == ["b" * 40]


def test_stemming_keeps_places(spark):
    df = spark.createDataFrame([("sorting lists",), ("",), (None,), ("the lists sorted quickly",)], "t string")
    got = [r[0] for r in df.select(analysis.words(F.col("t"))).collect()]
    assert got == [["sort", "list"], [], [], ["the", "list", "sort", "quick"]]


def test_single_stems(spark):
    df = spark.createDataFrame([("running",), (None,), ("كتب",), ("running",)], "w string")
    assert [r[0] for r in df.select(analysis.stemmed(F.col("w"))).collect()] == ["run", None, "كتب", "run"]


@pytest.mark.parametrize(
    "word, want",
    [
        ("consistency", "consist"), ("knavish", "knavish"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("feed", "feed"), ("luxuriated", "luxuri"), ("flies", "fli"), ("ties", "tie"),
        ("generously", "generous"), ("algorithms", "algorithm"), ("relational", "relat"), ("happy", "happi"), ("enjoy", "enjoy"), ("by", "by"), ("skies", "sky"), ("news", "news"), ("succeed", "succeed"),
        ("apology", "apolog"), ("this", "this"), ("gas", "gas"), ("kiwis", "kiwi"), ("yes", "yes"), ("", ""),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


@pytest.mark.parametrize(
    "text, loose, quoted",
    [('foo "a b" bar "c"', "foo bar", ["a b", "c"]), ('foo "bar', "foo bar", []), ('"', "", [""]), ('""', "", [""]), ("", "", []), ('"a b" c', "c", ["a b"]), ("  x ", "x", [])],
)
def test_quotes(text, loose, quoted):
    got, phrases = split_quotes(text)
    assert (" ".join(got.replace('"', " ").split()), phrases) == (loose, quoted)


def test_query_words():
    assert query_words("The the", PLAIN) == ["the"]
    assert query_words("كتاب", PLAIN) == []
    assert query_words("Sorting, algorithms!") == ["sort", "algorithm"]
    # stop words go from phrases too
    assert parse('"lord of rings"', PLAIN).phrases == (("lord", "rings"),)


@pytest.mark.parametrize(
    "url, want",
    [
        ("http:////wWw.Fb.cOm////", "http://www.fb.com"), ("https://m.a.net/en/25#top", "http://m.a.net/en/25#top"), ("http://a//b/", "http://a/b"), ("", "http:/"), (None, None), ("HTTP://x/", "http://http:/x"),
        ("http://a/?q=B#C", "http://a/?q=b#c"),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize(F.col("u")), u=url) == want


def test_blocked(spark):
    df = spark.createDataFrame([("http://a/x.pdf",), ("http://a/x.PDF",), ("http://a/x.html",), ("http://a/ts",), ("http://a/b.ts",)], "u string")
    assert [r[0] for r in df.select(urls.is_blocked(F.col("u"))).collect()] == [True, False, False, False, True]


def test_robots(spark):
    text = "User-agent: y\nDisallow: /y\n# all\nUser-agent: *\nDisallow: /a/ # x\nDisallow:\nAllow: /c\nUser-agent: x\nDisallow: /b"
    rules = urls.robots_rules(spark.createDataFrame([("http://h", text), ("http://n", None)], "root string, text string"))
    assert [tuple(r) for r in rules.collect()] == [("http://h", "http://h/a")]
    some = spark.createDataFrame([("http://h/a/1",), ("http://h/b",), ("http://n/a/1",), ("http://h/ab",)], "url string")
    assert sorted(r[0] for r in urls.allowed(some, rules).collect()) == ["http://h/b", "http://n/a/1"]


def test_http_dates(spark):
    shown = "Sat, 13 Jan 2024 07:08:09 GMT"
    assert one(spark, dates.parse_http_date(F.col("t")), t=shown) == datetime(2024, 1, 13, 7, 8, 9)
    assert one(spark, dates.format_http_date(dates.parse_http_date(F.col("t"))), t=shown) == shown
    assert one(spark, dates.parse_http_date(F.col("t")), t="no date") is None


def test_snippet(spark):
    tokens = [str(i) for i in range(25)]
    df = spark.createDataFrame([(tokens, [3, 20, 1]), (tokens, [100]), ([], [0])], "t array<string>, p array<int>")
    got = [r[0] for r in df.select(snippets.snippet(F.col("t"), F.col("p"))).collect()]
    window = lambda a, b: " ".join(tokens[a:b]) + "... "
    # the first hits come in order of place
    assert got[0] == window(0, 9) + window(0, 11) + window(12, 25)
    assert got[1:] == ["... ", "... "]


def test_html_body_order():
    got = html.parse("<title>T one</title><h1>H</h1><p>x <b>y</b></p><li>z</li>")
    assert got["body"] == "T one H y x y"
    assert got["title"] == "T one" and got["description"] is None


def test_html_repairs():
    page = '<p><b>Bold<br><p>next &amp; more</p><script>var t="</p>";</script><ul><li>one<li>two</ul><p>end'
    assert html.parse(page)["body"].split("Bold")[0] == ""
    assert "var" not in html.parse(page)["body"]
    assert html.parse(None)["body"] == "" and html.parse("")["links"] == []


def test_html_links_and_images():
    page = '<meta name="description" content="first"><meta name="description" content="last"><a href="/r">r</a><a href="http://Z/">z</a><img src="/i.png" alt="a cat"><img src="http://h/j.png"><img src="http://h/k.png" alt="dog">'
    plain = html.parse(page)
    assert plain["links"] == ["http://Z/"] and plain["images"] == [{"url": "http://h/k.png", "description": "dog"}] and plain["description"] == "last"
    full = html.parse(page, "http://h/p")
    assert full["links"] == ["http://h/r", "http://Z/"] and len(full["images"]) == 2


def test_queries_parse_natively_as_one_by_one(spark):
    import random

    from wayfind.functions.analysis import Analyzer
    from wayfind.plans.queryparse import parse, parsed

    r, plain = random.Random(8), Analyzer(stem=False)
    texts = ["", '"', '""', ' "', '"a', 'a"', 'foo "a b" bar "c"', 'foo "bar', "The the", "don't é_x مح", '\t"x"y" z', None]
    texts += ["".join(r.choice(['"', " ", "the", "Word", "b", "-", "\n"]) for _ in range(r.randint(1, 14))) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", parsed(F.col("text"), plain).alias("q")).collect()
    for row in got:
        want = parse(texts[row.id] or "", plain)
        assert (tuple(row.q.words), tuple(map(tuple, row.q.phrases))) == (want.words, want.phrases), texts[row.id]


def test_hot_keys_are_dealt_out_and_joined_whole(spark):
    from wayfind.plans.joins import join_dealt

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}" if i % 2 else None) for i in range(3000)], "id int, k string")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), *((f"k{i}", i) for i in range(0, 40))], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(other, "k", how).select("id", "k", "v").collect()))
        assert sorted(map(str, join_dealt(rows, other, "k", spread="id", how=how).select("id", "k", "v").collect())) == want
    assert join_dealt(rows.limit(0), other, "k", spread="id").count() == 0
