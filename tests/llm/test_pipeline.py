"""The pipeline, stage by stage and whole, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from wayfind.llm import op10_decontaminate
from wayfind.llm.op9_toxicity import toxicity

from .test_ops import DOCS, base_spans, components_want, distance_want, edited, prose, targets_want

TOXIC = ("wretched", "vilest", "loathsome")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    items = {i: prose(14, r) for i in range(4)}
    texts, labels = [], []
    for i in range(240):
        w = prose(r.randint(30, 90), r).split()
        toxic = r.random() < 0.2
        for _ in range(4 * toxic):
            w[r.randrange(len(w))] = r.choice(TOXIC)
        if i % 11 == 0:
            w.insert(3, edited(items[r.randrange(4)], i % 3, r))
        if i % 7 == 0:
            w.insert(5, r.choice(["a.b@c.de", "10.1.2.3", "4111 1111 1111 1111", "+1 (456) 555-2186"]))
        if i % 5 == 0 and texts:
            w = r.choice(texts).split()
            w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
        labels.append((i, 1, int(any(x in TOXIC for x in w))))
    texts += [None, "", texts[3]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(enumerate(texts)), items


def redacted(text):
    if text is None:
        return None
    out, at = [], 0
    for start, _, end, kind in base_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages_and_run(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")

    def step(name, docs):
        out = dict(cp.STAGES)[name](spark, docs, path)
        out.write.parquet(to := f"{path}/out-{name}")
        return spark.read.parquet(to)

    def held(df):
        return {r.doc_id: r.text for r in df.collect()}

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "personal_data", "mixing"]
    one = step("toxicity", docs)
    rejected = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{path}/labels.parquet")).where("predicted = 1").collect()}
    assert held(one) == {i: t for i, t in texts.items() if i not in rejected}
    # what is rejected is what holds the words
    assert rejected == {i for i, t in texts.items() if set((t or "").split()) & set(TOXIC)}

    two = step("near_dedup", one)
    want = components_want(list(held(one).items()), 5)
    assert held(two) == {i: texts[i] for i, (_, _, kept) in want.items() if kept}

    three = step("decontamination", two)
    found = lambda t: any(distance_want(u, op10_decontaminate.normal(t)) <= len(u) // op10_decontaminate.CHARS_PER_EDIT for u in items.values())
    clean = {i: t for i, t in held(two).items() if not t or not found(t)}
    assert held(three) == clean and len(clean) < two.count()

    four = step("personal_data", three)
    assert held(four) == {i: redacted(t) for i, t in clean.items()}
    assert any("[EMAIL]" in (t or "") for t in held(four).values())
    for table in (one, two, three, four):
        assert table.columns == list(cp.COLUMNS)
    assert all(r.n_chars == len(r.text) for r in four.where("text is not null").collect())

    five = {r.doc_id: r for r in step("mixing", four).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in held(four).items()}
    source = {i: "abc"[i % 3] for i in size}
    sums = {s: sum(n for i, n in size.items() if source[i] == s) for s in set(source.values())}
    target = targets_want(sums)
    assert {i: (r["size"], r.source_size) for i, r in five.items()} == {i: (n, sums[source[i]]) for i, n in size.items()}
    for s in sums:
        assert sum(r.taken for i, r in five.items() if source[i] == s) == pytest.approx(target[s], abs=1)

    whole = cp.run(spark, path)
    assert {r.doc_id: r for r in whole.collect()} == five


def test_documents_without_id_or_twice(spark, folder):
    path, *_ = folder
    rows = [(None, "some words of a text", "en", "a", 20), (1, "other words of another text", "en", None, 27), (1, "other words of another text", "en", None, 27)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(str(r.doc_id) for r in cp.near_dedup(spark, docs, path).collect()) == ["1", "None"]
    assert cp.near_dedup(spark, docs.where(F.lit(False)), path).count() == 0


def test_only_equal_or_linked_texts_go(spark, folder):
    """Different texts without a doc_id, or of one doc_id, all stay; a near copy goes only if what it is linked with stays."""
    path, *_ = folder
    r = random.Random(22)
    a, b, c, d = (prose(60, r) for _ in range(4))
    near = lambda t: t + " end"
    rows = [(None, a), (None, b), (None, near(a)), (7, near(b)), (8, near(b)), (1, c), (1, d), (2, near(d)), (None, ""), (None, None), (None, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    for n in (1, 3):
        got = [(x.doc_id, x.text) for x in cp.near_dedup(spark, docs.repartition(n), path).collect()]
        copies = [x for x in got if x[1] in (a, near(a))]
        assert len(copies) == 1 and copies[0][0] is None
        assert sorted(map(str, set(got) - set(copies))) == sorted(map(str, [(None, b), (1, c), (1, d), (None, ""), (None, None), (3, "")])) and len(got) == 7


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_over_odd_tables(spark, folder, name):
    """Empty tables, extra columns with names that operators use inside, nulls in every column, very long and repeated rows."""
    path, _, items = folder
    stage = dict(cp.STAGES)[name]
    r = random.Random(33)
    long = prose(60_000, r)
    rows = [(None, None, None, None, None), (None, "", None, "a", 0), (1, "some words here", "en", None, None), (1, "some words here", "en", None, None), (1, "other words there", None, "a", 3)]
    rows += [(2, long, "en", "b", len(long)), (None, prose(40, r), "en", "b", 1), (None, prose(40, r), "en", "b", 1), (3, prose(40, r) + " a.b@c.de", "en", None, 9), (4, f"{prose(30_000, r)} {items[1]} {prose(30_000, r)}", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    extra = docs
    for column in ("row", "order", "blank", "bin", "key", "score", "component", "kind", "_pii_base", "spans", "size", "epochs", "n_shingles", "place", "digest", "_row", "none"):
        extra = extra.withColumn(column, F.lit("x"))
    none = stage(spark, docs.where(F.lit(False)), path)
    assert none.count() == 0
    got, same = (sorted(map(str, stage(spark, d.repartition(2), path).collect())) for d in (docs, extra))
    assert got == same
    if name == "mixing":
        assert len(got) == len(rows)
        return
    table = stage(spark, extra, path)
    assert table.columns == list(cp.COLUMNS) == none.columns
    ids = sorted(str(x.doc_id) for x in table.collect())
    want = ["1"] * 3 + ["2", "3", "4"] + ["None"] * 4
    if name == "near_dedup":
        want.remove("1")
    if name == "decontamination":
        want.remove("4")
    assert ids == want
    kept = {x.doc_id: x.text for x in table.collect() if x.doc_id in (2, 3)}
    assert kept[2] == long and ("[EMAIL]" in kept[3]) == (name == "personal_data")


def test_run_over_odd_tables(spark, tmp_path):
    """The whole chain over an empty table and over one of nulls."""
    for n, rows in enumerate(([], [(None, None, None, None, None)] * 3)):
        to = f"{tmp_path}/{n}"
        spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).write.parquet(f"{to}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
        assert cp.run(spark, to).count() == (1 if rows else 0)


def test_kept_tables_can_be_cleared(spark, folder, tmp_path):
    import os

    from wayfind.llm import op1_warc, storage

    at = storage.mark()
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "page_id long, url string, html string")
    stored = op1_warc.archive(pages)
    assert op1_warc.read(stored).count() == 2
    paths = [p.removeprefix("file://") for p in storage._KEPT[at:]]
    assert paths and all(map(os.path.exists, paths))
    assert storage.clear(spark, at) == len(paths) and not any(map(os.path.exists, paths)) and storage.mark() == at
    assert storage.clear(spark, at) == 0
