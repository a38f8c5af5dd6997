"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from wayfind import queries as q
from wayfind.operators import index, pagerank, search
from wayfind.plans.queryparse import Query
from wayfind.plans.session import session, ship
from wayfind.plans.tables import keep, shared_dir

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    spark = ship(session(CPUS, "bench", **{"spark.driver.memory": "8g"}))
    spark.sparkContext.setLogLevel("ERROR")
    path = f"{shared_dir(spark)}/bench-index"

    def timed(run) -> float:
        began = time.monotonic()
        run()
        return time.monotonic() - began

    def sink(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    took: dict[str, float] = {}
    took["index_build_cold"] = timed(lambda: index.write(q.corpus(spark, SF_DIR), path))
    took["index_build"] = timed(lambda: index.write(q.corpus(spark, SF_DIR), path))
    made = index.read(spark, path, parts=())
    n, seen = made.n_pages(), keep(q.history(spark, SF_DIR), "bench-history")
    searches = {
        "search_words": Query(q.WORDS, ()),
        "search_phrase": Query((), (q.PHRASE_2,)),
        "search_mixed": Query(("of", "with"), (q.PHRASE_2,)),
    }
    for name, query in searches.items():
        ask = lambda query=query: search.ranked(made, query, seen, 8, n_pages=n, at_once=True).collect()
        took[f"{name}_cold"] = timed(ask)
        took[name] = statistics.median(timed(ask) for _ in range(RUNS))
    images = q.part_images(spark, SF_DIR)
    shown = index.Index(made.pages, made.postings, *(keep(t, "bench-images") for t in images))
    took["search_images"] = statistics.median(timed(lambda: search.search_images(shown, "small red ring", analyzer=q.PLAIN).collect()) for _ in range(RUNS))
    saved = keep(q.table(spark, SF_DIR, "part").selectExpr("p_name AS text").distinct(), "bench-queries")
    took["suggestions"] = statistics.median(timed(lambda: search.suggestions(saved, "small").collect()) for _ in range(RUNS))
    edges = keep(q.part_graph(spark, SF_DIR), "bench-edges")
    took["pagerank"] = statistics.median(timed(lambda: sink(pagerank.page_rank(edges))) for _ in range(3))
    for name in ("tokenize_positions", "document_frequency", "snippets", "html_body_text", "stem_vocabulary", "reindex_replace"):
        took[name] = statistics.median(timed(lambda name=name: sink(q.QUERIES[name](spark, SF_DIR))) for _ in range(2))
    warm = sum(v for k, v in took.items() if not k.endswith("_cold"))
    print(json.dumps({"metric": "headline_queries_total", "value": round(warm, 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in took.items()}, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
