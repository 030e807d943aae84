"""Command line: ``python -m pagequarry build|search|evaluate``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from pagequarry.config import EngineConfig, index_folder
from pagequarry.operators import evaluation, rerank
from pagequarry.plans import engine
from pagequarry.sources import entries as src


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("pagequarry")
    p.add_argument("--index", help="folder of the index; else the environment's ARTIFACTS_DIR, else ./artifacts")
    p.add_argument("--settings", help="JSON file")
    todo = p.add_subparsers(dest="todo", required=True)
    b = todo.add_parser("build", help="index a folder of JSON pages")
    b.add_argument("entries")
    b.add_argument("--pages", type=int, default=0, help="only the first so many pages by id")
    b.add_argument("--no-vectors", action="store_true")
    s = todo.add_parser("search", help="the pages for one query")
    s.add_argument("query", nargs="+")
    s.add_argument("-k", type=int, default=10)
    e = todo.add_parser("evaluate", help="mean NDCG of a JSON file of labelled queries")
    e.add_argument("queries")
    e.add_argument("-k", type=int, default=10)
    e.add_argument("--sample", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("pagequarry").getOrCreate()
    cfg, path = EngineConfig.load(a.settings) if a.settings else EngineConfig(), index_folder(a.index)
    if a.todo == "build":
        pages = src.first_pages(src.read_entries(spark, a.entries), a.pages)
        engine.build(pages, cfg, path, None if a.no_vectors else rerank.hashing_embedder)
        return 0
    index = engine.load(spark, path, cfg)
    if a.todo == "search":
        print(json.dumps(engine.run(index, [" ".join(a.query)], a.k)[0]))
        return 0
    asked = src.sample_queries(src.read_queries(spark, a.queries, distinct=True), a.sample).persist()
    began = time.perf_counter()
    found = engine.search(index, asked.select("query_id", "query"), a.k).persist()
    found.count()
    took = time.perf_counter() - began
    wanted = asked.selectExpr("query_id", "explode(relevant_page_ids) page_id")
    print(json.dumps({"ndcg": evaluation.evaluate(found, wanted, asked, a.k), "queries": asked.count(), "seconds": round(took, 3)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
