import os
import re
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_keys():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert {q for q in queries if not re.match(r"op\d+_|pipeline", q)} - set(oracles) == set()


def test_rest_stands_alone(tmp_path):
    """Without the training-data operators the entry and everything else import, and the rest never names them."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e, pagequarry.plans.engine; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q, q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
    for d, _, names in os.walk(tmp_path / "r" / "pagequarry"):
        for n in names:
            assert "pagequarry.llm" not in open(os.path.join(d, n), encoding="utf-8").read()


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "rank", "page_id", "score"] and rows.count() == 400


def test_flagship_has_a_dense_ranking(spark, monkeypatch):
    from pagequarry.operators import fusion

    seen, rrf = [], fusion.rrf
    monkeypatch.setattr(fusion, "rrf", lambda rankings, *rest: seen.extend(rankings) or rrf(rankings, *rest))
    entry.entry(spark)
    assert [w for _, w in seen] == [1.0, 1.0, 0.65, 0.07]  # dense, chunk, title, page
    dense = seen[0][0].where("rank = 1")
    assert dense.count() == 40 and dense.where("score > 0").count() == 40


def test_one_query_agrees_with_its_oracle(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "nation", "labels", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    for name in ("bm25_topk", "query_versions", "entry_chunks", "page_agg_max", "paragraph_chunks", "dev_subset", "normalize_page_id", "ndcg", "hybrid_search"):
        want = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        got = entry.queries()[name](spark, d)
        assert sorted(got.columns) == sorted(names)
        assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())
