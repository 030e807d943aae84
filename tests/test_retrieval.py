import math
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.config import ChunkConfig, EngineConfig, RetrieveConfig
from pagequarry.operators import ann, bm25, dense, evaluation, fusion, rerank
from pagequarry.plans import engine, store
from pagequarry.sources import entries as src
from pagequarry.streaming.chunks import stream_chunks

DOCS = [(0, 0, "Title: Cat\nContent: the cat sat"), (1, 1, "Title: Dog\nContent: the dog sat on the cat cat"), (2, 2, "Title: Empty\nContent: ")]


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build(spark.createDataFrame(DOCS, "doc_ord long, page_id long, text string"))


def ask(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")


def test_statistics(index):
    s = index.stats.first()
    assert s.n_docs == 3 and s.avgdl == pytest.approx(19 / 3)
    idf = {r.term: r.idf for r in index.terms.collect()}
    assert idf["dog"] == pytest.approx(0.980829, abs=1e-6) and idf["cat"] == pytest.approx(0.470004, abs=1e-6) and idf["title"] == pytest.approx(0.133531, abs=1e-6)
    ids = {r.term: r.term_id for r in bm25.vocabulary(index).collect()}
    assert [t for t, _ in sorted(ids.items(), key=lambda x: x[1])] == sorted(idf) and sorted(ids.values()) == list(range(len(idf)))


def test_scores(spark, index):
    got = {}
    for r in bm25.search(index, ask(spark, "cat", "cat cat", "zebra", "content", ""), 10).collect():
        got.setdefault(r.query_id, []).append((r.doc_ord, r.score))
    assert got == {"0": [(0, 0.682988), (1, 0.56609)], "1": [(0, 1.365976), (1, 1.13218)], "3": [(2, 0.174972), (0, 0.136771), (1, 0.105933)]}


def test_padding(spark, index):
    got = {}
    for r in bm25.search(index, ask(spark, "cat", "zebra", ""), 3, pad_zero_scores=True).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_ord))
    assert {k: sorted(v) for k, v in got.items()} == {"0": [(1, 0), (2, 1), (3, 2)], "1": [(1, 0), (2, 1), (3, 2)]}


def test_page_aggregation(spark):
    hits = spark.createDataFrame([("q", 1, 7, 0.9), ("q", 2, 7, 0.6), ("q", 3, 7, 0.3), ("q", 4, 7, 0.1), ("q", 5, 8, 0.8), ("q", 6, 9, 0.8)], "query_id string, rank int, page_id long, score double")
    got = {r.page_id: (r.rank, r.score) for r in fusion.page_aggregate(hits).collect()}
    assert got == {8: (1, 0.8), 9: (2, 0.8), 7: (3, 0.66)}
    assert fusion.page_aggregate(hits, RetrieveConfig(page_aggregation="max")).where("page_id = 7").first().score == 0.9


def ranking(spark, pages):
    return spark.createDataFrame([("q", i, p) for i, p in enumerate(pages, 1)], "query_id string, rank int, page_id long")


def test_rrf(spark):
    r = [ranking(spark, p) for p in ([5, 3, 9], [3, 5, 7], [9], [7, 5])]
    got = [(x.page_id, round(x.rrf_score, 6)) for x in fusion.rrf(list(zip(r, (1, 1, 0.65, 0.07), strict=True)), 20, 10).orderBy("rank").collect()]
    assert got == [(5, 0.096255), (3, 0.093074), (9, 0.074431), (7, 0.046812)]
    tied = [x.page_id for x in fusion.rrf([(r[0], 1), (r[1], 1)], 20, 10).orderBy("rank").collect()]
    assert tied == [5, 3, 9, 7]


@pytest.mark.parametrize(
    "ranked, relevant, value",
    [([1, 2, 3], [1], 1.0), ([2, 1, 3], [1], 1.0), ([2, 3, 1], [1], 0.63093), ([2, 2, 1], [1], 1.0), ([1, 2, 3], [1, 3], 0.815465), ([1], [], 0.0)],
)
def test_ndcg(spark, ranked, relevant, value):
    rel = spark.createDataFrame([("q", p) for p in relevant], "query_id string, page_id long")
    assert evaluation.ndcg(ranking(spark, ranked), rel).first().ndcg == pytest.approx(value, abs=1e-6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 12), min_size=1, max_size=15), st.sets(st.integers(1, 12), min_size=1))
def test_ndcg_is_a_share(spark, ranked, relevant):
    rel = spark.createDataFrame([("q", p) for p in relevant], "query_id string, page_id long")
    got = evaluation.ndcg(ranking(spark, ranked), rel, 10).first().ndcg
    once = list(dict.fromkeys(ranked))[:10]
    d = lambda i: 1 if i == 1 else 1 / math.log2(i)
    want = sum(d(i) for i, p in enumerate(once, 1) if p in relevant) / sum(d(i) for i in range(1, min(10, len(relevant)) + 1))
    assert 0 <= got <= 1 + 1e-9 and got == pytest.approx(want, abs=1e-6)


def test_evaluate(spark):
    rel = spark.createDataFrame([("q", 1)], "query_id string, page_id long")
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    assert evaluation.evaluate(ranking(spark, [1]), rel, asked) == 0.5
    with pytest.raises(ValueError):
        evaluation.evaluate(ranking(spark, [1]), rel, asked.where("query_id = 'none'"))


def test_dense(spark):
    corpus = spark.createDataFrame([(i // 2, i, [1.0, i / 10]) for i in range(20)] + [(99, 99, None)], "page_id long, chunk_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = {}
    for r in dense.dense_topk(q, corpus, 3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {"a": [19, 18, 17], "b": [0, 1, 2]}


ENTRIES = [(10, "Cats", "the cat sat on the mat"), (20, "Dogs", "a dog barks at the cat"), (30, "Fish", "fish swim in water\n\nand cats like fish"), (40, None, None)]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "page_id long, title string, content string")


def test_search_end_to_end(spark, entries, tmp_path):
    made = engine.build(entries, embedder=rerank.hashing_embedder)
    assert engine.run(made, ["cat on a mat", "fish"])[0][0] == 10
    assert engine.run(made, []) == []
    q = ask(spark, "cat on a mat", "fish in water", "zzz")
    vectors = rerank.hashing_embedder(q, "query").select("query_id", "embedding")
    rows = engine.search(made, q, 3, vectors).collect()
    best = {r.query_id: r.page_id for r in rows if r.rank == 1}
    assert best["0"] == 10 and best["1"] == 30
    plain = {(r.query_id, r.rank): r.page_id for r in engine.search(made, q, 3, reranker=None).collect()}
    again = engine.build(entries.repartition(7), embedder=rerank.hashing_embedder)
    assert plain == {(r.query_id, r.rank): r.page_id for r in engine.search(again, q, 3, reranker=None).collect()}
    path = str(tmp_path / "index")
    stored = engine.build(entries, path=path, embedder=rerank.hashing_embedder)
    assert sorted(rows) == sorted(engine.search(stored, q, 3, vectors).collect())
    stamp = f"{path}/chunk/postings/_SUCCESS"
    before = os.stat(stamp).st_mtime_ns
    again = engine.build(entries, EngineConfig().with_retrieve(rrf_k=9), path, rerank.hashing_embedder)  # how it is searched is not in the fingerprint
    assert os.stat(stamp).st_mtime_ns == before and again.cfg.retrieve.rrf_k == 9
    assert sorted(rows) == sorted(engine.search(engine.load(spark, path), q, 3).collect())  # the queries are embedded by the manifest's embedder
    info = store.load_manifest(spark, path)
    assert info["n_vectors"] == again.vectors.count() and info["dim"] == 64 and info["page"]["n_docs"] == 4 and info["embedder"] == "hashing-64"
    plain = engine.build(entries, path=path)  # no vectors asked for: not the old ones
    assert plain.vectors is None
    assert engine.build(entries, path=path, embedder=rerank.hashing_embedder).vectors is not None
    changed = engine.build(entries.where("page_id < 40"), path=path)
    assert changed.vectors is None and changed.page.stats.first().n_docs == 3


def test_pluggable_cross_encoder(spark):
    df = spark.createDataFrame([("q", 1, 5, 0.1, "a b", "b c")], "query_id string, rank int, page_id long, rrf_score double, query string, summary string")
    scored = rerank.cross_encoder(lambda: lambda q, s: [len(a) + len(b) for a, b in zip(q, s, strict=True)])(df)
    assert rerank.blend(scored, 3.0, 5).first().score == pytest.approx(6.3)


def test_sources(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e/7.json").write_text('{"title": "T",\n "content": null}')
    (tmp_path / "e/x.json").write_text('{"page_id": " 9 ", "content": "c"}')
    got = sorted(tuple(r) for r in src.read_entries(spark, str(tmp_path / "e")).collect())
    assert got == [(7, "T", ""), (9, "", "c")]
    with pytest.raises(Exception):
        src.read_entries(spark, str(tmp_path / "missing")).collect()
    (tmp_path / "q.json").write_text('[{"query_id": "a",\n "query": "x", "relevant_page_ids": ["3", "3", "4"]}]')
    assert src.read_queries(spark, str(tmp_path / "q.json")).first().relevant_page_ids == [3, 3, 4]
    assert src.read_queries(spark, str(tmp_path / "q.json"), distinct=True).first().relevant_page_ids == [3, 4]
    (tmp_path / "e/z.json").write_text("{ no json")
    with pytest.raises(Exception):
        src.read_entries(spark, str(tmp_path / "e")).collect()
    twice = spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], "page_id long, title string, content string")
    with pytest.raises(ValueError, match="given twice"):
        engine.build(twice)


def test_dev_subset(spark, entries):
    pos = spark.createDataFrame([(20,), (20,), (77,)], "page_id long")
    got = {r.page_id for r in src.dev_subset(entries, pos, 1).collect()}
    assert 20 in got and len(got) == 2
    assert got == {r.page_id for r in src.dev_subset(entries.repartition(3), pos, 1).collect()}
    assert src.dev_subset(entries, pos, 0).count() == 4


def test_stream(spark, entries, tmp_path):
    entries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(entries.schema).parquet(str(tmp_path / "in"))
    stream_chunks(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ChunkConfig()).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == engine.indexed_texts(entries, EngineConfig())["chunk"].count()


def test_plan_prunes_and_limits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").alias("page_id"), "text")
    plan = bm25.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    ranked = bm25.top(bm25.scores(bm25.build(docs), ask(spark, "the")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in ranked and "Cartesian" not in ranked


def test_stopped_build_goes_on(spark, entries, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    monkeypatch.setattr(store, "save_manifest", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.build(entries, path=path)
    monkeypatch.undo()
    stamp = f"{path}/title/postings/_SUCCESS"
    before = os.stat(stamp).st_mtime_ns
    assert engine.build(entries, path=path).title.stats.first().n_docs == 4
    assert os.stat(stamp).st_mtime_ns == before
    store.copy_bm25(spark, path, "chunk", "alias")
    assert store.load_bm25(spark, path, "alias").terms.count() == store.load_bm25(spark, path, "chunk").terms.count()
    with pytest.raises(FileNotFoundError):
        store.copy_bm25(spark, path, "none", "alias")


def test_vectors_without_embedder(spark, entries):
    made = engine.build(entries, vectors=rerank.hashing_embedder(engine.indexed_texts(entries, EngineConfig())["chunk"]).select("page_id", "chunk_id", "embedding"))
    with pytest.raises(ValueError, match="no embedder"):
        engine.search(made, ask(spark, "cat"), 3)


def test_null_and_shifted_columns_differ(spark):
    a, b, c = ([(1, None, "a")], [(1, "a", None)], [(1, "", "a")])
    marks = {store.fingerprint(spark.createDataFrame(x, "page_id long, title string, content string"), EngineConfig()) for x in (a, b, c)}
    assert len(marks) == 3


def test_model_embedder(spark, entries):
    def load(device):
        assert device in ("cpu", "cuda")
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    embedder = rerank.model_embedder(load, "lengths")
    made = engine.build(entries, embedder=embedder)
    v = made.vectors.first().embedding
    assert abs(sum(x * x for x in v) - 1) < 1e-6
    assert engine.search(made, ask(spark, "cat"), 2).count() == 2


def test_large_page_ids(spark):
    big = spark.createDataFrame([(2**62, "Cat", "the cat"), (2**43, "Dog", "the dog")], "page_id long, title string, content string")
    assert engine.run(engine.build(big), ["cat"])[0][0] == 2**62


def test_cells_find_most_of_the_nearest(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    corpus = e.selectExpr("vec_id div 4 page_id", "vec_id chunk_id", "embedding")
    q = e.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "embedding")
    index = ann.build(corpus.unionByName(corpus.selectExpr("-1 page_id", "-1 chunk_id", "cast(null as array<float>) embedding").limit(1)))
    assert index.rows.count() == ann.SPILL * corpus.count()
    exact = {(r.query_id, r.chunk_id): r.score for r in dense.dense_topk(q, corpus, 10).collect()}
    found = {(r.query_id, r.chunk_id): r.score for r in ann.search(index, q, 10).collect()}
    both = set(exact) & set(found)
    assert len(both) >= 0.9 * len(exact) and all(abs(exact[x] - found[x]) <= 2e-6 for x in both)
    assert {(r.query_id, r.chunk_id) for r in ann.search(index, q, 10, probes=ann.CELLS).collect()} == set(exact)


def test_dense_ties_and_batches(spark):
    corpus = spark.createDataFrame([(i, i, [1.0, 0.0]) for i in range(50)], "page_id long, chunk_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.chunk_id for r in dense.dense_topk(q, corpus, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_evaluate_run(spark):
    assert evaluation.evaluate_run(["a", "b"], [[1], [2]], lambda q: [[1], [3]]) == 0.5
    assert evaluation.evaluate_run([], [], lambda q: []) == 0.0
    with pytest.raises(ValueError):
        evaluation.evaluate_run(["a"], [[1]], lambda q: [])
    with pytest.raises(TypeError):
        evaluation.evaluate_run(["a"], [[1]], lambda q: [(1,)])


def test_samples(spark, entries):
    assert [r.page_id for r in src.first_pages(entries, 2).orderBy("page_id").collect()] == [10, 20]
    q = ask(spark, *"abcdefgh")
    got = {r.query_id for r in src.sample_queries(q, 3).collect()}
    assert len(got) == 3 and got == {r.query_id for r in src.sample_queries(q.repartition(4), 3).collect()} and src.sample_queries(q, 0).count() == 8
    labelled = spark.createDataFrame([("a", [1, 2]), ("b", [2, 3])], "query_id string, relevant_page_ids array<long>")
    assert {r.page_id for r in src.relevant_pages(labelled).collect()} == {1, 2, 3}


def test_command_line(spark, tmp_path, capsys):
    from pagequarry.__main__ import main

    (tmp_path / "e").mkdir()
    for i, t in ((1, "cats sleep"), (2, "dogs bark"), (3, "fish swim")):
        (tmp_path / f"e/{i}.json").write_text(f'{{"title": "{t.split()[0]}", "content": "{t}"}}')
    (tmp_path / "q.json").write_text('[{"query_id": "a", "query": "dogs", "relevant_page_ids": ["2"]}]')
    at = ["--index", str(tmp_path / "i")]
    assert main([*at, "build", str(tmp_path / "e")]) == 0
    assert main([*at, "search", "fish", "-k", "1"]) == 0
    assert main([*at, "evaluate", str(tmp_path / "q.json")]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0] == "[3]" and '"ndcg": 1.0' in lines[1]
