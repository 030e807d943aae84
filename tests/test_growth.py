"""Work that must not grow faster than the input: what is moved, and the same results from small blocks."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from pagequarry.operators import bm25, dense, evaluation, rerank

D = "/root/testdata/sf0.001"
WORDS = "the cat sat on a mat dog barks loud fish swim deep sea".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def texts(n, seed=5):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(0, 12))) for _ in range(n)]


def ranked(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.page_id, r.score))
    return got


def brute(docs, queries, k, pad=False):
    counts = [Counter(re.findall("[a-z0-9]+", t.lower())) for t in docs]
    mean = sum(c.total() for c in counts) / len(docs)
    df = Counter(t for c in counts for t in c)
    idf = lambda t: math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1)
    out = {}
    for i, q in enumerate(queries):
        asked = re.findall("[a-z0-9]+", q.lower())
        s = [(-round(sum(idf(t) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t in asked), 6) + 0.0, d) for d, c in enumerate(counts) if asked and (pad or any(t in c for t in asked))]
        if s:
            out[str(i)] = [(d, -x + 0.0) for x, d in sorted(s)[:k]]
    return out


QUERIES = ["the cat", "fish fish sea", "zebra", "", "ON A Mat", "sat"]


@pytest.mark.parametrize("pad", [False, True])
def test_texts_and_index_are_searched_alike(spark, monkeypatch, small_batches, pad):
    """with blocks of a few documents and queries, and documents that lie over several batches."""
    monkeypatch.setattr(bm25, "CELLS", 40)
    monkeypatch.setattr(bm25, "HELD", 12)
    docs = texts(60)
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(docs)], "doc_ord long, page_id long, text string").repartition(3)
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(QUERIES)], "query_id string, query string")
    want = brute(docs, QUERIES, 4, pad)
    assert ranked(bm25.search_texts(df, q, 4, pad_zero_scores=pad)) == want
    assert ranked(bm25.search(bm25.build(df), q, 4, pad)) == want
    assert ranked(bm25.search(bm25.build(df.selectExpr("struct(doc_ord div 5 as p, cast(doc_ord % 5 as int) as c) doc_ord", "page_id", "text")), q, 4, pad)) == want


def test_null_texts_and_other_letters(spark):
    df = spark.createDataFrame([(0, 0, None), (1, 1, "StraßeK9 İx café"), (2, 2, "")], "doc_ord long, page_id long, text string")
    got = {(r.term, r.tf, r.dl) for r in bm25.postings(df).collect()}
    assert got == {(t, 1, 5) for t in ("stra", "ek9", "i", "x", "caf")}
    assert {t for t, _, _ in got} == {x for r in bm25.tokenised(df).collect() for x in r.t}


def test_postings_and_counts_move_little(spark):
    """F12 to F15: postings are not shuffled, nor read again for the counts of documents."""
    q = entry.queries()
    assert "Exchange" not in plan(q["postings"](spark, D))
    for name in ("term_df_idf", "bm25_stats"):
        assert "InMemoryTableScan" not in plan(q[name](spark, D))


def test_vocabulary_keeps_terms_only(spark):
    """what is kept holds neither tokens of texts nor postings."""
    kept = re.findall(r"InMemoryRelation \[([^\]]*)\]", plan(entry.queries()["vocab_ids"](spark, D)))
    assert kept and {c.split("#")[0].strip() for cols in kept for c in cols.split(",")} <= {"term", "part"}


def test_vocabulary_moves_terms_twice_and_reads_texts_once(spark):
    """terms move for their distinct set and for their order; neither text lengths nor a third shuffle are needed."""
    found = plan(entry.queries()["vocab_ids"](spark, D))
    kept = found[found.index("InMemoryRelation") :]
    assert found.count("FileScan") == found.count("InMemoryRelation") and "rangepartitioning" in kept
    assert not re.search(r"hashpartitioning\((part|term)", found[: found.index("InMemoryRelation")])


def test_terms_are_numbered_in_order_over_many_parts(spark):
    """parts of other sizes, empty ones too."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for words in ([f"w{i * i % 1009}x{i}" for i in range(500)], ["b", "a"], []):
            got = bm25.term_ids(spark.createDataFrame([(w,) for w in words], "term string")).collect()
            assert sorted((r.term_id, r.term) for r in got) == list(enumerate(sorted(words)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_texts_are_not_shuffled_for_the_pool(spark):
    """F3 to F8: only results that may be among the best leave a task, and the pool goes to the pages."""
    q = entry.queries()
    for name in ("bm25_topk", "bm25_topk_padded", "rrf_fuse", "snippet", "rerank_blend"):
        found = plan(q[name](spark, D))
        assert "SortMergeJoin" not in found and "term" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", found))


def test_ndcg_computes_its_tables_once(spark):
    """texts are searched once and looked through once; relevant pages of a query are counted before they meet."""
    q = entry.queries()
    for name in ("ndcg", "mean_ndcg"):
        found = plan(q[name](spark, D))
        assert found.count("MapInArrow") == 2 and "Join" not in found.replace("BroadcastHashJoin", "")
        assert "partial_collect_list" in found and "partial_count" in found


def test_ndcg_of_odd_rows(spark):
    """Repeats, nulls, queries of one side only, and more relevant pages than places."""
    results = spark.createDataFrame([("a", 1, 7), ("a", 2, 7), ("a", 3, 8), ("a", 4, 9), ("b", 1, 1), ("c", 1, None), ("c", 2, 5), (None, 1, 1)], "query_id string, rank int, page_id long")
    wanted = spark.createDataFrame([("a", 8), ("a", 8), ("a", 9), ("a", 3), ("c", None), ("c", 5), ("d", 1), (None, 1)], "query_id string, page_id long")
    got = {r.query_id: r.ndcg for r in evaluation.ndcg(results, wanted, 3).collect()}
    third = 1 / math.log2(3)
    assert got == {"a": round((1 + third) / (2 + third), 6), "b": 0.0, "c": 0.5, "d": 0.0, None: 0.0}
    assert {r.query_id: r.ndcg for r in evaluation.ndcg(results, wanted, 1).collect()}["a"] == 0.0


def test_holding(spark):
    pages = ["the cat sat on a mat", "xthe cat saty", "the cat", None, "", "a mat, a dog"]
    asked = ["the cat sat", "cat", "e c", "a mat, a", "", "zebra on it", None]
    p = spark.createDataFrame(list(enumerate(pages)), "page_id long, text string").repartition(2)
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "query_id string, query string")
    want = {(f"q{i}", j) for i, a in enumerate(asked) for j, t in enumerate(pages) if a is not None and t is not None and a in t}
    assert {(r.query_id, r.page_id) for r in evaluation.holding(q, p).collect()} == want


def test_dense_in_small_blocks(spark, monkeypatch, small_batches):
    """F9 to F11: blocks of scores and passes of queries don't change what is found."""
    monkeypatch.setattr(dense, "CELLS", 16)
    monkeypatch.setattr(dense, "HELD", 20)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (80, 3)).astype(float)  # many ties
    corpus = spark.createDataFrame([(i // 4, i, v.tolist()) for i, v in enumerate(x)] + [(99, 99, None), (98, 98, [1.0])], "page_id long, chunk_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 80, 7)], "query_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in dense.dense_topk(q, corpus, 5).collect()}
    want = {(i, n + 1): (c, -s) for i in range(0, 80, 7) for n, (s, c) in enumerate(sorted((-float(x[i] @ x[j]) + 0.0, j) for j in range(80))[:5])}
    assert got == want


def test_hashing_embedder(spark):
    """the embedder's numbers, counted in vectors rather than place by place in the plan."""
    docs = [*texts(5), "", None, "Été 9"]
    df = rerank.hashing_embedder(spark.createDataFrame(list(enumerate(docs)), "i int, text string"))
    assert "aggregate" not in plan(df)
    for r in df.collect():
        v = np.zeros(64)
        for t in re.findall("[a-z0-9]+", (docs[r.i] or "").lower()):
            h = hashlib.md5(t.encode()).hexdigest()
            v[int(h[:6], 16) % 64] += 1 if h[6] < "8" else -1
        n = np.sqrt((v * v).sum())
        assert r.embedding == (v / n if n else v).astype(np.float32).tolist()
