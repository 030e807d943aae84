"""The public engine: build an index of entries, search it with a batch of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.config import EngineConfig, current
from pagequarry.functions.text import keyword_query, merged_query, strip_ws, wrapped
from pagequarry.operators import bm25, fusion, rerank
from pagequarry.operators.chunking import chunk_entries
from pagequarry.operators.dense import dense_topk
from pagequarry.plans import store
from pagequarry.sources.entries import page_features, require_unique

Embedder = Callable[[DataFrame], DataFrame]


@dataclass
class Index:
    cfg: EngineConfig
    chunk: bm25.Bm25Index
    title: bm25.Bm25Index
    page: bm25.Bm25Index
    features: DataFrame
    vectors: DataFrame | None = None  # page_id, chunk_id, embedding
    embedder: Embedder | None = None  # what made them, and so embeds the queries


#: Embedders that an index may name in its manifest.
BUILT_IN = {rerank.hashing_embedder.name: rerank.hashing_embedder}


def indexed_texts(entries: DataFrame, cfg: EngineConfig) -> dict[str, DataFrame]:
    """(doc_ord, page_id, text) of the three lexical indexes, and the chunks' ids.  Keys, not positions, align chunks with vectors."""
    title = strip_ws(F.coalesce("title", F.lit("")))
    body = F.coalesce("content", F.lit(""))
    chunks = chunk_entries(entries, cfg.chunking)
    chunks = chunks.withColumn("doc_ord", F.struct("page_id", "chunk_id"))
    return {
        "chunk": chunks.select("doc_ord", "page_id", "chunk_id", "text"),
        "title": entries.select(F.col("page_id").alias("doc_ord"), "page_id", wrapped(title, title).alias("text")),
        "page": entries.select(F.col("page_id").alias("doc_ord"), "page_id", wrapped(title, body).alias("text")),
    }


def build(entries: DataFrame, cfg: EngineConfig | None = None, path: str | None = None, embedder: Embedder | None = None, vectors: DataFrame | None = None) -> Index:
    """Lexical indexes over ``entries`` (page_id, title, content), dense vectors from ``embedder`` or as given.  Page ids must be unique.

    With ``path`` everything is written there and read back; a finished folder with the same fingerprint is reused, and a build that was
    stopped goes on with the tables it lacks.
    """
    spark, cfg = entries.sparkSession, cfg or current()
    require_unique(entries)
    name = getattr(embedder, "name", None) or (embedder and getattr(embedder, "__name__", "embedder"))
    if path is not None:
        mark = store.fingerprint(entries, cfg, name, vectors)
        if store.exists(spark, f"{path}/manifest.json") and store.load_manifest(spark, path)["fingerprint"] == mark:
            return load(spark, path, cfg, embedder)
    texts = indexed_texts(entries, cfg)
    if vectors is None and embedder is not None:
        vectors = embedder(texts["chunk"]).select("page_id", "chunk_id", "embedding")
    if path is None:
        made = {k: bm25.build(t.select("doc_ord", "page_id", "text"), cfg.bm25) for k, t in texts.items()}
        return Index(cfg, made["chunk"], made["title"], made["page"], page_features(entries), vectors, embedder)

    def lexical(k: str) -> None:
        index = bm25.build(texts[k].select("doc_ord", "page_id", "text"), cfg.bm25)
        store.save_bm25(index, path, k)

    for k in texts:
        store.step(spark, path, k, mark, lambda k=k: lexical(k))
    store.step(spark, path, "features", mark, lambda: page_features(entries).repartitionByRange("page_id").sortWithinPartitions("page_id").write.mode("overwrite").parquet(f"{path}/features"))
    info = {"fingerprint": mark, "settings": cfg.for_index(), "vectors": vectors is not None, "embedder": name}
    if vectors is not None:
        store.step(spark, path, "vectors", mark, lambda: vectors.write.mode("overwrite").parquet(f"{path}/vectors"))
        row = spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        info |= {"n_vectors": row.n, "dim": row.dim}
    for k in texts:
        info[k] = bm25.summary(store.load_bm25(spark, path, k)).first().asDict()
    store.save_manifest(spark, path, info)
    return load(spark, path, cfg, embedder)


def load(spark: SparkSession, path: str, cfg: EngineConfig | None = None, embedder: Embedder | None = None) -> Index:
    """A written index.  Built-in embedders are found by the name in the manifest; another must be given for queries to be embedded."""
    info = store.load_manifest(spark, path)
    parts = {name: store.load_bm25(spark, path, name) for name in ("chunk", "title", "page")}
    vectors = store.checked_vectors(spark.read.parquet(f"{path}/vectors")) if info["vectors"] else None
    return Index(cfg or current(), parts["chunk"], parts["title"], parts["page"], spark.read.parquet(f"{path}/features"), vectors, embedder or BUILT_IN.get(info.get("embedder")))


def versions(queries: DataFrame, expand: bool) -> DataFrame:
    """(query_id, query, keywords, merged)."""
    q = queries.select("query_id", strip_ws("query").alias("query"))
    q = q.withColumn("keywords", keyword_query("query") if expand else F.col("query"))
    return q.withColumn("merged", merged_query("query", "keywords"))


def rankings(index: Index, queries: DataFrame, k: int, query_vectors: DataFrame | None = None) -> list[tuple[DataFrame, float]]:
    """The enabled page rankings (query_id, rank, page_id, score), dense first, with their weights."""
    r = index.cfg.retrieve
    v = versions(queries, r.use_expansion)
    if query_vectors is None and r.use_dense and index.vectors is not None:
        if index.embedder is None:
            raise ValueError("the index has vectors but no embedder: give query_vectors or an embedder, or set use_dense to False")
        query_vectors = index.embedder(queries.select("query_id", "query"), "query").select("query_id", "embedding")
    original, merged = v.select("query_id", "query"), v.select("query_id", F.col("merged").alias("query"))
    deep = max(k * r.bm25_candidate_multiplier, k)
    out = []
    if r.use_dense and index.vectors is not None and query_vectors is not None:
        hits = dense_topk(query_vectors, index.vectors, max(k * r.candidate_multiplier, k))
        out.append((fusion.page_aggregate(hits, r), r.dense_weight))
    if r.use_chunk_bm25:
        out.append((fusion.page_aggregate(bm25.search(index.chunk, original, deep, r.pad_zero_scores), r), r.chunk_weight))
    if r.use_title_bm25:
        out.append((bm25.search(index.title, merged, deep, r.pad_zero_scores), r.title_weight))
    if r.use_page_bm25:
        out.append((bm25.search(index.page, merged, deep, r.pad_zero_scores), r.page_weight))
    return out


def search(index: Index, queries: DataFrame, k: int = 10, query_vectors: DataFrame | None = None, reranker: rerank.Reranker | None = rerank.lexical_reranker) -> DataFrame:
    """queries (query_id, query) -> (query_id, rank, page_id, score): one lazy plan.

    Queries are embedded by the index's embedder unless ``query_vectors`` (query_id, embedding) are given.  Without a reranker the fused
    order is final.
    """
    r = index.cfg.retrieve
    pool = fusion.rrf(rankings(index, queries, k, query_vectors), r.rrf_k, max(k, r.rerank_cap))
    if reranker is None:
        return pool.where(F.col("rank") <= k).withColumnRenamed("rrf_score", "score")
    v = versions(queries, r.use_expansion)
    pairs = pool.join(index.features, "page_id", "left").join(v, "query_id")
    snip = rerank.snippet(F.coalesce("content", F.lit("")), "merged", r.snippet_window, r.snippet_step)
    pairs = pairs.select("query_id", "rank", "page_id", "rrf_score", "query", rerank.rerank_text("title", snip).alias("summary"))
    return rerank.blend(reranker(pairs), r.rerank_rrf_weight, k)


def run(index: Index, queries: list[str], k: int = 10, **options) -> list[list[int]]:
    """A list of page ids per query, best first; [] for no queries."""
    if not queries:
        return []
    spark = index.features.sparkSession
    asked = spark.createDataFrame([(f"{i:09d}", q) for i, q in enumerate(queries)], "query_id string, query string")
    got: dict[str, list[tuple[int, int]]] = {}
    for x in search(index, asked, k, **options).collect():  # k rows per query
        got.setdefault(x.query_id, []).append((x.rank, x.page_id))
    return [[p for _, p in sorted(got.get(f"{i:09d}", []))] for i in range(len(queries))]
