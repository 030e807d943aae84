"""Snippets, rerank texts, pluggable rerankers and embedders, and the final blend."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import bounded_batches, let, tokens, words


def snippet(content: Column | str, query: Column | str, window: int = 120, step: int = 20) -> Column:
    """The window of words with most words exactly in the query's token set, the earliest of equals; short texts whole."""
    c = F.lower(F.col(content) if isinstance(content, str) else content)
    return let(words(c), lambda w: let(F.array_distinct(tokens(query)), lambda asked: _best_window(w, asked, window, step)))


def _best_window(w: Column, asked: Column, window: int, step: int) -> Column:
    n = F.size(w)
    first = F.struct(F.lit(-1).alias("hits"), F.lit(0).alias("at"))

    # a word counts if it is exactly a token, so the flags are found once
    def pick(hit: Column) -> Column:
        def better(acc: Column, i: Column) -> Column:
            hits = F.aggregate(F.slice(hit, i + 1, window), F.lit(0), lambda s, x: s + x)
            return let(hits, lambda h: F.when(h > acc["hits"], F.struct(h.alias("hits"), i.alias("at"))).otherwise(acc))

        # a fold needs a valid sequence even where its result isn't used
        starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(step))
        return F.aggregate(starts, first, better, lambda acc: acc["at"])

    at = let(F.transform(w, lambda x: F.array_contains(asked, x).cast("int")), pick)
    return F.when(n <= window, F.array_join(w, " ")).otherwise(F.array_join(F.slice(w, at + 1, window), " "))


def rerank_text(title: Column | str, snip: Column | str) -> Column:
    t, s = (F.col(x) if isinstance(x, str) else x for x in (title, snip))
    return F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit("Title: "), t, F.lit(". Context: "), s)).otherwise(s)


#: Adds a column ``ce`` (double) to rows with ``query`` and ``summary``.
Reranker = Callable[[DataFrame], DataFrame]


def lexical_reranker(pairs: DataFrame) -> DataFrame:
    """The built-in scorer: the share of the query's distinct tokens that the summary has."""
    asked = F.array_distinct(tokens("query"))
    hit = F.size(F.array_intersect(asked, tokens("summary")))
    return pairs.withColumn("ce", F.round(F.when(F.size(asked) > 0, hit / F.size(asked)).otherwise(0.0), 6))


def cross_encoder(load: Callable[[], Callable[[list, list], list]]) -> Reranker:
    """A reranker from a model: ``load()`` runs once per Python worker and gives predict(queries, summaries) -> scores."""

    def rerank(pairs: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            predict = load()
            for q, s in batches:
                yield pd.Series(predict(q.tolist(), s.tolist()), dtype="float64")

        return pairs.withColumn("ce", score("query", "summary"))

    return rerank


def hashing_embedder(texts: DataFrame, column: str = "text", dims: int = 64) -> DataFrame:
    """A deterministic stand-in for a text model: signed hashed token counts, unit length, as ``embedding`` array<float>; zeros without tokens."""
    bounded_batches(texts.sparkSession)
    # bytes of no token are blanks
    spaced = bytes(i if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for i in range(256))

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[bytes, int] = {}  # of tokens: place, and dims more for a minus

        def code(token: bytes) -> int:
            h = hashlib.md5(token).hexdigest()
            if len(known) >= 500_000:
                known.clear()
            known[token] = at = int(h[:6], 16) % dims + (0 if h[6] < "8" else dims)
            return at

        for s in batches:
            v = np.zeros((len(s), 2 * dims))
            for i, text in enumerate(s):
                at = [known[t] if t in known else code(t) for t in text.lower().encode().translate(spaced).split()]
                if at:
                    v[i] = np.bincount(at, minlength=2 * dims)
            v = v[:, :dims] - v[:, dims:]
            n = np.sqrt((v * v).sum(axis=1, keepdims=True))
            yield pd.Series(list(np.where(n > 0, v / np.where(n > 0, n, 1.0), 0.0).astype(np.float32)))

    return texts.withColumn("embedding", vector(F.coalesce(F.col(column), F.lit(""))))


hashing_embedder.name = "hashing-64"


def device() -> str:
    """"cuda" where a worker has one, else "cpu"."""
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "cpu"


def model_embedder(load: Callable[[str], Callable[[list], list]], name: str) -> Callable[..., DataFrame]:
    """An embedder from a model: ``load(device)`` runs once per Python worker and gives embed(texts) -> vectors, which are set to unit length."""

    def embed(texts: DataFrame, column: str = "text") -> DataFrame:
        @F.pandas_udf("array<float>")
        def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load(device())
            for t in batches:
                x = np.asarray(model(t.fillna("").tolist()), dtype=np.float32).reshape(len(t), -1)
                yield pd.Series(list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)))

        return texts.withColumn("embedding", vector(column))

    embed.name = name
    return embed


def blend(scored: DataFrame, weight: float, k: int) -> DataFrame:
    """(query_id, rank, page_id, rrf_score, ce) -> the best ``k`` by ce + weight * rrf_score; ties in pool order."""
    total = F.round(F.col("ce") + weight * F.col("rrf_score"), 6)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_rank")
    rows = scored.select("query_id", "page_id", F.col("rank").alias("pool_rank"), total.alias("score"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "page_id", "score")
