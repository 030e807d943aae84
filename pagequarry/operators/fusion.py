"""Page aggregation of chunk scores and weighted reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.config import RetrieveConfig

DIGITS = 9


def page_aggregate(hits: DataFrame, cfg: RetrieveConfig = RetrieveConfig()) -> DataFrame:
    """(query_id, rank, page_id, score) of chunks -> (query_id, rank, page_id, score) of pages; ties by the page's first chunk."""
    w = Window.partitionBy("query_id", "page_id").orderBy(F.desc("score"), "rank")
    three = F.col("place") <= 3
    value = F.max("score")
    if cfg.page_aggregation == "max_plus_mean_top3":
        value = cfg.agg_max_weight * value + cfg.agg_mean_weight * F.avg(F.when(three, F.col("score")))
    pages = hits.withColumn("place", F.row_number().over(w)).groupBy("query_id", "page_id").agg(F.round(value, DIGITS).alias("score"), F.min("rank").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    return pages.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "page_id", "score")


def rrf(rankings: list[tuple[DataFrame, float]], rrf_k: int, k: int) -> DataFrame:
    """Rankings (query_id, rank, page_id) with weights -> (query_id, rank, page_id, rrf_score), the best ``k`` per query.

    Ties go to the page seen first: in the earliest ranking, then by its rank there.
    """
    parts = [r.select("query_id", "page_id", "rank", F.lit(i).alias("ranker"), F.lit(float(w)).alias("w")) for i, (r, w) in enumerate(rankings)]
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy("query_id", "page_id").agg(F.round(F.sum(F.col("w") / (F.lit(rrf_k) + F.col("rank"))), DIGITS).alias("rrf_score"), F.min(F.struct("ranker", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "page_id", "rrf_score")
