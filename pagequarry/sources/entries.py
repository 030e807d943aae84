"""Sources: entry and query files, and the corpus subset used in development."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.text import page_id, strip_ws


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file -> (page_id, title, content); the file's stem stands in for a missing id, "" for missing text.

    Raises if the folder is missing, a file is no JSON object or an id is no number.
    """
    raw = spark.read.schema("page_id string, title string, content string").option("multiLine", True).option("mode", "FAILFAST").json(f"{path.rstrip('/')}/*.json")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return raw.select(
        strip_ws(F.coalesce("page_id", stem)).cast("long").alias("page_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
    )


def require_unique(entries: DataFrame) -> DataFrame:
    """``entries`` as they are; raises if an id occurs twice.  Reads the ids alone."""
    twice = entries.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").orderBy("page_id").limit(5).collect()
    if twice:
        raise ValueError(f"page ids given twice: {[r.page_id for r in twice]}")
    return entries


def read_queries(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """A JSON array -> (query_id, query, relevant_page_ids array<long>), the ids as a set if ``distinct``."""
    raw = spark.read.schema("query_id string, query string, relevant_page_ids array<string>").option("multiLine", True).json(path)
    ids = F.transform("relevant_page_ids", lambda x: page_id(x))
    return raw.select("query_id", "query", (F.array_distinct(ids) if distinct else ids).alias("relevant_page_ids"))


def page_features(entries: DataFrame) -> DataFrame:
    """(page_id, title stripped, content lower-cased) for lookups by id."""
    return entries.select("page_id", strip_ws(F.coalesce("title", F.lit(""))).alias("title"), F.lower(F.coalesce("content", F.lit(""))).alias("content"))


def _seeded(column: str, seed: int):
    """A hash that any engine can state: the MD5 of id and seed as text."""
    return F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))).cast("binary"))


def dev_subset(entries: DataFrame, positives: DataFrame, negatives: int, seed: int = 13) -> DataFrame:
    """All entries of ``positives`` (page_id) and ``negatives`` others, first in a seeded hash order; 0 takes all others."""
    ids = positives.select("page_id").distinct()
    others = entries.join(ids, "page_id", "left_anti")
    if negatives:
        others = others.orderBy(_seeded("page_id", seed), "page_id").limit(negatives)
    return entries.join(ids, "page_id", "left_semi").unionByName(others)


def first_pages(entries: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pages by id, for trial builds; 0 takes all."""
    return entries.orderBy("page_id").limit(n) if n else entries


def sample_queries(queries: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` queries, first in a seeded hash order; 0 takes all."""
    return queries.orderBy(_seeded("query_id", seed), "query_id").limit(n) if n else queries


def relevant_pages(queries: DataFrame) -> DataFrame:
    """(page_id): the distinct pages that any query (query_id, relevant_page_ids) is labelled with."""
    return queries.select(F.explode("relevant_page_ids").alias("page_id")).distinct()
