"""Index persistence: Parquet tables and a manifest with a fingerprint of what they were built from."""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.config import Bm25Config, EngineConfig
from pagequarry.operators import bm25
from pagequarry.operators.bm25 import Bm25Index


def content_hash(df: DataFrame) -> list[str]:
    """Changes with any row, in any order of rows; a null differs from an empty string, and columns don't run into each other."""
    each = F.xxhash64(*[x for c in df.columns for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    row = df.agg(F.count("*"), F.sum(each.cast("decimal(38,0)"))).first()
    return [str(row[0]), str(row[1])]


def fingerprint(entries: DataFrame, cfg: EngineConfig, embedder: str | None = None, vectors: DataFrame | None = None) -> str:
    """Changes with the settings that an index depends on, with any entry, with the embedder and with any vector given."""
    given = None if vectors is None else content_hash(vectors.selectExpr("page_id", "chunk_id", "cast(embedding as string) embedding"))
    parts = [cfg.for_index(), content_hash(entries.select("page_id", "title", "content")), embedder, given]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_bm25(index: Bm25Index, path: str, name: str) -> None:
    """Four tables under ``path``/``name``.  Postings lie by term in sorted files, so a search for few terms skips most row groups; a term's rows
    are dealt over several files, so that no task holds all of a frequent one.  Terms and statistics come from what is written, not from the texts."""
    spark, at = index.docs.sparkSession, f"{path}/{name}"
    dealt = index.postings.repartition("term", F.pmod(F.xxhash64("doc_ord"), F.lit(bm25.SPREAD)))
    dealt.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/postings")
    index.docs.write.mode("overwrite").parquet(f"{at}/docs")
    stats = bm25.statistics(spark.read.parquet(f"{at}/docs"))
    stats.select("*", F.lit(index.cfg.k1).alias("k1"), F.lit(index.cfg.b).alias("b")).write.mode("overwrite").parquet(f"{at}/stats")
    counts = spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.count("*").alias("df"))
    bm25.weighted(counts, spark.read.parquet(f"{at}/stats").select("n_docs", "avgdl")).write.mode("overwrite").parquet(f"{at}/terms")


def step(spark: SparkSession, path: str, name: str, mark: str, make) -> None:
    """Runs ``make`` unless ``name`` was finished for the same fingerprint: a build that was stopped goes on where it was."""
    done = f"{path}/{name}.done"
    if exists(spark, done) and _read_text(spark, done) == mark:
        return
    make()
    _write_text(spark, done, mark)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def copy_bm25(spark: SparkSession, path: str, source: str, target: str) -> None:
    """The index ``source`` under another name, complete or not at all (``has_bm25``)."""
    if not has_bm25(spark, path, source):
        raise FileNotFoundError(f"no complete index {source!r} in {path}")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (source, target))
    fs = a.getFileSystem(conf)
    fs.delete(b, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, fs, b, False, conf)


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pagequarry"
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="pagequarry-index-"))
    return _OWN[0]


_OWN: list[str] = []


def forget_at_exit(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def has_bm25(spark: SparkSession, path: str, name: str) -> bool:
    return all(exists(spark, f"{path}/{name}/{t}/_SUCCESS") for t in ("postings", "terms", "docs", "stats"))


def load_bm25(spark: SparkSession, path: str, name: str) -> Bm25Index:
    if not has_bm25(spark, path, name):
        raise FileNotFoundError(f"no complete index {name!r} in {path}")
    postings, terms, docs, stats = (spark.read.parquet(f"{path}/{name}/{t}") for t in ("postings", "terms", "docs", "stats"))
    row = stats.first()
    return Bm25Index(postings, terms, docs, stats, Bm25Config(row.k1, row.b))


def save_manifest(spark: SparkSession, path: str, info: dict) -> None:
    """Written last: a folder with a manifest is complete."""
    _write_text(spark, f"{path}/manifest.json", json.dumps(info, sort_keys=True))


def load_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(_read_text(spark, f"{path}/manifest.json"))


def checked_vectors(vectors: DataFrame) -> DataFrame:
    """Raises if vectors differ in length."""
    dims = vectors.where("embedding is not null").agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if dims.a != dims.b:
        raise ValueError(f"vectors of {dims.a} to {dims.b} dimensions")
    return vectors
