"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import decontamination, language_id, minhash, pii, sentencepieces
from pagequarry.llm.common import discard, materialize
from pagequarry.llm.registry import table, tokenizer

#: Shingle similarity, in percent, from which documents are near duplicates.
NEAR = 80


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on, however short or long; ``und`` (null or no letter) go.  Repeated rows are judged alike, null ids go on."""
    names, proto = language_id.learn(docs)
    found = language_id.predict(docs.withColumnRenamed("lang_pred", "_lang_pred").withColumnRenamed("score", "_score"), names, proto, keep=True)
    found = found.where("lang_pred <> 'und'").drop("lang_pred", "score")
    return found.withColumnRenamed("_lang_pred", "lang_pred").withColumnRenamed("_score", "score")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of the smallest id.  Null ids and texts without words stay; exact repeats are one row."""
    return minhash.keep_one(docs, NEAR)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, or one within the allowed edits, go.  Null and empty texts stay, an empty benchmark takes nothing."""
    marked = decontamination.mark_contaminated(docs.withColumnRenamed("hits", "_hits"), table(spark, sf_dir, "benchmark"))
    return marked.where("size(hits) = 0").drop("hits").withColumnRenamed("_hits", "hits")


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; n_chars (where there is such a column) follows.  Null texts stay null."""
    out = pii.redact(docs)
    return (out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out).select(*[F.col(f"`{c}`") for c in docs.columns])


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked to decode to the text.  Null counts as empty; columns named as the new ones give way to them."""
    return sentencepieces.sentencepiece_encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language ID", stage_language),
    ("MinHash near-dedup", stage_near_dedup),
    ("benchmark decontamination", stage_decontaminate),
    ("PII", stage_pii),
    ("SentencePiece encoding", stage_encode),
]

#: Learned prototypes, MinHash, CGK and tokenizers can't be stated in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
            discard(before)
    return docs
