"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm.decontamination import contaminations
from pagequarry.llm.embedding_dedup import embedding_dedup
from pagequarry.llm.language_id import language_id
from pagequarry.llm.lm_scoring import ORDER, backoff_scores
from pagequarry.llm.minhash import minhash_dedup
from pagequarry.llm.pii import find_pii
from pagequarry.llm.sentencepieces import sentencepiece_encode
from pagequarry.llm.substring_dedup import substring_dedup
from pagequarry.llm.token_counts import token_counts
from pagequarry.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("n_kept_runs")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents"), ORDER)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_encode(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decodes", "parity")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ALL = (
    op1_substring_dedup, op2_pii, op3_lm_scoring, op4_language_id, op5_embedding_dedup, op6_decontamination,
    op7_token_counts, op8_sentencepiece, op9_toxicity, op10_minhash_dedup, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP1 = f"""WITH w AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) i FROM w)),
dup AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) i FROM dup),
word AS (SELECT doc_id, unnest(w) x, generate_subscripts(w, 1) i FROM w),
kept AS (SELECT doc_id, count(*) n, string_agg(x, ' ' ORDER BY i) s FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(s, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_CLOSURE = """r AS (SELECT id node, id reach FROM node UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
comp AS (SELECT node, min(reach) c FROM r GROUP BY node)"""

_OP5 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT p.vec_id a, q.vec_id b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))) >= 0.95),
node AS (SELECT vec_id id FROM embeddings), {_CLOSURE}
SELECT vec_id, coalesce(n, 0) n_links, c component_id, vec_id = c kept FROM embeddings JOIN comp ON node = vec_id LEFT JOIN (SELECT a vec_id, count(*) n FROM e GROUP BY a) USING (vec_id)"""

_OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
node AS (SELECT doc_id id FROM documents), {_CLOSURE}
SELECT doc_id, coalesce(n, 0) n_shingles, c component_id, doc_id = c kept FROM documents JOIN comp ON node = doc_id LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others learn, or take a library's or a fixed pattern's word: see tests/llm."""
    return {"op1_substring_dedup": _OP1, "op5_embedding_dedup": _OP5, "op10_minhash_dedup": _OP10}
