"""Dense top-k: exact inner products of query vectors against all rows, in Arrow blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import bounded_batches

#: Queries held by one pass, at most; more are split over several.
QUERY_BLOCK = 4096

#: Results that a task may keep at once (queries of a pass times k), and scores in one block.
HELD, CELLS = 1_000_000, 1_000_000


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """queries (query_id, embedding), corpus (page_id, chunk_id, embedding) -> (query_id, rank, page_id, chunk_id, score).

    Each task keeps its own top k per query over all its batches, so at most k rows per query and task are shuffled
    before the final limit.  Query vectors are broadcast in blocks, so many that queries times k are bounded; scores are computed in blocks of CELLS.
    Ties by page_id, chunk_id.  Null vectors and vectors of another length match nothing.
    """
    bounded_batches(corpus.sparkSession)
    parts = -(-queries.count() // max(1, min(QUERY_BLOCK, HELD // k))) or 1
    out = None
    for p in range(parts):
        rows = queries.where(F.col("embedding").isNotNull()).where(F.expr(f"pmod(xxhash64(query_id), {parts}) = {p}")).collect()
        part = _block(rows, corpus, queries.schema["query_id"].dataType.simpleString(), k, digits)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id", "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "page_id", "chunk_id", "score")


def _block(rows: list, corpus: DataFrame, kind: str, k: int, digits: int) -> DataFrame:
    ids = np.array([r.query_id for r in rows], dtype=object)
    vecs = np.array([list(r.embedding) for r in rows], dtype=np.float64)
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    sent = corpus.sparkSession.sparkContext.broadcast(vecs)  # QUERY_BLOCK vectors at most
    cells = CELLS

    def matrix(v: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of the asked length, and where they stand."""
        ok = (v.is_valid().to_numpy(zero_copy_only=False)) & (v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
        at = np.flatnonzero(ok)
        return v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims), at

    def run(batches):
        asked = sent.value
        if not len(ids):
            return
        held, waiting, n = None, [], 0  # the best so far, and (query, score, page, chunk) still to be ranked
        least = np.full(len(ids), -np.inf)  # once k are found, no lower score counts

        def cut():
            nonlocal held, waiting, n
            q, score, page, chunk = (np.concatenate(x) for x in zip(*([held] if held else []), *waiting, strict=True))
            at = np.lexsort((chunk, page, -score, q))
            first = np.searchsorted(q[at], np.arange(len(ids)))
            place = np.arange(len(at)) - first[q[at]]
            at, last = at[place < k], at[place == k - 1]
            least[q[last]] = score[last]
            held, waiting, n = (q[at], score[at], page[at], chunk[at]), [], 0

        step = max(1, cells // len(ids))
        for b in batches:
            x, ok = matrix(b.column(2), asked.shape[1])
            page, chunk = (b.column(i).to_numpy(zero_copy_only=False)[ok] for i in (0, 1))
            for lo in range(0, len(x), step):
                s = np.round(asked @ x[lo : lo + step].T, digits)
                q, r = np.nonzero(s >= least[:, None])
                waiting.append((q, s[q, r], page[lo + r], chunk[lo + r]))
                n += len(q)
                if n >= cells:
                    cut()
        if waiting:
            cut()
        for lo in range(0, 0 if held is None else len(held[0]), 65_536):
            q, score, page, chunk = (x[lo : lo + 65_536] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q].tolist(), id_type), pa.array(page, pa.int64()), pa.array(chunk, pa.int64()), pa.array(score, pa.float64())], ["query_id", "page_id", "chunk_id", "score"])

    src = corpus.selectExpr("cast(page_id as bigint) page_id", "cast(chunk_id as bigint) chunk_id", "embedding")
    return src.mapInArrow(run, f"query_id {kind}, page_id bigint, chunk_id bigint, score double")
