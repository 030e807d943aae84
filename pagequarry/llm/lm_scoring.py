"""Stupid-backoff scores against the corpus' own n-gram counts, without the text's own share.

S(w | u v) = c(u v w) / c(u v) if u v w occurs in another text, else BACKOFF * S(w | v), and so on down to c(w) / N, where a
word of no other text counts as one (as BACKOFF, if it is the first of its text).  The context is the ``order`` - 1 words
before, or as many as there are.  Counts leave out the scored text.  A text's score is the sum of ln S over its words.

The count tables are partitioned by hash range.  Rows are packed: one holds a block's distinct
n-grams (sorted 64-bit hashes, as differences of six bytes) that fall in one range, with their counts.
  1. Each block of texts (a run of the scan of about BLOCK_BYTES) is exploded and pre-aggregated into such rows.
  2. Rows of a range meet, are summed to the count table, and joined back to each row's n-grams.
  3. The joined counts return to their block, where scores are summed per text.
A frequent n-gram is one entry per block, so no range gathers rows in proportion to its frequency.  There are so many ranges that one
holds the n-grams of about RANGE_BYTES of text, however large the corpus.  Each block's rows bear a sum of its hashes: a block that is
other when it is read again (texts changed, or other rows) raises instead of scoring wrongly.

Null, empty and blank texts have no words and score 0; very long texts are one block and are scored part by part; an empty table gives no rows.  Words
are runs between ASCII white space, A-Z lower-cased.  Repeated rows are separate texts of the corpus; null ids are scored like any other; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import Words, chunks, grams, mapped, materialize, mix, partitions, ship

BACKOFF, BLOCK_BYTES, RANGE_BYTES = 0.4, 16_000_000, 64_000_000

#: Words of the longest n-grams of the registered query.
ORDER = 3


def ngrams(texts: list[bytes], order: int):
    """Part by part of the texts: the text of every word, and for n from 1 to ``order`` the hash of the n-gram that ends there (0 if its text has too few words before)."""
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi], lower=True)
        h = w.hash
        place = np.arange(len(h)) - w.first[w.doc]
        every = [mix(h ^ np.uint64(0xA5A5A5A5))]
        for k in range(2, order + 1):
            g = np.zeros(len(h), dtype=np.uint64)
            g[k - 1 :] = grams(h, k)
            g[place < k - 1] = 0
            every.append(g)
        yield w.doc + lo, every


def present(every: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([every[0], *(g[g > 0] for g in every[1:])])


def distinct(x: np.ndarray) -> np.ndarray:
    """As ``np.unique``, whose hash table is many times slower than this sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def pack(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, of six bytes where they fit."""
    d = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    wide = 8 if len(d) and int(d[1:].max(initial=0)) >> 48 else 6
    head = d[:1].tobytes()
    return bytes([wide]) + head + d[1:].view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    wide = raw[0]
    head = np.frombuffer(raw[1:9], dtype="<u8")
    rest = np.frombuffer(raw[9:], dtype=np.uint8).reshape(-1, wide)
    d = np.zeros((len(rest), 8), dtype=np.uint8)
    d[:, :wide] = rest
    return np.cumsum(np.concatenate([head, d.view("<u8").ravel()]), dtype=np.uint64)


def small(n: np.ndarray) -> bytes:
    """Counts, in the least width that holds them, deflated."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(n) or int(n.max()) <= np.iinfo(k).max)
    return kind.encode() + zlib.compress(n.astype(kind).tobytes(), 1)


def counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[3:]), dtype=raw[:3].decode()).astype(np.int64)


def blocks(batches, at: int):
    """Runs of the rows of one scan task, by size: (number, ids, texts).  The scan's order makes them the same each time."""
    ids, texts, size, number = [], [], 0, 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(at).to_pylist(), strict=True):
            t = (t or "").encode()
            if ids and size + len(t) > BLOCK_BYTES:
                yield number, ids, texts
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield number, ids, texts


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 20


def _explode(docs: DataFrame, ranges: int, order: int) -> DataFrame:
    def run(batches):
        part = _part()
        for number, _, texts in blocks(batches, 1):
            parts = [every for _, every in ngrams(texts, order)]
            h, n = np.unique(np.concatenate([present(x) for x in parts]), return_counts=True)
            mark = checksum(h)
            # its words: what the range's share of N is counted by
            words = distinct(np.concatenate([x[0] for x in parts]))
            del parts
            cut = np.searchsorted(h, np.array([(r << 64) // ranges for r in range(1, ranges)], dtype=np.uint64)).tolist()
            places = [0, *cut, len(h)]
            total = np.zeros(len(h), dtype=np.int64)
            total[np.searchsorted(h, words)] = n[np.searchsorted(h, words)]
            for r in range(ranges):
                a, b = places[r], places[r + 1]
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part + number], pa.int64()), pa.array([pack(h[a:b])], pa.binary()), pa.array([small(n[a:b])], pa.binary()), pa.array([int(total[a:b].sum())], pa.int64()), pa.array([mark], pa.int64())], ["r", "block", "grams", "n", "words", "mark"])

    return mapped(docs, run, "r int, block bigint, grams binary, n binary, words bigint, mark bigint", "lm")


def _count(packed: DataFrame) -> DataFrame:
    """The count table of each range, joined back to the rows it came from: total counts in their order."""

    def settle(rows: list[tuple]):
        own = [unpack(r[2]) for r in rows]
        key, inv = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(inv, weights=np.concatenate([counts(r[3]) for r in rows]), minlength=len(key)).astype(np.int64)[inv]
        head = np.cumsum([0, *map(len, own)])
        for i, r in enumerate(rows):
            yield pa.RecordBatch.from_arrays([pa.array([r[1]], pa.int64()), pa.array([r[0]], pa.int32()), pa.array([small(total[head[i] : head[i + 1]])], pa.binary()), pa.array([r[4]], pa.int64()), pa.array([r[5]], pa.int64())], ["block", "r", "total", "words", "mark"])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][0] != r[0]:
                    yield from settle(held)
                    held = []
                held.append(r)
        if held:
            yield from settle(held)

    dealt = packed.repartition(partitions(packed.sparkSession), "r").sortWithinPartitions("r", "block")
    return mapped(dealt, run, "block bigint, r int, total binary, words bigint, mark bigint", "lm")


def others(g: np.ndarray, doc: np.ndarray, h: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in other texts than its own."""
    at = np.argsort(g)
    g = g[at]
    new = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
    run = np.cumsum(new) - 1
    _, inv, own = np.unique(run * (int(doc.max(initial=0)) + 1) + doc[at], return_inverse=True, return_counts=True)
    out = np.empty(len(g), dtype=np.int64)
    out[at] = total[np.searchsorted(h, g[new])][run] - own[inv]
    return out


def checksum(h: np.ndarray) -> int:
    """Of distinct hashes, in any order."""
    return int(np.add.reduce(mix(h)).view(np.int64)) if len(h) else 0


def scores(texts: list[bytes], total: np.ndarray, n: int, order: int, mark: int | None = None) -> list[tuple[int, float]]:
    """(words, score) of a block's texts, given the corpus counts of its distinct n-grams in order of hash."""
    # only distinct n-grams are held for the whole block; texts are scored part by part
    h = distinct(np.concatenate([np.zeros(0, dtype=np.uint64), *(distinct(present(every)) for _, every in ngrams(texts, order))]))
    if len(h) != len(total) or mark is not None and checksum(h) != mark:
        raise RuntimeError("the block differs from the one that was counted")
    size, out = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    for doc, every in ngrams(texts, order):
        if not len(doc):
            continue
        words = np.bincount(doc, minlength=len(texts))
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        c = others(every[0], doc, h, total)
        s = np.maximum(c, np.where(first, BACKOFF, 1)) / np.maximum(n - words[doc], 1)
        for g in every[1:]:
            has = np.flatnonzero(g)
            before, c = c, np.zeros(len(doc), dtype=np.int64)
            c[has] = others(g[has], doc[has], h, total)
            s[has] = np.where(c[has] > 0, c[has] / np.maximum(before[has - 1], 1), BACKOFF * s[has])
        size += words
        out += np.bincount(doc, weights=np.log(s), minlength=len(texts))
    return list(zip(size.tolist(), out.tolist(), strict=True))


def _score(docs: DataFrame, totals: DataFrame, n: int, order: int) -> DataFrame:
    def label(batches):
        part = _part()
        for number, ids, texts in blocks(batches, 1):
            for lo in range(0, len(ids), 500):
                x = slice(lo, lo + 500)
                k = len(ids[x])
                yield pa.RecordBatch.from_arrays([pa.array([part + number] * k, pa.int64()), pa.array(range(lo, lo + k), pa.int32()), pa.array(ids[x], pa.int64()), pa.array(texts[x], pa.binary())], ["block", "at", "doc_id", "body"])

    def settle(total: list[bytes], ids: list, texts: list[bytes], mark: int | None):
        got = scores(texts, np.concatenate([counts(t) for t in total]) if total else np.zeros(0, dtype=np.int64), n, order, mark)
        words, s = [g[0] for g in got], [g[1] for g in got]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(s, pa.float64()), pa.array([b / a if a else None for a, b in got], pa.float64())], ["doc_id", "n_words", "score", "mean_score"])

    def run(batches):
        block, total, ids, texts, mark = None, [], [], [], None
        for b in batches:
            for k, kind, _, i, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != block and block is not None:
                    yield settle(total, ids, texts, mark)
                    total, ids, texts, mark = [], [], [], None
                block = k
                if kind:
                    ids.append(i)
                    texts.append(body)
                else:
                    total.append(body)
                    mark = i
        if block is not None:
            yield settle(total, ids, texts, mark)

    rows = mapped(docs, label, "block bigint, at int, doc_id bigint, body binary", "lm").selectExpr("block", "1 kind", "at", "doc_id", "body")
    rows = rows.unionByName(totals.selectExpr("block", "0 kind", "r at", "mark doc_id", "total body"))
    dealt = rows.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind", "at")
    return mapped(dealt, run, "doc_id bigint, n_words bigint, score double, mean_score double", "lm")


def backoff_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, n_words, score, mean_score: one row per row of ``docs``."""
    ship(docs.sparkSession)
    src = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    totals = materialize(_count(_explode(src, max(partitions(docs.sparkSession), -(-size // RANGE_BYTES)), order)), "count")
    n = totals.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    return _score(src, totals, n, order)
