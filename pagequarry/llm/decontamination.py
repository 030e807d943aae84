"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows and exact edit verification.

Texts and items are words (runs of letters and digits, A-Z lower-cased).  A text is contaminated by an item of m words if some
run of its words is within floor(m / 5) word edits of it (0 for items under SHORT words).

For each size m of an item, windows of m words begin at every word of a text.  With d = floor(m / 5) edits allowed, some nearest run of a match
begins with a word that is among the item's first d + 1, and the window that begins there holds at most d words of no item of
that size; windows without either are passed over, and nothing else is.  Each of WALKS
independent CGK random walks embeds window and items into 3m symbols, edits becoming few mismatches; each of TABLES
repetitions of a walk samples SAMPLED positions, and the sampled symbols name a bucket.  The items lie in the buckets, every window looks up
its own, and window and item that meet in any are a candidate pair.  Candidates are verified by exact edit distance against the
window widened by the allowed edits.

Items without words match nothing; null and empty texts have no hits; very long texts are searched whole; repeated rows get their own hits; of
equally near runs the first counts; a column ``hits`` of the texts gives way to the new one; an empty table gives no rows and an
empty benchmark no hits.  The items are collected only in parts of at most PART_CHARS characters (or one item), each part a pass of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import NON_ALNUM, Words, chunks, mapped, mix, ship

SHORT, WALKS, TABLES, SAMPLED, PART_CHARS = 8, 3, 24, 2, 8_000_000
#: Windows embedded at a time.
ROWS = 4096
HITS = "array<struct<item_id:bigint,distance:int,start_word:int,end_word:int>>"
_PAD = np.uint64(0x9E3779B97F4A7C15)


def allowed(m: int) -> int:
    return m // 5 if m >= SHORT else 0


def embed(x: np.ndarray, walks: int) -> np.ndarray:
    """CGK: rows of m symbols become, in each walk, rows of 2m, the walk at step j moving on by a random bit of the symbol.

    The walk's third m steps, in which it stands at the end as a rule, are left out: they are not sampled.
    """
    rows, m = x.shape
    flat = np.concatenate([x, np.full((rows, 1), _PAD, dtype=np.uint64)], axis=1).ravel()
    out = np.empty((2 * m, walks, rows), dtype=np.uint64)
    at = np.tile(np.arange(rows, dtype=np.int64) * (m + 1), walks)
    end = at + m
    shift = np.repeat(np.arange(walks, dtype=np.int64) * len(flat), rows)
    for j in range(2 * m):
        if j % 64 == 0:  # 64 random bits of each symbol, one for each of the next steps
            bits = np.concatenate([mix(flat + np.uint64(0xC2B2AE3D27D4EB4F * (1 + j // 64 + (w << 16)) % (1 << 64))) for w in range(walks)])
        np.take(flat, at, out=out[j].reshape(-1), mode="clip")
        at += (bits.take(at + shift, mode="clip") >> np.uint64(j % 64) & np.uint64(1)).view(np.int64)
        np.minimum(at, end, out=at)
    return out.transpose(1, 2, 0)


def sampled(m: int, walk: int) -> np.ndarray:
    """The positions of each repetition."""
    rng = np.random.Generator(np.random.PCG64([m, walk] if walk else m))
    return rng.integers(0, 2 * m, (TABLES, SAMPLED))


def buckets(x: np.ndarray, m: int, walk: int) -> np.ndarray:
    """The bucket of each row of an embedding, in each repetition (rows by TABLES)."""
    h = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), (len(x), TABLES))
    for p in sampled(m, walk).T:
        h = (h ^ x[:, p]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the run of ``text`` nearest to ``item``; of equals the first to end, and its longest."""

    def ends(p: np.ndarray, t: np.ndarray, free: bool) -> np.ndarray:
        idx = np.arange(len(t) + 1)
        row = np.zeros(len(t) + 1, dtype=np.int64) if free else idx.copy()
        for i, s in enumerate(p, 1):
            new = np.minimum(row[1:] + 1, row[:-1] + (t != s))
            row = np.minimum.accumulate(np.concatenate([[i], new]) - idx) + idx
        return row

    row = ends(item, text, True)
    end = int(np.argmin(row))
    back = ends(item[::-1], text[:end][::-1], False)
    size = int(np.flatnonzero(back == back.min())[-1])
    return int(row[end]), end - size, end


def least_distances(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Row by row, the edit distance of the item to the nearest run of the text; all rows advance together."""
    if not len(texts):
        return np.zeros(0, dtype=np.int16)
    idx = np.arange(texts.shape[1] + 1, dtype=np.int16)
    row = np.zeros((len(texts), len(idx)), dtype=np.int16)
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + np.int16(1), row[:, :-1] + (texts != items[:, i : i + 1]), out=new[:, 1:])
        new -= idx
        np.minimum.accumulate(new, axis=1, out=new)
        row = new + idx
    return row.min(axis=1)


_BITS = np.uint64((1 << 20) - 1)


class Items:
    """What the executors need of the items: by size their words, the words they use, and the buckets they lie in."""

    def __init__(self, rows: list[tuple[int, str]]):
        w = Words([t.encode() for _, t in rows], NON_ALNUM, lower=True)
        h = w.hash
        self.ids = [i for i, _ in rows]
        self.words = [h[a:b] for a, b in zip(w.first, w.last, strict=True)]
        #: By 64 sizes: the sizes, and for the low bits of a word's hash the sizes (as bits) whose items use such a word.
        #: Likewise for the words among an item's first d + 1.
        self.users: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        #: By size and walk: the buckets in order, the item in each, and the low bits of those that are full.
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.matrix: dict[int, np.ndarray] = {}
        self.place = np.zeros(len(rows), dtype=np.int64)
        by: dict[int, list[int]] = {}
        for k, x in enumerate(self.words):
            if len(x):
                by.setdefault(len(x), []).append(k)
        for lo in range(0, len(by), 64):
            group = sorted(by)[lo : lo + 64]
            table, first = np.zeros(1 << 20, dtype=np.uint64), np.zeros(1 << 20, dtype=np.uint64)
            for bit, m in enumerate(group):
                for t, size in ((table, m), (first, allowed(m) + 1)):
                    t[np.unique(np.concatenate([self.words[k][:size] for k in by[m]]) & _BITS)] |= np.uint64(1 << bit)
            self.users.append((group, table, first))
        for m, items in by.items():
            own = np.array(items)
            self.matrix[m] = x = np.stack([self.words[k] for k in items])
            self.place[own] = np.arange(len(own))
            for walk, e in enumerate(embed(x, WALKS if allowed(m) else 1)):
                key = buckets(e, m, walk).ravel()
                order = np.argsort(key, kind="stable")
                full = np.zeros(1 << 16, dtype=bool)
                full[key & np.uint64(0xFFFF)] = True
                self.tables[m, walk] = key[order], np.repeat(own, TABLES)[order], full

    def hits(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for lo, hi in chunks(texts):
            w = Words(texts[lo:hi], NON_ALNUM, lower=True)
            if not len(w.start):
                continue
            h = w.hash
            n = len(h)
            left = w.left()
            for group, table, first in self.users:
                # a byte of each word's sizes at a time
                uses, begins = (np.ascontiguousarray(t[h & _BITS].view(np.uint8).reshape(n, 8).T) for t in (table, first))
                total = np.zeros(n + 1 + group[-1], dtype=np.int32)
                for bit, m in enumerate(group):
                    d = allowed(m)
                    np.cumsum(uses[bit // 8] >> np.uint8(bit % 8) & np.uint8(1), out=total[1 : n + 1])
                    total[n + 1 :] = total[n]
                    at = np.flatnonzero((total[m : m + n] - total[:n] >= m - d) & ((begins[bit // 8] >> np.uint8(bit % 8) & np.uint8(1)) > 0))
                    # the text's end may cut windows short
                    at = at[(left[at] >= m) | (left[at] >= m - d) & (total[at + np.minimum(left[at], m)] - total[at] >= m - d)]
                    for s in range(0, len(at), ROWS):
                        self.look(at[s : s + ROWS], m, h, w, lo, out)
        return [best(x) for x in out]

    def look(self, start: np.ndarray, m: int, h: np.ndarray, w: Words, lo: int, out: list) -> None:
        """Looks windows up in the buckets and verifies what they meet there."""
        at = start[:, None] + np.arange(m)[None, :]
        x = np.where(at < w.last[w.doc[start]][:, None], h[np.minimum(at, len(h) - 1)], _PAD)
        met: list[np.ndarray] = []
        for walk, e in enumerate(embed(x, WALKS if allowed(m) else 1)):
            key, item, full = self.tables[m, walk]
            own = buckets(e, m, walk)
            maybe = full[own & np.uint64(0xFFFF)]
            row, own = np.nonzero(maybe)[0], own[maybe]
            a, b = np.searchsorted(key, own), np.searchsorted(key, own, "right")
            k = b - a
            i = np.repeat(a, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            met.append(np.repeat(row, k) * len(self.ids) + item[i])
        pair = np.unique(np.concatenate(met))
        if not len(pair):
            return
        self.verify(pair % len(self.ids), start[pair // len(self.ids)], m, h, w, lo, out)

    def verify(self, item: np.ndarray, start: np.ndarray, m: int, h: np.ndarray, w: Words, lo: int, out: list) -> None:
        d, doc = allowed(m), w.doc[start]
        # what lies outside the text equals no word
        at = start[:, None] + np.arange(-d, m + d)[None, :]
        inside = (at >= w.first[doc][:, None]) & (at < w.last[doc][:, None])
        region = np.where(inside, h[np.clip(at, 0, len(h) - 1)], _PAD)
        wanted = self.matrix[m][self.place[item]]
        # all but d of an item's words must be there in any order
        there = np.zeros(wanted.shape, dtype=bool)
        for j in range(region.shape[1]):
            there |= wanted == region[:, j : j + 1]
        near = np.flatnonzero(there.sum(axis=1) >= m - d)
        near = near[least_distances(wanted[near], region[near]) <= d]
        if not len(near):
            return
        # windows next to each other that near one item are measured as one region
        order = near[np.lexsort((start[near], item[near]))]
        item, start, doc = item[order], start[order], doc[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > d + 1)
        head = np.flatnonzero(new)
        for i, j in zip(head.tolist(), np.append(head[1:], len(order)).tolist(), strict=True):
            first, last = int(w.first[doc[i]]), int(w.last[doc[i]])
            a, b = max(first, int(start[i]) - d), min(last, int(start[j - 1]) + m + d)
            dist, s, e = best_run(self.words[item[i]], h[a:b])
            if dist <= d:
                out[lo + doc[i]].append((self.ids[item[i]], dist, a - first + s, a - first + e))


def best(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The nearest hit of each item."""
    by: dict[int, tuple[int, int, int, int]] = {}
    for x in sorted(hits, key=lambda x: (x[1], x[2], x[3])):
        by.setdefault(x[0], x)
    return [by[k] for k in sorted(by)]


def _marked(docs: DataFrame, rows: list[tuple[int, str]], text_col: str) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Items(rows))  # at most PART_CHARS characters of items
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"hits {HITS}"])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32())]))

    def run(batches):
        items = sent.value
        for b in batches:
            hits = items.hits([(t or "").encode() for t in b.column(at).to_pylist()])
            rows = [[dict(zip(("item_id", "distance", "start_word", "end_word"), x, strict=True)) for x in own] for own in hits]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*b.schema.names, "hits"])

    return mapped(docs, run, schema, "decontamination")


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``hits``: the nearest run of words for each item that is within its allowed edits."""
    ship(docs.sparkSession)
    items = benchmark.selectExpr("cast(item_id as bigint) item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # parts by a hash come out uneven: half the bound on average, and a check of each
    parts = -(-2 * total // PART_CHARS) or 1
    while parts > 1:
        over = items.groupBy(F.expr(f"pmod(xxhash64(item_id), {parts})")).agg(F.sum(F.length("text")).alias("n"), F.countDistinct("item_id").alias("k")).where(f"n > {PART_CHARS} and k > 1")
        if over.isEmpty():
            break
        parts *= 2
    src = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != "hits"])
    out = None
    for p in range(parts):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id), {parts}) = {p}")).collect()
        if out is not None and not rows:
            continue
        if out is None:
            out = _marked(src, [tuple(r) for r in rows], text_col)
        else:
            more = _marked(out.withColumnRenamed("hits", "_hits"), [tuple(r) for r in rows], text_col)
            out = more.withColumn("hits", F.concat("_hits", "hits")).drop("_hits")
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word: a row for each text and item that match."""
    marked = mark_contaminated(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), benchmark)
    return marked.selectExpr("doc_id", "inline(hits)")
