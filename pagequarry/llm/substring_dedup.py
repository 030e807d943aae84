"""Substring dedup with one compressed FM-index per shard.

A word is removed if a window of WINDOW words that covers it also starts earlier (smaller doc_id, or
earlier in the same text).  Every window is dealt by its anchor, the least of its GRAM-word hashes, so equal windows
meet; windows in a row with one anchor form a segment.  Segments whose anchor occurs once in all texts can hold
no repeat and stop there, before any words are sent.  Equal segments are gathered first: only the earliest is
sent on, the others repeat it whole.  A shard indexes the distinct segments of its anchors, in
order of their places: wavelet matrix of the BWT over words.  Streaming the segments back through it by
backward search gives their matching statistics; windows that reach WINDOW words and share
an interval are repeats of the one first in the index.

Anchors with more than HOT distinct segments (a frequent phrase in ever new surroundings) would crowd one shard;
their windows are dealt on by the hash of the whole window and settled by minimum.

Null, empty and short texts keep all their words; very long texts are judged whole; an empty table gives no rows; other columns are ignored, whatever
their names.  Words are told apart by 64-bit hashes, segments of one anchor by 64 bits more.  Rows with one id count as one document: what is found in any of
them goes at the same places in each.  Rows without an id are not compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import Words, chunks, discard, grams, mapped, materialize, mix, partitions, powers, ship, split_join
from pagequarry.llm.fm_index import FMIndex, matching_statistics

WINDOW, GRAM, HOT, SHARD_WORDS = 20, 5, 512, 300_000
_MUL = 0xD1B54A32D192ED03 | 1


def segments(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each run of windows with one anchor; places are word numbers."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z
    g = grams(h, GRAM)
    span = WINDOW - GRAM + 1
    at = np.arange(len(g))
    done = 1
    while done < span:  # leftmost least gram of each run of grams, doubling the run
        step = min(done, span - done)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        done += step
    ok = np.flatnonzero(w.left()[:n] >= WINDOW)
    if not len(ok):
        return np.zeros(0, dtype=np.uint64), ok, ok
    anchor = at[ok]
    new = np.concatenate([[True], (ok[1:] != ok[:-1] + 1) | (anchor[1:] != anchor[:-1])])
    head = np.flatnonzero(new)
    return g[anchor[head]], ok[head], np.diff(np.append(head, len(ok)))


_POW: dict[str, np.ndarray] = {}


def run_hashes(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the ``size`` word hashes from each ``start``."""
    n = len(h) + 1
    if len(_POW.get("p", ())) < n:
        _POW["p"], _POW["i"] = powers(_MUL, 2 * n), powers(pow(_MUL, -1, 1 << 64), 2 * n)
    total = np.zeros(n, dtype=np.uint64)
    np.cumsum(h * _POW["p"][: n - 1], out=total[1:])
    return mix((total[start + size] - total[start]) * _POW["i"][start] + size.astype(np.uint64))


def _texts(b: pa.RecordBatch, column: str) -> list[bytes]:
    return [(t or "").encode() for t in b.column(column).to_pylist()]


def _anchors(docs: DataFrame, with_place: bool) -> DataFrame:
    names = ["ah", "sh", "doc_id", "place"] if with_place else ["ah"]

    def run(batches):
        for b in batches:
            ids = np.array(b.column("doc_id").to_pylist(), dtype=np.int64)
            texts = _texts(b, "text")
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                h = w.hash
                ah, start, size = segments(w, h)
                cols = [pa.array(ah.view(np.int64))]
                if with_place:
                    doc = w.doc[start]
                    # a segment has at most WINDOW - GRAM + 1 windows
                    cols += [pa.array(run_hashes(h, start, size + WINDOW - 1).view(np.int64)), pa.array(ids[lo + doc]), pa.array((start - w.first[doc]) * 32 + size)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return mapped(docs, run, ", ".join(f"{n} bigint" for n in names), "substring")


def repeats(sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Segments laid end to end, in order of place: by window, whether it has come before."""
    _, symbol = np.unique(words, return_inverse=True)
    head = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # one separator after each segment
    text = np.zeros(len(words) + len(sizes), dtype=np.int64)
    text[np.arange(len(words)) + owner] = symbol + 1
    inside = np.arange(len(words)) - head[owner]
    last = inside >= WINDOW - 1
    end = (np.arange(len(words)) + owner + 1)[last]
    index = FMIndex(text, WINDOW + 1)
    length, first = matching_statistics(index, text, end, WINDOW)
    full = np.flatnonzero(length == WINDOW)
    out = np.zeros(len(end), dtype=bool)
    out[full] = True
    _, earliest = np.unique(first[full], return_index=True)
    out[full[earliest]] = False
    return out


def _search(cold: DataFrame) -> DataFrame:
    """ah, sh, mask (bit i: window i of the segment's earliest place has come before)."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted({r[:2]: r for r in rows}.values(), key=lambda r: (r[2], r[3]))  # rows with one id may bring a segment twice
        words = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
        sizes = np.array([len(x) for x in words])
        dup = repeats(sizes, np.concatenate(words))
        n = sizes - WINDOW + 1
        head = np.cumsum(n) - n
        bit = dup.astype(np.int64) << (np.arange(len(dup)) - np.repeat(head, n))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(np.add.reduceat(bit, head))], ["ah", "sh", "mask"])

    def run(batches):
        held: list[tuple] = []
        total, last = 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if total > SHARD_WORDS and r[0] != last:
                    yield settle(held)
                    held, total = [], 0
                held.append(r)
                last, total = r[0], total + len(r[4]) // 8
        if held:
            yield settle(held)

    dealt = cold.select("ah", "sh", "doc_id", "start", "words").repartition(partitions(cold.sparkSession), "ah").sortWithinPartitions("ah")
    return mapped(dealt, run, "ah bigint, sh bigint, mask bigint", "substring")


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of the earliest place of each distinct segment; for hot anchors one row with a hash for each window."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("ah", "sh", "place", "hot")).alias("x"))
    names = ["ah", "sh", "doc_id", "start", "words", "wh", "wh2"]

    def run(batches):
        for b in batches:
            ids, texts, wants = b.column("doc_id").to_pylist(), _texts(b, "text"), b.column("x").to_pylist()
            rows: list[tuple] = []
            for doc, text, want in zip(ids, texts, wants, strict=True):
                h = Words([text]).hash
                for x in want:
                    start, size = x["place"] // 32, x["place"] % 32
                    run_ = h[start : start + size + WINDOW - 1]
                    at = np.zeros(1, dtype=np.int64)
                    if len(run_) < size + WINDOW - 1 or int(run_hashes(run_, at, at + len(run_)).view(np.int64)[0]) != x["sh"]:
                        continue  # another text under the same id
                    if not x["hot"]:
                        rows.append((x["ah"], x["sh"], doc, start, run_.tobytes(), None, None))
                        continue
                    at = np.arange(size)
                    one = run_hashes(run_, at, np.full(size, WINDOW)).view(np.int64).tolist()
                    two = run_hashes(mix(run_), at, np.full(size, WINDOW)).view(np.int64).tolist()
                    rows += [(x["ah"], x["sh"], doc, start + i, None, one[i], two[i]) for i in range(size)]
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    both = docs.join(lists, "doc_id").select("doc_id", "text", "x")
    return mapped(both, run, "ah bigint, sh bigint, doc_id bigint, start bigint, words binary, wh bigint, wh2 bigint", "substring")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, start, mask: windows start + i, for each bit i of mask, also start earlier."""
    src = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null and text is not null")
    twice = materialize(_anchors(src, False).groupBy("ah").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    placed = materialize(split_join(_anchors(src, True), twice, "ah", "n"), "anchor")
    discard(twice)
    distinct = materialize(placed.groupBy("ah", "sh").agg(F.min(F.struct("doc_id", "place")).alias("m"), F.count("*").alias("n")).selectExpr("ah", "sh", "m.doc_id doc_id", "m.place place", "n"), "segment")
    hot = distinct.groupBy("ah").agg(F.count("*").alias("n")).where(f"n > {HOT}").selectExpr("ah", "true hot")
    wanted = distinct.drop("n").join(hot, "ah", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cut = materialize(_cut(src, wanted), "words")
    cold = _search(cut.where("words is not null"))
    window = cut.where("words is null").drop("words").dropDuplicates(["ah", "sh", "start"])
    least = window.groupBy("wh", "wh2").agg(F.min(F.struct("doc_id", "start")).alias("w"))
    late = window.join(least, ["wh", "wh2"]).groupBy("ah", "sh").agg(F.collect_list(F.struct("start", (F.struct("doc_id", "start") > F.col("w")).alias("late"))).alias("x"))
    # bits count from the segment's first window
    crowded = late.selectExpr("ah", "sh", "aggregate(x, 0L, (a, y) -> a + if(y.late, shiftleft(1L, cast(y.start - array_min(x.start) as int)), 0L)) mask")
    masks = materialize(distinct.join(cold.unionByName(crowded), ["ah", "sh"]).selectExpr("ah", "sh", "doc_id first_doc", "place first_place", "mask", "n"), "mask")
    discard(cut, distinct)
    # a passage of many documents is one key: its places are dealt over all tasks
    every = split_join(placed, masks, ["ah", "sh"], "n").selectExpr("doc_id", "place div 32 start", "case when doc_id = first_doc and place = first_place then mask else shiftleft(1L, cast(place % 32 as int)) - 1 end mask")
    return every.where("mask <> 0")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_kept_runs: one row per row of ``docs``."""
    return removed(docs).drop("kept")


def removed(docs: DataFrame) -> DataFrame:
    """As ``substring_dedup``, with the kept words themselves (joined by blanks) in ``kept``."""
    ship(docs.sparkSession)
    lists = materialize(repeated_windows(docs), "repeat").groupBy("doc_id").agg(F.collect_list(F.struct("start", "mask")).alias("x"))

    def run(batches):
        for b in batches:
            rows = []
            for text, x in zip(_texts(b, "text"), b.column("x").to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words), dtype=bool)
                if x:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    start = np.array([y["start"] for y in x])
                    mask = np.array([y["mask"] for y in x])
                    for i in range(WINDOW):
                        s = start[(mask >> i) & 1 == 1] + i
                        s = s[s + WINDOW <= len(words)]
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + WINDOW, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                runs = int((~gone[1:] & gone[:-1]).sum() + (len(gone) > 0 and not gone[0]))
                rows.append((len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), runs, kept.decode()))
            cols = [b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "n_kept_runs", "kept"])

    both = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(lists, "doc_id", "left").select("doc_id", "text", "x")
    return mapped(both, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_kept_runs bigint, kept string", "substring")
