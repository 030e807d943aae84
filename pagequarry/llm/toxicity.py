"""Toxicity by subword bags: averaged embeddings under a linear softmax, trained jointly in numpy.

A word (run of letters and digits, A-Z lower-cased) is the mean of the embeddings of its hashed character
3-5-grams, blanks at both ends included, and of the word itself, so unseen misspellings share most of
their vectors.  A passage of PASSAGE words is the mean of its words; the softmax gives its odds; a text takes its
worst passage, set to the labels' prior by a two-parameter logistic fit.

Training uses at most ``max_rows`` labelled texts of each class, first in the order of a hash of the id,
in one executor task; an id that is given repeatedly counts once, with its text of least hash, and once for each of its labels.  Null and empty texts score like a passage without
words, very long ones by all their passages; repeated rows and rows with a null id are scored like any other.  Without both classes every
score is 0; an empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import NON_ALNUM, Words, chunks, crc_mod, mapped, mix, ship

BUCKETS, DIM, PASSAGE, SIZES = 1 << 20, 4, 32, (3, 4, 5)
#: Features of fewer texts' words than this keep no vector.
LEAST = 5
MAX_ROWS = 2000
SCALE = float(PASSAGE)


def gram_buckets(w: Words, n: int) -> np.ndarray:
    """The bucket of the n bytes from each position on, separators being blanks."""
    a = np.where(NON_ALNUM[w.arr], np.uint8(32), w.arr).astype(np.uint64)
    m = len(a) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        h = h * np.uint64(257) + a[j : j + m]
    return (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, number of features of each word), once per distinct word's place given."""
    places = np.arange(len(w.start))
    word, bucket = [places], [(w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)]
    size = w.end - w.start
    for n in SIZES:
        k = np.maximum(size + 3 - n, 0)
        own = np.repeat(places, k)
        at = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k) + (w.start - 1)[own]
        word.append(own)
        bucket.append(gram_buckets(w, n)[at])
    word, bucket = np.concatenate(word), np.concatenate(bucket)
    return word, bucket, np.bincount(word, minlength=len(places))


def passages(w: Words) -> np.ndarray:
    """The passage of each word, numbered within its text."""
    return (np.arange(len(w.start)) - w.first[w.doc]) // PASSAGE


def train(texts: list[bytes], label: np.ndarray, prior: float, steps: int = 40, rate: float = 0.2) -> dict:
    """Embeddings, softmax and final fit.  Returns one weight per bucket (embedding times softmax) and the scalars."""
    vocab: dict[int, int] = {}
    ids, doc, passage, feats, counts = [], [], [], [], []
    base = 0
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi], NON_ALNUM, lower=True)
        h, first, inv = np.unique(w.hash, return_index=True, return_inverse=True)
        fresh = np.array([x not in vocab for x in h.tolist()], dtype=bool)
        if fresh.any():
            sub = Words([w.buf[w.start[i] : w.end[i]] for i in first[fresh]], NON_ALNUM)
            _, b, k = word_features(sub)
            order = np.argsort(_, kind="stable")
            feats.append(b[order])
            counts.append(k)
            for x in h[fresh].tolist():
                vocab[x] = len(vocab)
        number = np.array([vocab[x] for x in h.tolist()], dtype=np.int64)
        p = passages(w)
        new = np.ones(len(p), dtype=bool)
        new[1:] = (w.doc[1:] != w.doc[:-1]) | (p[1:] != p[:-1])
        ids.append(number[inv])
        passage.append(base + np.cumsum(new) - 1)
        doc.append((w.doc + lo)[new])
        base += int(new.sum())
    ids, passage, doc = map(np.concatenate, (ids, passage, doc))
    feats, counts = np.concatenate(feats), np.concatenate(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    texts_of = np.bincount(np.unique(ids * np.int64(len(texts)) + doc[passage]) // len(texts), minlength=len(counts))
    kept = (np.bincount(feats, weights=texts_of[owner], minlength=BUCKETS) >= LEAST)[feats]
    feats, owner = feats[kept], owner[kept]
    word_at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    words_with = owner[word_at]
    by_bucket = np.argsort(feats, kind="stable")
    used, cut = np.unique(feats[by_bucket], return_index=True)
    by_owner = owner[by_bucket]
    per = np.bincount(passage).astype(np.float64)
    head = np.cumsum(per.astype(np.int64)) - per.astype(np.int64)
    by_word = np.argsort(ids, kind="stable")
    seen, word_cut = np.unique(ids[by_word], return_index=True)
    y = label[doc].astype(np.float64)

    rng = np.random.Generator(np.random.PCG64(7))
    slot = np.zeros(BUCKETS, dtype=np.int64)
    slot[used] = np.arange(len(used))
    feats = slot[feats]
    # One row per dimension, so that each sum runs over contiguous numbers.
    emb = rng.normal(0, 0.05, (DIM, len(used))).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    params = [emb, soft, bias]
    m1 = [np.zeros_like(x) for x in params]
    m2 = [np.zeros_like(x) for x in params]
    inv_counts = (1.0 / counts).astype(np.float32)
    inv_per = (SCALE / per).astype(np.float32)
    passage_by_word = passage[by_word]
    bag = np.zeros((DIM, len(per)), dtype=np.float32)
    d_emb = np.zeros_like(emb)
    # each class weighs alike, and each text within its class
    weight = 1.0 / np.bincount(doc, minlength=len(label))[doc]
    weight *= np.where(y == 1, 0.5 / max(1e-9, weight[y == 1].sum()), 0.5 / max(1e-9, weight[y == 0].sum()))
    for t in range(1, steps + 1):
        for k in range(DIM):
            word = np.zeros(len(counts), dtype=np.float32)
            word[words_with] = np.add.reduceat(emb[k][feats], word_at)
            bag[k] = np.add.reduceat((word * inv_counts)[ids], head) * inv_per
        z = bag.T @ soft + bias
        z -= z.max(axis=1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(axis=1, keepdims=True)
        g = prob.copy()
        g[np.arange(len(y)), y.astype(int)] -= 1
        g = (g * weight[:, None]).astype(np.float32)
        d_soft, d_bias = bag @ g, g.sum(axis=0)
        for k in range(DIM):
            d_word = np.zeros(len(counts), dtype=np.float32)
            d_word[seen] = np.add.reduceat(((g @ soft[k]) * inv_per)[passage_by_word], word_cut)
            d_emb[k] = np.add.reduceat((d_word * inv_counts)[by_owner], cut)
        for x, d, a, b in zip(params, (d_emb, d_soft, d_bias), m1, m2, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            x -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    out = {"weight": np.zeros(BUCKETS, dtype=np.float32), "bias": float(bias[1] - bias[0])}
    out["weight"][used] = (soft[:, 1] - soft[:, 0]) @ emb * np.float32(SCALE)
    # Final fit on the texts' worst passages, classes weighted to the prior.
    odds = worst_passages(texts, out)
    mean, dev = odds.mean(), odds.std() + 1e-9
    x = (odds - mean) / dev
    wt = np.where(label == 1, prior / max(1, label.sum()), (1 - prior) / max(1, (label == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(200):
        pr = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, s = wt * (pr - label), wt * pr * (1 - pr)
        ga, gb = (r * x).sum() + 1e-6 * a, r.sum()
        haa, hab, hbb = (s * x * x).sum() + 1e-6, (s * x).sum(), s.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    return out | {"a": float(a / dev), "b": float(b - a * mean / dev)}


def worst_passages(texts: list[bytes], model: dict) -> np.ndarray:
    """The largest passage log-odds of each text; those of an empty passage are the bias."""
    out = np.full(len(texts), model["bias"])
    weight = model["weight"].astype(np.float64)
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi], NON_ALNUM, lower=True)
        if not len(w.start):
            continue
        total = weight[(w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)]
        n = np.ones(len(total))
        size = w.end - w.start
        for k in SIZES:
            run = np.concatenate([[0.0], np.cumsum(weight[gram_buckets(w, k)])])
            many = np.maximum(size + 3 - k, 0)
            first = np.minimum(w.start - 1, len(run) - 1)
            total += np.where(many > 0, run[np.minimum(first + many, len(run) - 1)] - run[first], 0.0)
            n += many
        word = total / n
        p = passages(w)
        new = np.ones(len(p), dtype=bool)
        new[1:] = (w.doc[1:] != w.doc[:-1]) | (p[1:] != p[:-1])
        head = np.flatnonzero(new)
        odds = np.add.reduceat(word, head) / np.diff(np.append(head, len(p))) + model["bias"]
        docs = w.doc[head]
        cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        out[lo + docs[cut]] = np.maximum.reduceat(odds, cut)
    return out


def pack(model: dict | None) -> bytes:
    f = io.BytesIO()
    if model:
        np.savez_compressed(f, **{k: np.asarray(v) for k, v in model.items()})
    return f.getvalue()


def unpack(raw: bytes) -> dict | None:
    if not raw:
        return None
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] if z[k].ndim else float(z[k]) for k in z.files}


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> bytes:
    """Trains in one executor task on the bounded sample; the model (one weight per bucket) comes to the driver."""
    ship(docs.sparkSession)
    lab = labels.where("toxic in (0, 1)").selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic", "xxhash64(doc_id) place")
    counts = {r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return b""
    prior = counts[1] / (counts[0] + counts[1])
    bound = None
    for c in (0, 1):
        part = lab.where(f"toxic = {c}").orderBy("place", "doc_id").limit(max_rows)
        bound = part if bound is None else bound.unionByName(part)
    bound = bound.distinct()
    sample = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(text, '') text").join(F.broadcast(bound), "doc_id")
    # one text for each id, however often it is given: the one of least hash
    sample = sample.groupBy("place", "doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("place", "doc_id", "toxic", "t.text")

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], r[3]))
        label = np.array([r[2] for r in rows], dtype=np.int64)
        model = None
        if len(rows) and 0 < label.sum() < len(label):
            model = train([r[3].encode() for r in rows], label, prior)
        yield pa.RecordBatch.from_arrays([pa.array([pack(model)], pa.binary())], ["model"])

    got = mapped(sample.repartition(1), run, "model binary", "toxicity").collect()
    return bytes(got[0].model) if got else b""


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score of every row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS floats

    def run(batches):
        m = unpack(sent.value)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            if m is None:
                s = np.zeros(len(texts))
            else:
                s = 1 / (1 + np.exp(-np.clip(m["a"] * worst_passages(texts, m) + m["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, score double", "toxicity")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 5 is 0), score, predicted.  Held-out labels are never read."""
    held = crc_mod("doc_id", 5)
    model = learn(docs, labels.where(f"{held} <> 0"), max_rows)
    return score(docs, model).selectExpr("doc_id", f"coalesce({held} = 0, false) held_out", "score", "cast(score >= 0.5 as int) predicted")
