"""Substring, MinHash and embedding dedup against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from pagequarry.llm import embedding_dedup as emb
from pagequarry.llm import minhash, substring_dedup
from pagequarry.llm.components import connected_components
from pagequarry.llm.fm_index import FMIndex, matching_statistics


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 301), (301, 300), (7, 7)]
    want = components({x for e in links for x in e}, links)
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {n: c for n, c in want.items() if n != c}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_matching_statistics():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 500)
    text[::41] = 0
    length, _ = matching_statistics(FMIndex(text, 8), text, np.arange(1, 501), 6)
    seq = text.tolist()

    def brute(end):
        best = 0
        for j in range(1, 7):
            if end - j < 0 or seq[end - j] == 0:
                break
            if sum(seq[i : i + j] == seq[end - j : end] for i in range(len(seq) - j + 1)) < 2:
                break
            best = j
        return best

    assert [brute(e) for e in range(1, 501)] == length.tolist()


def brute_substrings(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [512, 2])
def test_substring(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_substrings(corpus)
    assert sum(x[1] for x in got.values()) > 1000


def test_substring_repeated_rows_and_null_ids(spark, corpus):
    rows = [(1, corpus[5][1] * 2), (1, corpus[5][1] * 2), (None, corpus[5][1] * 2), (2, "short")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    by = sorted((r.doc_id or 0, r.n_removed) for r in got)
    assert len(got) == 4 and by[0] == (0, 0) and by[1] == by[2]


def test_empty(empty):
    assert substring_dedup.substring_dedup(empty).collect() == []
    assert minhash.minhash_dedup(empty).collect() == []


def shingles(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_minhash(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("long", [64, 3])
def test_minhash(docs, corpus, monkeypatch, long):
    monkeypatch.setattr(minhash, "LONG", long)
    monkeypatch.setattr(minhash, "MINOR", 3)
    monkeypatch.setattr(minhash, "MEMBER", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_dedup(docs, 85).collect()}
    want = brute_minhash(corpus, 85)
    assert {k: (got[k], want[k]) for k in want if got.get(k) != want[k]} == {}


def test_minhash_null_ids(spark, corpus):
    rows = [(None, corpus[5][1]), (4, corpus[5][1]), (3, corpus[5][1]), (3, corpus[5][1])]
    got = minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 3), (3, 3), (4, 3)]


def test_match_threshold():
    rng = np.random.default_rng(2)
    t = minhash.match_threshold(85)
    for _ in range(30):
        x = rng.integers(0, 2**63, 200, dtype=np.uint64)
        y = x.copy()
        y[:15] = rng.integers(0, 2**63, 15, dtype=np.uint64)  # 185 / 215 = 0.86
        a, b = minhash.signatures([np.unique(x), np.unique(y)])
        assert (a == b).sum() >= t


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(emb, "BLOCK_BYTES", 64 * 16 * 4)
    monkeypatch.setattr(emb, "LEAF", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.5])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(6)] + [(450, None), (451, []), (452, [0.0] * 16), (453, [None, *rows[0][1][1:]]), (454, [float("nan"), *rows[0][1][1:]]), (455, [float("inf")] * 16), (456, rows[0][1][:8]), (457, rows[0][1][:8])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)

    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = {i: np.array(v, dtype=np.float64) for i, v in rows if good(v)}
    links = []
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.95:
                links.append((a, b))
    comp = components([i for i, _ in rows], links)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in emb.embedding_dedup(vectors).collect()}
    assert got == {i: (n[i], comp[i], comp[i] == i) for i, _ in rows}
    assert len(links) > 1000
    assert emb.embedding_dedup(vectors.where("false")).collect() == []
