"""PII, LM scoring and decontamination against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from pagequarry.llm import decontamination, lm_scoring, pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def brute_pii(text):
    spans = [(m.start(), list(BASE).index(k), m.end(), k) for k, p in BASE.items() for m in p.finditer(text or "") if good(k, m.group())]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


PII = [
    "mail bob.x@mail6.example.com_a@b.co, card 4587121519400672 or 4587 1215 1940 0672!",
    "Call +1 (255) 555-8013 or +44 20 7946 0958x, tel (255) 555-8013, ref 2024-10-11",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 000255.0.0.01 1.2.3 999999999999999999999.1.1.1",
    "ü𝄞 a@b.c ü ann (at) site dot org; contact me at: joe [at] host [dot] com",
    "a@b a@b. @b.c a@.c " + "x" * 3000 + " " + "1" * 3000 + " " + "1 2-3 " * 400,
    "+1 1 +12345678901 +123456789012345678 ++1234567890 +1-2-3-4-5-6-7-8-9-0.",
    "a@b.c@d.e%f@g.h a@b.c-d@e.f", None, "", "no one here", "+()+5((((((((((5",
    "a@" + "b." * 3000 + "c", "4111111111111111 4111111111111112 0000000000000000",
]


def test_pii(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "1", "+", " ", "-", ".", "255", "4111111111111111", "x", "@", "(", "5 5", "٣", "é", "+1 222 333 4444", "\n"]
    texts = PII + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string, spans int")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = brute_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[3] == k for x in base) for k in BASE]
        assert set(filter(None, joined(base).split(","))) <= set(got[i].spans.split(","))
    assert "phone:" in got[1].spans and len(got[1].spans.split(",")) > len(brute_pii(PII[1]))
    assert "email:" in got[3].spans


def test_redact(spark):
    rows = [(1, "to a@b.c, +1 (255) 555-8013 ü", "k"), (2, None, "k"), (3, "none", None)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string, base string")).collect()}
    assert got == {1: "to [EMAIL], [PHONE] ü", 2: None, 3: "none"}


def test_estimate_trusts_better_labelers():
    rows = [("phone", (1, 1, 0, 1), True, 50), ("phone", (1, 0, 1, 1), False, 20), ("phone", (-1, -1, 0, -1), False, 60), ("phone", (0, -1, -1, -1), False, 30)]
    w, b = pii.estimate(rows)["phone"]
    odds = [b + sum(x * y for x, y in zip(w, v, strict=True)) for _, v, _, _ in rows]
    assert odds[1] > 0 > odds[2] and odds[3] < 0


def brute_lm(rows):
    texts = [bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split() for _, t in rows]
    one, two = {}, {}
    for i, ws in enumerate(texts):
        for j, w in enumerate(ws):
            one.setdefault(w, []).append(i)
            if j:
                two.setdefault((ws[j - 1], w), []).append(i)
    n = sum(map(len, texts))
    out = []
    for i, ws in enumerate(texts):
        rest, s = n - len(ws), 0.0
        c = lambda t, k: len(t.get(k, ())) - t.get(k, []).count(i)
        for j, w in enumerate(ws):
            if j and c(two, (ws[j - 1], w)):
                s += math.log(c(two, (ws[j - 1], w)) / c(one, ws[j - 1]))
            elif j:
                s += math.log(0.4 * max(c(one, w), 1) / max(rest, 1))
            else:
                s += math.log(max(c(one, w), 0.4) / max(rest, 1))
        out.append((rows[i][0], len(ws), s))
    return out


@pytest.mark.parametrize("block", [16_000_000, 4000])
def test_lm(docs, corpus, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    got = {r.doc_id: (r.n_words, r.score) for r in lm_scoring.backoff_scores(docs).collect()}
    for i, n, s in brute_lm(corpus):
        assert got[i][0] == n and got[i][1] == pytest.approx(s, abs=1e-6)


def brute_backoff(rows, order):
    texts = [tuple(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()) for _, t in rows]
    seen = {}
    for i, ws in enumerate(texts):
        for k in range(1, order + 1):
            for j in range(len(ws) - k + 1):
                by = seen.setdefault(ws[j : j + k], {})
                by[i] = by.get(i, 0) + 1
    total = {g: sum(by.values()) for g, by in seen.items()}
    n = sum(map(len, texts))

    def s(i, context, w):
        c = lambda g: total[g] - seen[g].get(i, 0)
        if not context:
            return max(c((w,)), 1) / max(n - len(texts[i]), 1)
        if c((*context, w)):
            return c((*context, w)) / c(context)
        return 0.4 * s(i, context[1:], w)

    for i, ws in enumerate(texts):
        first = [max(total[ws[:1]] - seen[ws[:1]][i], 0.4) / max(n - len(ws), 1)] if ws else []
        yield rows[i][0], len(ws), sum(math.log(x) for x in first + [s(i, ws[max(0, j - order + 1) : j], ws[j]) for j in range(1, len(ws))])


@pytest.mark.parametrize("block", [16_000_000, 4000])
def test_registered_lm_has_trigrams(spark, docs, corpus, monkeypatch, tmp_path, block):
    from pagequarry.llm import registry

    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.score) for r in registry.op3_lm_scoring(spark, str(tmp_path)).collect()}
    want = list(brute_backoff(corpus, 3))
    assert len(got) == len(want)
    for i, n, s in want:
        assert got[i][0] == n and got[i][1] == pytest.approx(s, abs=1e-6)


def test_lm_in_many_ranges(docs, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", 3000)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 4000)
    got = {r.doc_id: r.score for r in lm_scoring.backoff_scores(docs, 3).collect()}
    for i, _, s in brute_backoff(corpus, 3):
        assert got[i] == pytest.approx(s, abs=1e-6)


def test_lm_notices_another_block():
    texts = [b"a b c d e", b"a b c"]
    every = [e for _, e in lm_scoring.ngrams(texts, 2)]
    h, n = np.unique(np.concatenate([lm_scoring.present(e) for e in every]), return_counts=True)
    assert len(lm_scoring.scores(texts, n, 8, 2, lm_scoring.checksum(h))) == 2
    with pytest.raises(RuntimeError):
        lm_scoring.scores([b"a b c d x", b"a b c"], n, 8, 2, lm_scoring.checksum(h))


def test_pack():
    rng = np.random.default_rng(1)
    for h in (np.sort(rng.integers(0, 2**63, 5000, dtype=np.uint64)), np.array([7], dtype=np.uint64), np.array([0, 2**63], dtype=np.uint64), np.arange(9, dtype=np.uint64)):
        assert (lm_scoring.unpack(lm_scoring.pack(h)) == h).all()
        assert (lm_scoring.counts(lm_scoring.small(h)) == h.astype(np.int64)).all()


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        i, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[i] = f"new{rng.randrange(99)}"
        elif kind == 1:
            del words[i]
        else:
            words.insert(i, f"add{rng.randrange(99)}")
    return words


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [(k, [word() for _ in range(m)]) for k, m in enumerate([38, 25, 50, 12, 9, 6, 3])]
    rows, want, total = [], set(), 0
    for i in range(300):
        body = [word() for _ in range(rng.randrange(0, 80))]
        k, ws = items[i % len(items)]
        d = decontamination.allowed(len(ws))
        if i % 3:
            at = rng.randrange(len(body) + 1)
            body[at:at] = edit(rng, ws, rng.randrange(0, d + 1))
            want.add((i, k))
            total += 1
        rows.append((i, " ".join(body).title()))
    rows += [(900, None), (901, ""), (902, "...")]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(50, None), (51, "!!"), (None, "x y")], "item_id bigint, text string")
    docs = spark.createDataFrame([(*r, "h") for r in rows], "doc_id bigint, text string, hits string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminations(docs, bench).collect()}
    assert len(want & set(got)) >= 0.97 * total
    for (i, k), r in got.items():  # every hit is a true one
        words = dict(rows)[i].lower().split()[r.start_word : r.end_word]
        dist = decontamination.best_run(np.array([hash(w) for w in dict(items)[k]]), np.array([hash(w) for w in words]))[0]
        assert dist == r.distance <= decontamination.allowed(len(dict(items)[k]))
    exact = [x for x in want if got.get(x) and got[x].distance == 0]
    assert len(exact) > 30
    assert decontamination.contaminations(docs.where("false"), bench).collect() == []


@pytest.mark.parametrize("m", [8, 17, 21, 38, 44, 52, 53, 100])
def test_decontamination_at_the_limit(m):
    """Texts that hold an item with exactly the allowed number of edits."""
    rng = random.Random(m)
    trials, made = (400, 10**6) if m < 100 else (200, 10**6)
    items = [[f"w{rng.randrange(made)}" for _ in range(m)] for _ in range(trials)]
    pad = lambda: [f"b{rng.randrange(made)}" for _ in range(15)]
    texts = [" ".join(pad() + edit(rng, ws, decontamination.allowed(m)) + pad()).encode() for ws in items]
    hits = decontamination.Items([(k, " ".join(ws)) for k, ws in enumerate(items)]).hits(texts)
    assert sum(any(h[0] == k for h in own) for k, own in enumerate(hits)) >= 0.97 * trials


def test_decontamination_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PART_CHARS", 40)
    items = [(k, " ".join(f"w{k}{j}" for j in range(12))) for k in range(6)]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in items], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.contaminations(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(k, k, 0) for k, _ in items}
