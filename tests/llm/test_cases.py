"""Odd tables for every operator, and plain versions of what learns or samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import common, decontamination, embedding_dedup, language_id, lm_scoring, minhash, pii, sentencepieces, substring_dedup, toxicity
from pagequarry.llm.registry import tokenizer
from pagequarry.llm.token_counts import token_counts

from .conftest import prose

COUNTS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
LABELS = [(i, 1, i % 2) for i in range(0, 60)]
ITEMS = [(1, "quick brown foxes jump over the lazy dogs of the town today"), (2, None), (3, "")]


def operators(spark):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    return {
        "substring": substring_dedup.substring_dedup,
        "pii": pii.find_pii,
        "redact": pii.redact,
        "lm": lambda d: lm_scoring.backoff_scores(d, 3),
        "language": language_id.language_id,
        "contamination": lambda d: decontamination.mark_contaminated(d, items),
        "tokens": lambda d: token_counts(d, tokenizer(COUNTS)),
        "pieces": lambda d: sentencepieces.sentencepiece_encode(d, tokenizer(PIECES)),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "minhash": minhash.minhash_dedup,
    }


CLASHING = "doc_id bigint, text string, lang string, n_removed int, n_words int, keep int, hits string, n_tokens string, score string, component_id string, n int, k1 string, cid string, kept string, spans string, ids string, th string, held_out string"
NAMES = ["substring", "pii", "redact", "lm", "language", "contamination", "tokens", "pieces", "toxicity", "minhash"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeated rows, a long text, a name for each new column."""
    rng = random.Random(1)
    long = " ".join(prose(rng, 400) for _ in range(100))
    texts = [(0, long), (0, long), (1, None), (2, ""), (None, "no id here at all"), (None, None), (3, "same text"), (3, "same text"), (3, "another text"), (4, "x" * 100_000)] + [(i, prose(rng, 20)) for i in range(5, 30)]
    rest = len(CLASHING.split(",")) - 3
    rows = [(i, t, None if k % 3 == 0 else "en", *[None] * rest) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, odd, name):
    run = operators(spark)[name]
    assert run(odd).count() == odd.count()
    assert run(odd.where("false")).collect() == []


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "a", 1), (1, [1.0, 0.0], "a", 1), (None, [1.0, 0.0], None, None), (2, [0.0, 1.0], "b", 2), (3, None, "c", 3), (4, [-0.0, 1.0], "d", 4), (5, [2.0], "e", 5)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component_id string, n_links int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 2), (3, 0, 3), (4, 1, 2), (5, 0, 5)]


def test_empty_benchmark(spark, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.mark_contaminated(odd, none).where("size(hits) > 0").count() == 0


def plain_distance(item, text):
    """Edits between the item and the nearest run of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_against_plain_distances(spark):
    """Repeated common words, texts cut short at their ends, items of all sizes."""
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "a", "in"]) if rng.random() < 0.3 else f"w{rng.randrange(60)}"
    items = [(k, [word() for _ in range(m)]) for k, m in enumerate([1, 3, 7, 8, 10, 15, 22, 30, 41, 60])]
    rows = []
    for i in range(250):
        body = [word() for _ in range(rng.randrange(0, 60))]
        if i % 2:
            ws = list(items[rng.randrange(len(items))][1])
            for _ in range(rng.randrange(0, len(ws) // 5 + 2)):
                at = rng.randrange(len(ws))
                ws[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
                ws = ws or ["the"]
            body[(at := rng.randrange(len(body) + 1)) : at] = ws
        rows.append((i, " ".join(body)))
    want = {(i, k): d for i, t in rows for k, ws in items if (d := plain_distance(ws, t.split())) <= (len(ws) // 5 if len(ws) >= 8 else 0)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminations(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")).collect()}
    assert set(got) <= set(want) and all(got[x] == want[x] for x in got)
    assert len(got) >= 0.97 * len(want) and len(want) > 100


def plain_profile(text):
    """Letter by letter, a gap for every run of anything else."""
    out, seq, gap = np.zeros(language_id.DIMS), ["\0"], True
    for c in text.lower():
        if c.isalpha():
            seq.append(c)
        elif seq[-1] != "\0":
            seq.append("\0")
    if seq[-1] != "\0":
        seq.append("\0")
    vec = {c: 1 - 2 * language_id.letter_bits(np.array([ord(c)]))[0].astype(int) for c in set(seq)}
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        out += np.roll(vec[a], 2) * np.roll(vec[b], 1) * vec[c]
    return out


def test_profiles_against_plain_ones():
    rng = random.Random(3)
    for text in [prose(rng, 30), "Ünï çödé 日本語 x", "a", "ab", "A-B  c", "İ"]:
        got, want = language_id.bundle(text), plain_profile(text)
        # bits stand for -1 and 1; three bound bits are the product up to its sign
        assert np.array_equal(got, -want) or np.array_equal(got, want)
    assert language_id.bundle("12 ?") is None and language_id.bundle("") is None
    a, b = (language_id.bundle(x) for x in ("γάτα και σκύλος", "собака и кошка"))
    assert abs(a @ b) < 0.35 * np.linalg.norm(a) * np.linalg.norm(b)  # letters of other alphabets don't fall together


def test_planted_pii(spark):
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    planted = [
        lambda: ("email", "mail ", f"ann{rng.randrange(99)} (at) site dot org"), lambda: ("email", "contact ", f"joe{rng.randrange(99)} [at] host [dot] com"), lambda: ("email", "write to ", f"kim{rng.randrange(99)} at example.com"),
        lambda: ("phone", "call ", f"(255) 555-{rng.randrange(1000, 9999)}"), lambda: ("phone", "tel ", f"255-555-{rng.randrange(1000, 9999)}"),
        lambda: ("secret", 'token = "', hexes(40)), lambda: ("secret", "password: ", f"hunter{rng.randrange(100, 999)}xQz{rng.randrange(10, 99)}!"), lambda: ("secret", "api_key=", "sk-" + hexes(32)),
        lambda: ("iban", "iban ", "DE89370400440532013000"), lambda: ("iban", "account ", "GB82 WEST 1234 5698 7654 32"),
        lambda: ("name", "dear ", f"{rng.choice(['Mary', 'Hans', 'José'])} {rng.choice(['Smith', 'Weber', 'Pérez'])}"), lambda: ("name", "contact ", "Dr. Keller"),
        lambda: ("address", "lives at ", f"{rng.randrange(1, 300)} Baker Street"), lambda: ("address", "wohnt ", f"Hauptstraße {rng.randrange(1, 99)}"), lambda: ("address", "", f"{rng.randrange(1, 99)} rue de Rivoli"),
        lambda: ("ip", "host ", "10[.]0[.]0[.]7"), lambda: ("card", "card ", "4111.1111.1111.1111"),
    ]
    noise = ["of at and. The", "2024-10-11", "order 1234 5678 9012", "look at this. Then", "version 10.2.3", "well-known-long-hyphenated-compound-word-chain", "page 12 34 56", "A. The", "DE12 ABCD EFGH IJKL"]
    rows, want = [], set()
    for i in range(400):
        parts = [prose(rng, rng.randrange(3, 20)).lower(), rng.choice(noise)]
        if i % 2:
            kind, cue, span = planted[i // 2 % len(planted)]()
            parts.append(cue + span)
            s = len(" ".join(parts)) - len(span)
            want.add((i, kind, s, s + len(span)))
        parts.append("; " + prose(rng, 5).lower())
        rows.append((i, " ".join(parts)))
    got = set()
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        for x in filter(None, r.spans.split(",")):
            kind, s, e = x.split(":")
            got.add((r.doc_id, kind, int(s), int(e)))
        assert r.n_spans == len(list(filter(None, r.spans.split(","))))
    meets = lambda a, b: a[:2] == b[:2] and a[2] < b[3] and b[2] < a[3]
    found = sum(any(meets(w, g) for g in got) for w in want)
    right = sum(any(meets(w, g) for w in want) for g in got)
    assert found >= 0.9 * len(want), sorted(w for w in want if not any(meets(w, g) for g in got))[:20]
    assert right >= 0.9 * len(got), sorted(g for g in got if not any(meets(w, g) for w in want))[:20]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{i}@b.co" for i in range(3000))
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert got.n_email == 3000
    assert pii.redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().text == " ".join(["[EMAIL]"] * 3000)


def test_split_join(spark, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", 3)
    monkeypatch.setattr(common, "HEAVY", 2)
    left = spark.range(200).selectExpr("id", "case when id < 120 then 7 when id < 150 then 8 else id end k")
    right = left.groupBy("k").agg(F.count("*").alias("d"), F.max("id").alias("top")).where("k <> 199")
    got = sorted(tuple(r) for r in common.split_join(left, right, "k", "d").select("id", "k", "top").collect())
    assert got == [(i, k, t) for i in range(199) for k, t in [(7, 119) if i < 120 else (8, 149) if i < 150 else (i, i)]]


def test_keep_one_decides_by_row(spark):
    a, b = "one two three four five six seven", "eins zwei drei vier fünf sechs sieben"
    rows = [(1, a), (1, a), (2, b), (2, a), (None, a), (4, None), (4, None), (5, "x y"), (5, "x y"), (6, "x y")]
    got = minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), 80).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a), (2, b), (None, a), (4, None), (4, None), (5, "x y")]))


def test_links_just_above_the_similarity():
    """Pairs of real texts at 85 to 87 % agree in enough coordinates."""
    import pyarrow.parquet as pq

    rng = random.Random(2)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t and len(t.split()) > 150][:400]
    t, tried, short = minhash.match_threshold(85), 0, 0
    for text in texts:
        words = text.encode().split()
        edited = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * 0.0155))):
            edited[at] = b"new%d" % rng.randrange(10**6)
        x, y = minhash.shingle_sets([b" ".join(words), b" ".join(edited)])
        both = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        if 0.85 <= both < 0.88:
            p, q = minhash.signatures([x, y])
            tried, short = tried + 1, short + ((p == q).sum() < t)
    assert tried > 50 and short == 0


def message(*parts):
    """Protobuf fields (number, value): bytes, ints or floats."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for k, v in parts:
        if isinstance(v, bytes):
            out += varint(k << 3 | 2) + varint(len(v)) + v
        elif isinstance(v, float):
            out += varint(k << 3 | 5) + struct.pack("<f", v)
        else:
            out += varint(k << 3) + varint(v)
    return out


@pytest.mark.parametrize("trim, nfkc", [(1, False), (0, False), (1, True)])
def test_unigram_model(spark, tmp_path, trim, nfkc):
    """A hand-made model: scores, trimming, a character map."""
    import sentencepiece

    charsmap = b""
    if nfkc:
        made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
        charsmap = dict(sentencepieces.fields(made.serialized_model_proto()))
        charsmap = dict(sentencepieces.fields(charsmap[3]))[2]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [("▁", -2.0, 1), ("▁the", -1.0, 1), ("▁cat", -1.5, 1), ("s", -2.5, 1), ("ca", -3.1, 1), ("t", -3.3, 1), ("he", -3.7, 1)] + [(c, -5.0 - i / 10, 1) for i, c in enumerate("abcdefghiklmnopqruvwxyz1")]
    spec = message(*[(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces], (2, message((3, 1), (40, 0))), (3, message((1, b"own"), (2, charsmap), (3, 1), (4, trim), (5, 1))))
    path = tmp_path / "own.model"
    path.write_bytes(spec)
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the cats", "  the  cat ", "thecat theca t", "", "zebra", "ﬁx ①" if nfkc else "fix 1", " ", "the\u3000cat" if nfkc else "the cat"]
    rows = sentencepieces.sentencepiece_encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), str(path)).collect()
    for r in rows:
        assert r.ids == lib.encode(r.text), (r.text, r.ids, lib.encode(r.text))
        assert r.parity
