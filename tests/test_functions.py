import pytest
from pyspark.sql import functions as F

from pagequarry.config import ChunkConfig, EngineConfig, RetrieveConfig, current, index_folder, overridden
from pagequarry.functions import text as T
from pagequarry.operators import chunking, rerank


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return df.select(expr.alias("x")).first().x


def test_tokens_match_ascii_runs_of_lowered_text(spark):
    assert one(spark, T.tokens("t"), t="Café K İstanbul ß STRASSE") == ["caf", "k", "i", "stanbul", "strasse"]


def test_words_split_at_unicode_white_space(spark):
    s = " a b　c\u0085d\x1ce\x1ff​g \n"
    assert one(spark, T.words("t"), t=s) == s.split()
    assert one(spark, T.strip_ws("t"), t="\x1c  x y 　") == "x y"


@pytest.mark.parametrize(
    "query, keywords, merged",
    [
        ("The cat and the hat", "cat hat", "the cat and hat"),
        ("new york new york", "new york new york", "new york new york"),
        ("To be or not", "to be or not", "to be or not"),
        ("???", "???", "???"),
    ],
)
def test_query_versions(spark, query, keywords, merged):
    assert one(spark, T.keyword_query("q"), q=query) == keywords
    assert one(spark, T.merged_query("q", "k"), q=query, k=keywords) == merged


def test_stopwords():
    assert len(set(T.STOPWORDS)) == 74 and "he" not in T.STOPWORDS


def test_page_id(spark):
    assert one(spark, T.page_id("p"), p=" 7 ") == 7
    with pytest.raises(Exception, match="not a page id"):
        one(spark, T.page_id("p"), p="-5")
    assert one(spark, T.page_id("p", strict=False), p="-5") is None
    assert one(spark, T.entry_text("t", "c"), t=" A", c="b \n") == "A\n\nb"


@pytest.mark.parametrize(
    "text, size, overlap, want",
    [
        ("a b c d e f g", 4, 1, ["a b c d", "d e f g"]),
        ("a b c d e f g h", 4, 1, ["a b c d", "d e f g", "g h"]),
        ("a b c d e f", 4, 9, ["a b c d", "b c d e", "c d e f"]),
        ("", 4, 1, [""]),
        ("a b", 0, 1, ["a b"]),
    ],
)
def test_word_windows(spark, text, size, overlap, want):
    assert one(spark, chunking.word_windows("t", size, overlap), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("a b\n\nc d\n\ne f g", ["a b\n\nc d", "d e f g"]),
        ("a b c d e f g", ["a b c d", "d d e f g"]),
        ("", [""]),
        ("\n\n  \n\n", [""]),
        ("a b\r\n\r\nc d", ["a b\r\n\r\nc d"]),
    ],
)
def test_paragraphs(spark, text, want):
    assert one(spark, chunking.paragraph_chunks("t", 4, 1), t=text) == want


def plain_paragraphs(text, size, overlap, delimiter):
    def windows(w):
        step, out, s = max(1, size - min(overlap, size - 1)), [], 0
        while True:
            out.append(" ".join(w[s : s + size]))
            if s + size >= len(w):
                return out
            s += step

    packed, group = [], []
    for p in filter(None, (x.strip() for x in text.split(delimiter))):
        if len(p.split()) > size or sum(len(g.split()) for g in group) + len(p.split()) > size:
            if group:
                packed.append("\n\n".join(group))
            group = []
        if len(p.split()) > size:
            packed += windows(p.split())
        else:
            group.append(p)
    packed = packed + (["\n\n".join(group)] if group else []) or [""]
    return packed[:1] + [" ".join(a.split()[-overlap:]) + " " + b for a, b in zip(packed, packed[1:], strict=False)]


def test_paragraphs_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in docs.select("text", chunking.paragraph_chunks("text", 60, 15, "\n").alias("c")).collect():
        assert r.c == plain_paragraphs(r.text, 60, 15, "\n")


def test_entry_chunks(spark):
    rows = [(1, " T ", "a b"), (2, "", ""), (3, None, "x"), (4, "T", None)]
    df = spark.createDataFrame(rows, "page_id long, title string, content string")
    got = sorted((r.page_id, r.chunk_id, r.text) for r in chunking.chunk_entries(df, ChunkConfig()).collect())
    t = "Title: T\nContent: "
    assert got == [(1, -1, t + "T"), (1, 0, t + "a b"), (2, 0, ""), (3, 0, "Title: \nContent: x"), (4, -1, t + "T"), (4, 0, t)]


def plain_snippet(content, asked, window, step):
    w = content.split()
    if len(w) <= window:
        return " ".join(w)
    best = max(range(0, len(w) - window + 1, step), key=lambda i: (sum(x in asked for x in w[i : i + window]), -i))
    return " ".join(w[best : best + window])


def test_snippet(spark):
    long = " ".join(f"w{i % 9}" if i % 7 else "cat" for i in range(400)) + " cat, dog dog"
    for text, q in ((long, "dog w3"), (long, "CAT"), ("one  two", "two"), (" ".join(["x"] * 125), "x"), (long, "nothing")):
        got = one(spark, rerank.snippet("c", "q", 120, 20), c=text, q=q)
        assert got == plain_snippet(text.lower(), set(q.lower().split()), 120, 20)


def test_settings(tmp_path, monkeypatch):
    cfg = EngineConfig().patched({"bm25.k1": 2.0, "seed": 5})
    assert cfg.flat()["bm25.k1"] == 2.0 and cfg.seed == 5 and cfg.flat()["chunking.mode"] == "paragraph"
    with pytest.raises(KeyError):
        cfg.patched({"bm25.k9": 1})
    cfg.save(f"{tmp_path}/s.json")
    assert EngineConfig.load(f"{tmp_path}/s.json") == cfg
    with overridden(rrf_k=7) as inner:
        assert current() is inner and inner.retrieve.rrf_k == 7
    assert current() == EngineConfig()
    assert cfg.for_index() == cfg.with_retrieve(rrf_k=1).for_index()
    monkeypatch.setenv("ARTIFACTS_DIR", "/x")
    assert index_folder() == "/x" and index_folder("/y") == "/y"
    with pytest.raises(ValueError):
        RetrieveConfig(page_aggregation="typo")
    with pytest.raises(ValueError):
        ChunkConfig(mode="typo")
    assert EngineConfig.from_dict({"bm25": {"k1": 2.0}}).with_retrieve(rrf_k=5).retrieve.rrf_k == 5
