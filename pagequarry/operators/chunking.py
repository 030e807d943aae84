"""Chunking: word windows, paragraph packing with overlap, and the entry-to-chunks expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.config import ChunkConfig
from pagequarry.functions.text import let, strip_ws, words, wrapped


def _windows(w: Column, size: int, overlap: int) -> Column:
    if size <= 0:
        return F.array(F.array_join(w, " "))
    return let(w, lambda x: _cut(x, size, overlap))


def _cut(w: Column, size: int, overlap: int) -> Column:
    step = max(1, size - max(0, min(overlap, size - 1)))
    n = F.size(w)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))


def word_windows(text: Column | str, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that share ``overlap``, the last one reaching the end; [""] for no words."""
    return _windows(words(text), size, overlap)


def paragraph_chunks(content: Column | str, size: int, overlap: int, delimiter: str = "\n\n") -> Column:
    """Paragraphs packed greedily up to ``size`` words, longer ones cut to windows; each chunk led by the last words of the one before."""
    c = F.col(content) if isinstance(content, str) else content
    paras = F.filter(F.transform(F.split(c, delimiter.replace("\n", "\\n")), strip_ws), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def state(done: Column, open_: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), n.alias("n"))

    def step(acc: Column, p: Column) -> Column:
        return let(F.size(words(p)), lambda n: pack(acc, p, n))

    def pack(acc: Column, p: Column, n: Column) -> Column:
        closed = F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n\n")))).otherwise(acc["done"])
        none = F.array().cast("array<string>")
        return (
            F.when(n > size, state(F.concat(closed, _windows(words(p), size, overlap)), none, F.lit(0)))
            .when((acc["n"] + n > size) & (F.size(acc["open"]) > 0), state(closed, F.array(p), n))
            .otherwise(state(acc["done"], F.concat(acc["open"], F.array(p)), acc["n"] + n))
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n\n")))).otherwise(acc["done"])

    packed = F.aggregate(paras, start, step, finish)
    out = let(packed, lambda p: F.when(F.size(p) == 0, F.array(F.lit(""))).otherwise(p))
    return overlapped(out, overlap)


def overlapped(chunks: Column, overlap: int) -> Column:
    """Each chunk but the first led by the last ``overlap`` words of the one before, as it was."""
    return chunks if overlap <= 0 else let(chunks, lambda c: _led(c, overlap))


def _led(chunks: Column, overlap: int) -> Column:
    def lead(c: Column, i: Column) -> Column:
        before = words(F.get(chunks, i - 1))
        tail = F.slice(before, F.greatest(F.size(before) - overlap + 1, F.lit(1)), overlap)
        return F.when((i == 0) | (F.size(before) == 0), c).otherwise(strip_ws(F.concat(F.array_join(tail, " "), F.lit(" "), c)))

    return F.transform(chunks, lead)


def body_chunks(content: Column | str, cfg: ChunkConfig) -> Column:
    if cfg.mode == "paragraph":
        return paragraph_chunks(content, cfg.max_chunk_words, cfg.overlap_words, cfg.delimiter)
    return word_windows(content, cfg.chunk_words, cfg.overlap_words)


def chunk_entries(entries: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(page_id, title, content) -> (page_id, chunk_id, text); -1 is the title chunk.  Nulls count as empty.

    Narrow: no exchange, so it also runs on streams.
    """
    title = strip_ws(F.coalesce("title", F.lit("")))
    content = F.coalesce("content", F.lit(""))
    e = entries.select("page_id", title.alias("title"), content.alias("content"))
    named = F.col("title") != ""
    chunk = lambda i, t: F.struct(i.cast("int").alias("chunk_id"), t.alias("text"))
    body = F.transform(body_chunks("content", cfg), lambda t, i: chunk(i, F.when(named | (t != ""), wrapped("title", t)).otherwise("")))
    head = F.when(named, F.array(chunk(F.lit(-1), wrapped("title", F.col("title"))))).otherwise(F.array().cast("array<struct<chunk_id:int,text:string>>"))
    rows = F.concat(head, body) if cfg.title_chunk else body
    return e.select("page_id", F.inline(rows))
