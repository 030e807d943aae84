"""Text primitives as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The words that keyword queries leave out.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as",
    "is", "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those", "it", "its",
    "they", "them", "their", "what", "which", "who", "whom", "when", "where", "why", "how", "not", "no", "nor",
    "so", "if", "then", "than", "too", "very", "just", "about", "into", "over", "after", "before", "between",
    "under", "again", "further", "once",
)

#: Unicode white space, and the four separators that Java's \s leaves out.
BLANK = r"(?U)[\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once: inside lambdas an expression would be computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def words(c: Column | str) -> Column:
    """Pieces between Unicode white space, none empty."""
    return F.filter(F.split(_col(c), BLANK), lambda x: x != "")


def strip_ws(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def wrapped(title: Column | str, content: Column | str) -> Column:
    """The indexed form of a page or chunk."""
    return F.concat(F.lit("Title: "), _col(title), F.lit("\nContent: "), _col(content))


def keyword_query(query: Column | str) -> Column:
    """Tokens that are no stopwords, repeats kept; if none is left, the stripped lower-cased query."""
    kept = F.filter(tokens(query), lambda t: ~t.isin(*STOPWORDS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(strip_ws(F.lower(_col(query))))


def merged_query(query: Column | str, keywords: Column | str) -> Column:
    """The query itself if it equals its keywords, else the distinct tokens of both in first-seen order."""
    q, k = _col(query), _col(keywords)
    both = F.array_distinct(F.concat(tokens(q), tokens(k)))
    return F.when((q == k) | (F.size(both) == 0), q).otherwise(F.array_join(both, " "))


def entry_text(title: Column | str, content: Column | str) -> Column:
    """Title, an empty line and the content, stripped."""
    return strip_ws(F.concat(_col(title), F.lit("\n\n"), _col(content)))


def page_id(c: Column | str, strict: bool = True) -> Column:
    """Digits, blanks around them allowed, as a long; anything else raises when evaluated, or is null if not ``strict``."""
    s = strip_ws(_col(c).cast("string"))
    bad = F.raise_error(F.concat(F.lit("not a page id: "), F.coalesce(s, F.lit("null")))).cast("long") if strict else F.lit(None).cast("long")
    return F.when(s.rlike("^[0-9]+$"), s.cast("long")).otherwise(bad)


def bounded_batches(spark: SparkSession, rows: int = 2_000, size: int = 4_000_000) -> None:
    """Bounds the Arrow batches that go to Python workers; what the session sets itself stands."""
    for key, default, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", None, size)):
        if spark.sparkContext.getConf().get(key) is None and (default is None or spark.conf.get(key, default) == default):
            spark.conf.set(key, str(bound))
