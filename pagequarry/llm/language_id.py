"""Language ID by hyperdimensional profiles.

Each letter (code point) has a random +-1 vector of its own, drawn from a hash of the code point.  A letter trigram is bound
as the product of its letters' vectors, rotated by two, one and no places; a text bundles (sums) its trigrams'
vectors; a language's prototype bundles the unit vectors of its texts.  A text takes the language of the prototype of
largest cosine.  Vectors are held as bits and bound by exclusive or, per text: no table of letters or trigrams is kept.

Letters are lower-cased; runs of anything else are one gap, which has a vector too.  Null text and texts without a letter
get ``und`` and score 0.  The score is that cosine, cut to 0..1; ties go to the language first in order.  Rows
whose ``lang`` is null teach nothing.  With nothing learned every text is ``und``; an empty table gives no rows.  Texts of
any length are bundled whole, part by part.  One row per row, repeated rows and null ids included.  Columns of the
input that are named as the new ones give way to them where columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import crc_mod, kept, mapped, mix, ship

DIMS, SEED = 512, 20240
UNIT = 100_000
#: Trigrams bound at a time, letters of a text cut at a time.
PART, SLICE = 2048, 1_000_000


def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    own = kept("language")
    if "letters" not in own:
        out = np.zeros(0x110000, dtype=bool)
        for lo in range(0, 0x110000, 4096):
            out[lo : lo + 4096] = [chr(c).isalpha() for c in range(lo, lo + 4096)]
        own["letters"] = out
    return own["letters"]


def letter_bits(points: np.ndarray) -> np.ndarray:
    """DIMS random bits of each code point (0 stands for a gap)."""
    key = points.astype(np.uint64)[:, None] * np.uint64(DIMS) + np.arange(DIMS // 64, dtype=np.uint64)[None, :]
    return np.unpackbits(mix(mix(key + np.uint64(SEED)) + np.uint64(SEED)).view(np.uint8).reshape(len(points), -1), axis=1)


def bundle(text: str | None) -> np.ndarray | None:
    """The text's bundled vector, None if it has no letter."""
    if not text:
        return None
    is_letter = letters()
    total, any_letter, tail = np.zeros(DIMS), False, np.zeros(1, dtype=np.uint32)
    for lo in range(0, len(text), SLICE):
        ids = np.frombuffer(text[lo : lo + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ids = np.where(is_letter[ids], ids, np.uint32(0))
        any_letter = any_letter or bool(ids.any())
        ids = np.concatenate([tail, ids, np.zeros(1 if lo + SLICE >= len(text) else 0, dtype=np.uint32)])
        ids = ids[np.concatenate([[True], (ids[1:] > 0) | (ids[:-1] > 0)])]
        if len(ids) >= 3:
            total += _trigrams(ids)
        tail = ids[-2:]
    return total if any_letter else None


def _trigrams(ids: np.ndarray) -> np.ndarray:
    points, sym = np.unique(ids, return_inverse=True)
    k = len(points)
    sym = sym.astype(np.int64)
    code, n = np.unique((sym[:-2] * k + sym[1:-1]) * k + sym[2:], return_counts=True)
    bits = letter_bits(points)
    two, one, none = (np.packbits(np.roll(bits, s, axis=1), axis=1) for s in (2, 1, 0))
    ones = np.zeros(DIMS)
    for lo in range(0, len(code), PART):
        c = code[lo : lo + PART]
        bound = np.unpackbits(two[c // (k * k)] ^ one[c // k % k] ^ none[c % k], axis=1)
        ones += n[lo : lo + PART].astype(np.float32) @ bound.astype(np.float32)
    return 2.0 * ones - n.sum()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Prototypes.  Each task bundles its rows; what reaches the driver is one vector per language."""
    ship(docs.sparkSession)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = bundle(text)
                if v is not None and (size := float(np.linalg.norm(v))):
                    if lang not in total:
                        total[lang] = np.zeros(DIMS, dtype=np.int64)
                    total[lang] += np.rint(v * (UNIT / size)).astype(np.int64)
        for lang, v in sorted(total.items()):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMS), pa.array(range(DIMS), pa.int32()), pa.array(v)], ["lang", "dim", "value"])

    src = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(f"`{text_col}`", f"`{lang_col}`")
    summed = mapped(src, run, "lang string, dim int, value bigint", "language").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    rows = summed.collect()  # languages x DIMS integers
    names = sorted({r.lang for r in rows})
    proto = np.zeros((len(names), DIMS))
    at = {x: i for i, x in enumerate(names)}
    for r in rows:
        proto[at[r.lang], r.dim] = r.value
    return names, proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-30)


def predict(docs: DataFrame, names: list[str], proto: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """lang_pred and score beside the id, or beside all columns of ``docs`` if ``keep``."""
    ship(docs.sparkSession)
    new = ["lang_pred", "score"]
    src = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in new]) if keep else docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    at = src.columns.index(text_col if keep else "text")
    shown = src.schema.fields if keep else src.schema.fields[:1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shown), "lang_pred string", "score double"])

    def run(batches):
        for b in batches:
            lang, score = [], []
            for text in b.column(at).to_pylist():
                v = bundle(text) if names else None
                size = float(np.linalg.norm(v)) if v is not None else 0.0
                if not size:
                    lang.append("und")
                    score.append(0.0)
                    continue
                cos = proto @ v / size
                best = int(np.argmax(cos))
                lang.append(names[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
            cols = b.columns if keep else b.columns[:1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[: len(cols)], *new])

    return mapped(src, run, schema, "language")


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2, and predicts all."""
    held = crc_mod("doc_id", 4)
    names, proto = learn(docs.where(f"not ({held} <=> 2)"))
    out = predict(docs, names, proto)
    return out.selectExpr("doc_id", f"coalesce({held} = 2, false) held_out", "lang_pred", "score")
