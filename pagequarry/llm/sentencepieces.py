"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (wire format, no generated code): pieces with scores and kinds,
model type, normaliser settings.  From it a ``tokenizers`` backend is rebuilt: the normaliser (precompiled character map,
trimming of blanks), the metaspace marker, merges ranked by piece score (BPE) or unigram scores, byte fallback.  Where no piece
holds a marker after another character - checked when loading - text falls into marker-led segments that
encode alone; otherwise a text is one segment.  Each distinct segment is encoded once while it stays in a cache bounded in
entries and bytes, in multithreaded batches, and compared with the ``sentencepiece`` library (``parity``; a text's is that of all its segments,
which is that of the whole text, as segments encode alone).

Null text counts as empty: no ids, decoded as "".  Texts of any length are encoded whole; an empty table gives no rows.
Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagequarry.llm.common import kept, mapped, ship

MARK = "▁"
#: Segments kept in each of two generations, none longer than CACHE_CHARS.
CACHE_SEGMENTS, CACHE_CHARS = 60_000, 48
#: Segments encoded at a time, and bytes of a block that a worker gives back at once.
LEARNT, LARGE = 8_000, 1_000_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i += 1
        out |= (c & 127) << shift
        if c < 128:
            return out, i
        shift += 7


def fields(b: bytes):
    """The (number, value) pairs of one protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 1:
            v, i = struct.unpack_from("<d", b, i)[0], i + 8
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            v, i = struct.unpack_from("<f", b, i)[0], i + 4
        yield key >> 3, v


NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def parse_model(raw: bytes) -> dict:
    """Pieces as (text, score, kind), and the settings that encoding needs, with their defaults."""
    out = {"pieces": [], "type": 1, "byte_fallback": False, "dummy_prefix": True, "trim": True, "escape": True, "charsmap": b"", "unk_id": 0}
    for k, v in fields(raw):
        if k == 1:
            p = dict(fields(v))
            out["pieces"].append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
        elif k == 2:
            t = dict(fields(v))
            out |= {"type": t.get(3, 1), "byte_fallback": bool(t.get(35, 0)), "unk_id": t.get(40, 0)}
        elif k == 3:
            n = dict(fields(v))
            out |= {"charsmap": n.get(2, b""), "dummy_prefix": bool(n.get(3, 1)), "trim": bool(n.get(4, 1)), "escape": bool(n.get(5, 1))}
    return out


class PieceCoder:
    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import re

        import sentencepiece
        from tokenizers import Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            raw = f.read()
        m = parse_model(raw)
        self.prefix, self.escape, self.trim = m["dummy_prefix"], m["escape"], m["trim"]
        self.charsmap = normalizers.Precompiled(m["charsmap"]) if m["charsmap"] else None
        pieces = m["pieces"]
        self.apart = self.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in pieces)
        ids = {p: i for i, (p, _, _) in enumerate(pieces)}
        unk = pieces[m["unk_id"]][0]
        if m["type"] == 1:
            model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=m["unk_id"], byte_fallback=m["byte_fallback"])
        else:
            usable = {p: s for p, s, k in pieces if k in (NORMAL, USER, UNUSED)}
            ranked = []
            for p, s in usable.items():
                ranked += [(-s, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
            ranked.sort()
            model = models.BPE(ids, [(a, b) for *_, a, b in ranked], unk_token=unk, fuse_unk=True, byte_fallback=m["byte_fallback"], cache_capacity=0)
        self.tok = Tokenizer(model)
        self.tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.segments = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
        #: By id: whether a piece begins with the marker, and the bytes it decodes to.
        self.leads = np.array([p.startswith(MARK) for p, _, _ in pieces])
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in pieces]
        #: Little-endian 32-bit ids of segments, and the segments that the library encodes otherwise.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.differ: set[str] = set()

    def cleaned(self, text: str) -> str:
        """The text after the model's character map and trimming."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        return " ".join(w for w in text.split(" ") if w) if self.trim else text

    def normal(self, text: str) -> str:
        """What the model sees: blanks as markers, one marker before a text that is not empty."""
        text = self.cleaned(text)
        mark = MARK if self.escape else " "
        return (mark * self.prefix + text.replace(" ", mark)) if text else ""

    def learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Encodes new segments.  Those with one leading marker are encoded many to a row, the markers telling them apart."""
        out: dict[str, bytes] = {}
        plain = [s for s in fresh if self.apart and self.prefix and s.count(MARK) == 1 and len(s) > 1 and s[0] == MARK]
        rows = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        joined = ["".join(r) for r in rows]
        # The library adds its own leading marker.
        theirs = self.sp.encode([j[1:] for j in joined], num_threads=1) if joined else []
        for r, e, their in zip(rows, self.tok.encode_batch_fast(joined, add_special_tokens=False), theirs, strict=True):
            ids = np.array(e.ids, dtype="<i4")
            at = np.flatnonzero(self.leads[ids]).tolist()
            if len(at) == len(r) and e.ids == their:
                at.append(len(ids))
                out.update((s, ids[at[i] : at[i + 1]].tobytes()) for i, s in enumerate(r))
        rest = [s for s in fresh if s not in out]
        for s, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            if self.theirs(s) != e.ids:
                self.differ.add(s)
            out[s] = np.array(e.ids, dtype="<i4").tobytes()
        return out

    def theirs(self, s: str) -> list[int]:
        """The library's ids of a segment.  It adds a marker before other text only, so a lone marker is judged behind a word."""
        mark = MARK if self.escape else " "
        if not self.prefix or s[0] != mark:
            return self.sp.encode(s)
        if len(s) > 1:
            return self.sp.encode(s[1:])
        word = self.sp.encode("a")
        both = self.sp.encode("a" + s)
        return both[len(word) :] if both[: len(word)] == word else [-1]

    def split(self, text: str) -> list[str]:
        if self.prefix and self.apart and text and MARK not in text and self.charsmap is None:
            words = text.split(" ")
            if "" not in words:
                return [MARK + w for w in words]
        text = self.normal(text)
        return self.segments.findall(text) if self.apart else [text] if text else []

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """Per text: ids, whether decoding gives the text back (as normalised), whether all segments agree with the library."""
        split = [self.split(t) for t in texts]
        if len(self.young) > CACHE_SEGMENTS:
            self.old, self.young = self.young, {}
            self.differ.clear()
        young, old = self.young, self.old
        fresh, once = [], []
        for s in set().union(*split):
            if s not in young:
                if (got := old.get(s)) is not None and s not in self.differ:
                    young[s] = got
                else:
                    fresh.append(s)
                    if len(s) > CACHE_CHARS:
                        once.append(s)
        if fresh:
            for i in range(0, len(fresh), LEARNT):
                young.update(self.learn(fresh[i : i + LEARNT]))
        out = []
        mark = MARK if self.escape else " "
        for t, segs in zip(texts, split, strict=True):
            ids = np.frombuffer(b"".join([young[s] for s in segs]), dtype="<i4").astype(np.int32)
            back = b"".join(map(self.bytes.__getitem__, ids.tolist()))
            want = self.cleaned(t).replace(mark, " ").encode()
            out.append((ids, back[1 if self.prefix and back else 0 :] == want, not self.differ or self.differ.isdisjoint(segs)))
        for s in once:
            del young[s]
            self.differ.discard(s)
        return out


def coder(path: str) -> PieceCoder:
    own = kept("pieces")
    if path not in own:
        own[path] = PieceCoder(path)
    return own[path]


def sentencepiece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its columns, then ids, n_tokens, ids_sha256, decodes, parity.

    ids_sha256 is over the ids as little-endian 32-bit integers.  Columns of ``docs`` that bear one of
    these names give way to the new ones.
    """
    ship(docs.sparkSession)
    own = "ids array<int>, n_tokens bigint, ids_sha256 string, decodes boolean, parity boolean"
    names = [x.split()[0] for x in own.split(", ")]
    src = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in names])
    at = src.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), own])

    def run(batches):
        c = coder(model_path)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                got = c.encode([t or "" for t in part.column(at).to_pylist()])
                n = [len(x[0]) for x in got]
                offsets = np.zeros(len(n) + 1, dtype=np.int32)
                np.cumsum(n, out=offsets[1:])
                values = np.concatenate([x[0] for x in got]) if got else np.zeros(0, dtype=np.int32)
                new = [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(x[0].astype("<i4").tobytes()).hexdigest() for x in got]),
                    pa.array([x[1] for x in got], pa.bool_()),
                    pa.array([x[2] for x in got], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    return mapped(src, run, schema, "pieces", LARGE)


def decode(ids: DataFrame, model_path: str) -> DataFrame:
    """Adds ``decoded`` (string) to rows that hold ``ids``; null ids decode to null."""
    ship(ids.sparkSession)
    at = ids.columns.index("ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema.fields), "decoded string"])

    def run(batches):
        c = coder(model_path)
        for b in batches:
            lists = b.column(at).to_pylist()
            text = c.tok.decode_batch([x or [] for x in lists], skip_special_tokens=False)
            text = [None if x is None else t[1 if c.prefix and t else 0 :] for x, t in zip(lists, text, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])

    return mapped(ids, run, schema, "pieces", LARGE)
