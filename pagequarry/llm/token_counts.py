"""Token counts by the whole-token shortcut.

Once per Python worker it is proved, by encoding each vocabulary string that closes a word, which
strings come out as exactly one token.  A pre-token in that set counts one; only the rest are merged
by the tokenizer, each distinct one once while it stays in a cache bounded in entries and in their length.

Null text counts as empty (0 bytes, 0 tokens); empty and blank texts have 0 tokens; any length is
handled whole; repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagequarry.llm.common import kept, mapped, ship

#: Pre-tokens kept, and the longest that are.
CACHE_WORDS, CACHE_CHARS = 200_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordCounter:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        suffix = spec["model"].get("end_of_word_suffix") or ""
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_strings = special
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # The file's \s is Unicode white space; \x1c-\x1f, which Python's \s adds, are not in it.
        space = r"\t-\r \x85\xa0  -     　"
# Texts within the alphabets proved here are split by the standard library's faster engine.
        kind = {c: unicodedata.category(c)[0] for c in map(chr, range(0x250))}
        for name in "LN":
            pattern = pattern.replace(f"[\\p{{{name}}}]", "[" + "".join(re.escape(c) for c in kind if kind[c] == name) + "]")
            pattern = pattern.replace(f"\\p{{{name}}}", "".join(re.escape(c) for c in kind if kind[c] == name))
        self.pieces = re.compile(pattern.replace(r"\s", space))
        self.blank = regex.compile(f"[{space}]+")
        self.odd = regex.compile(r"[^\x00-ɏ‐-‧]")
        back = byte_alphabet()
        vocab = spec["model"]["vocab"]
        strings = set()
        for piece in vocab:
            if suffix and piece.endswith(suffix):
                raw = bytes(back[c] for c in piece[: -len(suffix)] if c in back)
                try:
                    strings.add(raw.decode("utf-8"))
                except UnicodeDecodeError:
                    continue
        strings = sorted(s for s in strings if s and not self.odd.search(s) and self.pieces.fullmatch(s) and self.norm(s) == s)
        coded = self.tok.encode_batch(strings, add_special_tokens=False)
        self.whole = {s for s, e in zip(strings, coded, strict=True) if len(e.ids) == 1}
        #: By id: the token closes a pre-token.
        self.closes = np.zeros(self.tok.get_vocab_size() + 1, dtype=bool)
        self.closes[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        self.known: dict[str, int] = dict.fromkeys(self.whole, 1)
        self.words: dict[str, int] = {}

    def norm(self, s: str) -> str:
        return unicodedata.normalize("NFC", s).lower()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        pieces, extra = [], []
        for t in texts:
            n = 0
            if any(x in t for x in self.special_strings):
                t, n = self.special.subn(" ", t)
            if self.odd.search(t):  # words outside the alphabets proved here are counted by the tokenizer itself
                words = self.blank.split(t)
                odd = [w for w in words if self.odd.search(w)]
                n += sum(self.odd_counts(odd))
                t = " ".join(w for w in words if not self.odd.search(w))
            pieces.append(self.pieces.findall(self.norm(t)))
            extra.append(n)
        known = self.known
        fresh = {p for p in set().union(*pieces) if p not in known}
        if fresh and len(known) > CACHE_WORDS:
            known.clear()
            known.update(dict.fromkeys(self.whole, 1))
            fresh = {p for p in set().union(*pieces) if p not in known}
        if fresh:
            self.merge(list(fresh))
        out = [n + sum(map(known.__getitem__, ps)) for n, ps in zip(extra, pieces, strict=True)]
        for p in fresh:
            if len(p) > CACHE_CHARS:
                del known[p]
        return out

    def merge(self, fresh: list[str]) -> None:
        """Counts of pre-tokens that aren't whole tokens: blanks keep them apart, word ends tell them apart."""
        rows = [" ".join(fresh[i : i + 200]) for i in range(0, len(fresh), 200)]
        ids = [np.array(e.ids, dtype=np.int64) for e in self.tok.encode_batch_fast(rows, add_special_tokens=False)]
        ends = np.flatnonzero(self.closes[np.concatenate(ids)])
        if len(ends) == len(fresh):
            self.known.update(zip(fresh, np.diff(ends, prepend=-1).tolist(), strict=True))
        else:
            self.known.update((s, len(e.ids)) for s, e in zip(fresh, self.tok.encode_batch(fresh, add_special_tokens=False), strict=True))

    def odd_counts(self, words: list[str]) -> list[int]:
        fresh = [w for w in set(words) if w not in self.words]
        if fresh:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
                fresh = list(set(words))
            self.words.update((w, len(e.ids)) for w, e in zip(fresh, self.tok.encode_batch(fresh, add_special_tokens=False), strict=True))
        out = [self.words[w] for w in words]
        for w in fresh:
            if len(w) > CACHE_CHARS:
                del self.words[w]
        return out


def counter(path: str) -> WordCounter:
    own = kept("tokens")
    if path not in own:
        own[path] = WordCounter(path)
    return own[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)

    def run(batches):
        c = counter(tokenizer_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = []
            for lo in range(0, len(texts), 500):
                n += c.count(texts[lo : lo + 500])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    src = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return mapped(src, run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", "tokens")
