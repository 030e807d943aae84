"""Engine settings: one immutable object, validated when made."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class ChunkConfig:
    mode: str = "paragraph"
    max_chunk_words: int = 400
    chunk_words: int = 140
    overlap_words: int = 100
    title_chunk: bool = True
    delimiter: str = "\n\n"

    def __post_init__(self):
        if self.mode not in ("paragraph", "word_windows"):
            raise ValueError(f"unknown chunking mode {self.mode!r}")


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class RetrieveConfig:
    use_dense: bool = True
    use_chunk_bm25: bool = True
    use_title_bm25: bool = True
    use_page_bm25: bool = True
    use_expansion: bool = True
    candidate_multiplier: int = 425
    bm25_candidate_multiplier: int = 500
    rerank_cap: int = 20
    page_aggregation: str = "max_plus_mean_top3"
    agg_max_weight: float = 0.2
    agg_mean_weight: float = 0.8
    rrf_k: int = 20
    dense_weight: float = 1.0
    chunk_weight: float = 1.0
    title_weight: float = 0.65
    page_weight: float = 0.07
    rerank_rrf_weight: float = 3.0
    snippet_window: int = 120
    snippet_step: int = 20
    pad_zero_scores: bool = False

    def __post_init__(self):
        if self.page_aggregation not in ("max", "max_plus_mean_top3"):
            raise ValueError(f"unknown page aggregation {self.page_aggregation!r}")


@dataclass(frozen=True)
class EngineConfig:
    chunking: ChunkConfig = field(default_factory=ChunkConfig)
    bm25: Bm25Config = field(default_factory=Bm25Config)
    retrieve: RetrieveConfig = field(default_factory=RetrieveConfig)
    seed: int = 13

    def with_retrieve(self, **changes: Any) -> "EngineConfig":
        return replace(self, retrieve=replace(self.retrieve, **changes))

    @classmethod
    def from_dict(cls, raw: dict) -> "EngineConfig":
        """From nested settings; absent sections and keys keep their defaults, unknown keys raise."""
        parts = {"chunking": ChunkConfig, "bm25": Bm25Config, "retrieve": RetrieveConfig}
        return cls(**{k: parts[k](**raw.get(k) or {}) for k in parts}, seed=raw.get("seed", 13))

    def flat(self) -> dict[str, Any]:
        """Every setting by its dotted name."""
        nested = asdict(self)
        return {f"{a}.{b}" if isinstance(x, dict) else a: y for a, x in nested.items() for b, y in (x.items() if isinstance(x, dict) else [(a, x)])}

    def patched(self, changes: dict[str, Any]) -> "EngineConfig":
        """With settings changed by their dotted names; unknown names raise."""
        nested = asdict(self)
        for name, value in changes.items():
            if name not in self.flat():
                raise KeyError(f"no setting {name!r}")
            *part, last = name.split(".")
            (nested[part[0]] if part else nested)[last] = value
        return EngineConfig.from_dict(nested)

    @classmethod
    def load(cls, path: str) -> "EngineConfig":
        """From a JSON file."""
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1, sort_keys=True)

    def for_index(self) -> dict[str, Any]:
        """What an index depends on; how it is searched is not among it."""
        return {k: v for k, v in self.flat().items() if k.startswith(("chunking.", "bm25."))}


_CURRENT: list[EngineConfig] = []


def current() -> EngineConfig:
    """The settings in force: those of the innermost ``overridden``, else the defaults."""
    return _CURRENT[-1] if _CURRENT else EngineConfig()


@contextmanager
def overridden(**retrieve: Any) -> Iterator[EngineConfig]:
    """Retrieval settings changed for as long as the block runs."""
    _CURRENT.append(current().with_retrieve(**retrieve))
    try:
        yield _CURRENT[-1]
    finally:
        _CURRENT.pop()


def index_folder(given: str | None = None) -> str:
    """Where the index lies: as given, else the environment's ARTIFACTS_DIR, else ``artifacts``."""
    return given or os.environ.get("ARTIFACTS_DIR") or "artifacts"
