"""All tunables of the engine, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chars_per_token: float = 3.5
    child_tokens: int = 380
    overlap_tokens: int = 64
    parent_tokens: int = 1400
    min_chunk_chars: int = 24
    min_preamble_chars: int = 40
    retrieve_top_k: int = 50
    rerank_top_n: int = 6
    min_rerank_score: float = 0.0
    hard_reject_score: float = -4.0
    rrf_k: int = 60  # ranks count from 1
    dense_dim: int = 64
    toc_gap: int = 25
    scan_chars: int = 50
    refusal: str = "В предоставленных документах ответ не найден."

    @property
    def child_chars(self) -> int:
        return int(self.child_tokens * self.chars_per_token)

    @property
    def overlap_chars(self) -> int:
        return int(self.overlap_tokens * self.chars_per_token)

    @property
    def parent_chars(self) -> int:
        return int(self.parent_tokens * self.chars_per_token)


DEFAULT = Config()
