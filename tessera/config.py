"""Tunables of the engine, with the reference values as defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    limit: int = 15
    recall_multiplier: int = 5
    rrf_k: int = 60
    rerank_threshold: float | None = 0.0004
    cliff_delta: float = 1.0
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    drop_ratio: float = 0.2
    dimension: int = 64
    max_chunk_chars: int = 500
    min_chunk_chars: int = 10
    short_chunk_chars: int = 60
    overlap_chars: int = 20
    overlap_threshold: float = 0.45
    dedupe_ttl_s: int = 3600
    cancel_ttl_s: int = 7200
    feedback_window_s: int = 1800
    feedback_window_least_s: int = 300

    def recall_limit(self, limit: int | None = None, given: int | None = None) -> int:
        limit = limit or self.limit
        return given or max(limit * self.recall_multiplier, limit)


DEFAULT = Config()
