"""Defaults of the retrieval engine. Every threshold can also arrive as a column."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # fixed values, equal to those of the system whose results are matched
    chunk_size: int = 900
    chunk_overlap: int = 150
    top_k: int = 6
    summary_top_k: int = 12
    pool_factor: int = 4
    max_context_chars: int = 14_000
    min_score: float = 0.25
    max_per_source: int = 3
    min_ratio: float = 0.5
    numeric_damping: float = 0.5
    numeric_share: float = 0.8
    rrf_k: int = 60
    dense_strong: float = 0.40
    coverage_min: float = 0.5
    rescue_min: float = 0.12
    history_turns: int = 6
    history_summary_chars: int = 600
    embed_max_tokens: int = 256
    rerank_pool: int = 20
    rerank_top: int = 10
    latency_window: int = 200
    occurrence_chunks: int = 40
    occurrence_spans: int = 10
    k1: float = 1.5
    b: float = 0.75


DEFAULTS = Settings()
