"""Named thresholds; every operator takes its own as arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


# Published defaults of the audit.
@dataclass(frozen=True)
class Config:
    retrieval_k: int = 8
    default_k: int = 3
    semantic_weight: float = 0.80
    keyword_weight: float = 0.20
    boost_base: float = 0.60
    boost_high: tuple[float, float] = (0.85, 0.12)
    boost_low: tuple[float, float] = (0.75, 0.06)
    same_gap: float = 0.02
    cross_gap: float = 0.04
    most_kept: int = 3
    strong: float = 0.90
    partial: float = 0.82
    weak: float = 0.72
    user_threshold: float = 0.2
    module_similarity: float = 0.5
    modules_shown: int = 2
    scope_similarity: float = 0.72
    scope_overlap: float = 0.24
    scope_cosine: float = 0.86
    scope_concepts: int = 150
    override_similarity: float = 0.75
    override_semantic: float = 0.70
    upgrade_semantic: float = 0.80
    detect_distance: float = 0.6
    chunk_most: int = 500
    chunk_least: int = 20
    quality_chars: int = 80
    quality_tokens: int = 8
    quality_headers: float = 0.60
    quality_pass: int = 250
    cleaner_least: int = 30
    reference_most: int = 150
    legacy_block: int = 100


DEFAULTS = Config()
