"""Tunable values of the text-reuse and concordance operators; passed to them, never read from module state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ReuseParams:
    min_text_length: int = 20
    gram: int = 5
    stop_share: float = 0.05
    min_containment: float = 0.10
    size_ratio: float = 2.0
    max_digest_chars: int = 50_000
    seed_length: int = 5
    fuzzy_stop: int = -4
    match_score: int = 1
    mismatch_score: int = -2
    early_exit_coverage: float = 0.10
    region_gap: int = 100
    prefilter_chars: int = 5_000


@dataclass(frozen=True)
class ScoreParams:
    excerpt_coverage: float = 0.80
    digest_coverage: float = 0.30
    shared_coverage: float = 0.10
    excerpt_avg: float = 15.0
    digest_avg: float = 10.0
    retranslation_ratio: float = 3.0
    phonetic_weight: float = 0.8
    weights: tuple[float, ...] = (0.35, 0.20, 0.10, 0.10, 0.15, 0.10)
    multi_source_gain: float = 1.1


@dataclass(frozen=True)
class PhoneticParams:
    gram: int = 3
    stop_share: float = 0.05
    least_stop: int = 2
    min_containment: float = 0.25
    window: int = 20
    density: float = 0.6
    min_region: int = 10
    max_syllables: int = 5
    seed_length: int = 5
    least_different: int = 2
    max_positions: int = 500


@dataclass(frozen=True)
class TitleParams:
    token_jaccard: float = 0.7
    fuzzy_ratio: float = 0.90
    fuzzy_least_length: int = 5


@dataclass(frozen=True)
class ConcordanceParams:
    strong_confidence: float = 0.9
    encyclopedic_links: int = 5
    computational_confidence: float = 0.9
    pair_minimum: int = 20
    range_cap: int = 200
