"""Operator parameters (the reference's preferences plus the Spark-side knobs)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DigestParams:
    # --- reference preferences (defaults as in the reference) ---
    signal_threshold: float = 60.0  # 0..100
    max_items: int = 10  # T3: >= 1
    cooldown_minutes: float = 5.0  # >= 0
    enable_model_scoring: bool = True  # F8
    fuzzy_threshold: float = 0.7  # D3 Dice threshold
    prune_k: int = 150  # T1
    candidate_limit: int = 25  # T2
    batch_size: int = 10  # W4, B1
    blend_l1: float = 0.7  # S5
    blend_l2: float = 0.3  # S5
    pending_hours: int = 24  # F6
    # --- Spark-side ---
    strict_reference: bool = True  # reproduce the reference's quirks (S6, S8, F2, F6)
    keep_query_params: bool = False  # S6 in default mode
    # Dictionaries up to this many keywords become one JVM expression; larger
    # ones, of any size, are found by the runs of the texts, or by gram joins (operators.keywords).
    inline_keyword_limit: int = 512
    group_cols: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not 0 <= self.signal_threshold <= 100:
            raise ValueError("signal_threshold must lie in 0..100")
        if self.max_items < 1:
            raise ValueError("max_items must be >= 1")
        if self.cooldown_minutes < 0:
            raise ValueError("cooldown_minutes must be >= 0")
        if not 0 <= self.fuzzy_threshold <= 1:
            raise ValueError("fuzzy_threshold must lie in 0..1")
