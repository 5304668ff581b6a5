"""Settings with their defaults; every threshold of the engine is a field here."""

from __future__ import annotations

from dataclasses import dataclass, field


def parse_byte_size(text: str) -> int:
    """'512', '64kb', '2mb' -> bytes."""
    value = text.strip().lower()
    for unit, factor in (("kb", 1024), ("mb", 1024 * 1024)):
        if value.endswith(unit):
            return int(float(value[: -len(unit)]) * factor)
    return int(value)


def format_duration(seconds: int) -> str:
    if seconds < 60:
        return f"{seconds}s"
    minutes = int(seconds / 60 + 0.5)
    return f"{minutes}m" if minutes < 60 else f"{minutes // 60}h {minutes % 60}m"


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of matching, ranking and retrieval. ``as_of_year`` replaces the wall clock, so results are reproducible."""

    as_of_year: int = 2026
    exact: float = 0.95
    near_exact: float = 0.85
    title_exact: float = 0.97
    recency_boost: float = 0.05
    similarity_weights: dict = field(default_factory=lambda: {"title": 0.4, "abstract": 0.3, "keywords": 0.2, "topics": 0.1})
    max_primary: int = 5
    max_fallback: int = 2
    max_extended: int = 2
    results_per_source: int = 20
    min_similar: int = 8
    max_similar: int = 10
    max_candidates: int = 50
    has_core_key: bool = False
    contact_email: str = ""
    # Quirks of the described behaviour that can be switched off.
    empty_titles_are_equal: bool = True

    def __post_init__(self) -> None:
        if abs(sum(self.similarity_weights.values()) - 1.0) > 0.001:
            raise ValueError("similarity weights must sum to 1")
        for name in ("exact", "near_exact", "title_exact"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.max_similar < self.min_similar:
            raise ValueError("max_similar must not be below min_similar")


DEFAULT = EngineConfig()
