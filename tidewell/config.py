"""Settings with their defaults, and the moment that stands for now."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

#: Every operator that needs the current time takes it as an argument; queries over the
#: fixture tables use this moment.
AS_OF = datetime(2024, 1, 31)


@dataclass(frozen=True)
class Settings:
    as_of: datetime = AS_OF
    window_hours: int = 24
    hot_percent: int = 10
    hot_percent_by_locale: dict[str, int] = field(default_factory=dict)
    source_langs: tuple[str, ...] = ()
    batch_size: int = 50
    topic_top: int = 200
    topic_llm_top: int = 50
    region_top: int = 50
    region_llm_top: int = 20
    feed_limit: int = 50
    scan_cap: int = 2000
    recompute_hours: float = 6.0
    min_purity: float = 0.80
    strong_score: int = 10
    expire_days: int = 30
    strong_expire_days: int = 90
    retention_days: int = 30
    bucket_cap_percent: float = 40.0
