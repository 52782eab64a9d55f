"""Every query of the library by name, with its oracle SQL where DuckDB can express it."""

from __future__ import annotations

from . import content, evaluation, preparation, scoring, splits  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = QUERIES["rank_metrics_micro_macro"]
