"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

from . import (  # noqa: F401
    q_analysis, q_dashboard, q_forecast, q_ingest, q_mentions, q_parts, q_report, q_streaming, q_text_inventory)
from . import q_context, q_rules  # noqa: F401 (reuse oracles of the modules above)
from .registry import QUERIES  # noqa: F401
