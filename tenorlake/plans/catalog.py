"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import joins_queries, misc_queries, model_queries, panel_queries, windows_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
