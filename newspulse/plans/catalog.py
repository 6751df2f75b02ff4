"""Importing this module registers every query."""

import importlib

from newspulse.plans.registry import ORACLES, QUERIES

for _name in ("q_daily", "q_text", "q_keywords", "q_sentiment", "q_state", "q_pages", "q_frontier", "q_stream"):
    importlib.import_module(f"newspulse.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
