"""Queries over the given tables, and their SQL."""

from __future__ import annotations

from tapewright.plans.filings import FILINGS
from tapewright.plans.market import MARKET
from tapewright.plans.streams import STREAMS

_ALL = MARKET | FILINGS | STREAMS


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
