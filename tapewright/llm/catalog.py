"""Queries and SQL of the operators of this folder."""

from __future__ import annotations

from importlib import import_module

MODULES = ("backoff_lm", "toxicity", "mixing", "webp", "preference", "suffix_dedup", "order_minhash", "jaccard_join", "token_files", "bpe", "link_graph", "divergence", "conversation_trie")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"tapewright.llm.{name}"), what, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
