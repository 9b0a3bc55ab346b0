"""Queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from . import chat_format, lm_score, merkle, mixing, near_dedup, ngram_join, packing, pii, quality, token_counts, token_groups, topk, url_filter

MODULES = (chat_format, lm_score, merkle, mixing, near_dedup, ngram_join, packing, pii, quality, token_counts, token_groups, topk, url_filter)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
