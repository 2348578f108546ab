"""Collects the registered queries of the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annotation, evaluation, extras, knowledge, lexicon, maintenance, relational, texts

FLAGSHIP = "c1_hybrid_retrieve"
_MODULES = [relational, texts, knowledge, evaluation, maintenance, annotation, extras, lexicon]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.SQL
    return found
