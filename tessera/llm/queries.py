"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, media, mixing, quality, repeats, simhash, suffixes, token_planes, toxicity

_QUERIES = {
    "op1_token_planes": token_planes.query,
    "op2_media_archives": media.query,
    "op3_mix_sources": mixing.query,
    "op4_html_crf": html_extract.query,
    "op5_repeated_passages": repeats.query,
    "op6_shared_strings": suffixes.query,
    "op7_toxicity_lexicon": toxicity.query,
    "op8_decontaminate": decontaminate.query,
    "op9_quality_sites": quality.query,
    "op10_simhash_tiles": simhash.query,
}
_SQL: dict[str, str] = {
    "op3_mix_sources": mixing.SQL,
    "op8_decontaminate": decontaminate.SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
