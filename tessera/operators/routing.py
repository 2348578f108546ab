"""What a question asks for: intents, preferred types and profiles, by tables of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def intent(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str = "general") -> Column:
    """The first intent whose pattern the lower-cased question matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def preferred_types(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The types of all rules whose word occurs, in rule order, each once."""
    low = F.lower(text)
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(word), F.lit(kind)) for word, kind in rules])))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the lower-cased text matches one of the patterns."""
    return reduce(lambda a, b: a | b, [F.lower(text).rlike(p) for p in patterns])
