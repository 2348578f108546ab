"""Canonical names: every way of writing a name meets its one form in a lookup table; what isn't listed has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def ways(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """key and name: names, spaces closed up, a final s dropped, and aliases (alias, name); an alias goes before a name.

    Where two names share a way of writing, the one later in the alphabet has it.
    """
    own = names.select("name", F.explode(F.array(T.name_key(F.col("name")), F.replace(T.name_key(F.col("name")), F.lit(" "), F.lit("")))).alias("key"))
    single = own.where(F.col("key").endswith("s")).select("name", F.expr("left(key, length(key) - 1)").alias("key"))
    other = aliases.select("name", F.explode(F.array(T.name_key(F.col("alias")), F.replace(T.name_key(F.col("alias")), F.lit(" "), F.lit("")))).alias("key"))
    every = own.union(single).withColumn("first", F.lit(0)).union(other.withColumn("first", F.lit(1)))
    return every.where("key <> ''").groupBy("key").agg(F.max(F.struct("first", "name")).alias("m")).select("key", F.col("m.name").alias("name"))


def canonical_names(df: DataFrame, column: str, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds canonical: the one form of a name however it is written, or null."""
    lookup = ways(names, aliases).select(F.col("key").alias("_key"), F.col("name").alias("canonical"))
    return df.withColumn("_k", T.name_key(F.trim(column))).join(lookup, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")


def canonical_term(value: Column, vocabulary: tuple[str, ...], aliases: dict[str, str]) -> Column:
    """A term of a closed vocabulary: itself in lower case with underscores, or by alias; null for any other."""
    raw = F.translate(F.lower(F.trim(value)), "- ", "__")
    found = F.create_map(*[F.lit(x) for pair in {k: v for k, v in aliases.items() if v in vocabulary}.items() for x in pair]) if aliases else None
    alias = F.try_element_at(found, T.normalized_key(value)) if found is not None else F.lit(None).cast("string")
    return F.when(raw.isin(*vocabulary), raw).otherwise(alias)


def without_brackets(value: Column) -> Column:
    return F.regexp_replace(value, r"\s*\([^)]*\)", "")


def canonical_entities(df: DataFrame, kind: str, value: str, aliases: DataFrame) -> DataFrame:
    """Adds key: the canonical form by kind and alias (kind, alias, name), tried again without brackets; or null.

    A name that isn't listed makes no entity.
    """
    a = aliases.select(F.lower("kind").alias("_kind"), T.normalized_key(F.col("alias")).alias("_alias"), "name").groupBy("_kind", "_alias").agg(F.max("name").alias("_name"))
    rows = df.withColumn("_whole", T.normalized_key(F.col(value))).withColumn("_bare", T.normalized_key(without_brackets(F.col(value)))).withColumn("_of", F.lower(F.trim(kind)))
    for k, by in enumerate(("_whole", "_bare")):
        side = a.select(F.col("_kind").alias(f"_kind{k}"), F.col("_alias").alias(f"_alias{k}"), F.col("_name").alias(f"_name{k}"))
        rows = rows.join(side, (F.col("_of") == F.col(f"_kind{k}")) & (F.col(by) == F.col(f"_alias{k}")), "left").drop(f"_kind{k}", f"_alias{k}")
    return rows.withColumn("key", F.coalesce("_name0", "_name1")).drop("_whole", "_bare", "_of", "_name0", "_name1")


def exposed_aliases(texts: DataFrame, owners: DataFrame, slots: DataFrame) -> DataFrame:
    """id, alias, canonical: the names of slots that a text itself mentions.

    ``texts``: id, text. ``owners``: id, owner (whose slots may be meant). ``slots``: owner, slot, name (several, parted by
    slashes). A bare slot counts only where the text has a single owner; texts and names meet by owner.
    """
    alone = owners.groupBy("id").agg(F.countDistinct("owner").alias("_owners"))
    rows = owners.distinct().join(alone, "id").join(slots, "owner").join(texts, "id")
    canonical = F.concat_ws(" ", "owner", "slot")
    parts = F.transform(F.split(F.coalesce("name", F.lit("")), "/"), lambda x: F.trim(x))
    named = F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.concat_ws(" ", "owner", "name"))
    every = F.array_compact(F.concat(F.array(canonical), F.filter(parts, lambda x: x != ""), F.array(named, F.when(F.col("_owners") == 1, F.col("slot")))))
    rows = rows.select("id", "text", canonical.alias("canonical"), F.explode(F.array_distinct(every)).alias("alias"))
    bounded = F.concat(F.lit(r"(?i)(?<![a-z0-9])\Q"), "alias", F.lit(r"\E(?![a-z0-9])"))
    return rows.where(F.regexp_like("text", bounded)).select("id", "alias", "canonical")
