"""A small evidence graph: merging relations, contradictions, validation, bounded search, trees.

A relation: subject, relation_type, object, condition, confidence, evidence_id, source_id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import by_group, column, group_numbers

IDENTITY = ["subject", "relation_type", "object", "condition"]
#: Relation types that can't both hold for one subject and object.
CONFLICTS = (("counters", "supports"), ("enables", "prevents"))


def identity(df: DataFrame) -> DataFrame:
    """Adds ``key``: the identity of a relation, case and white space aside."""
    parts = [F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")) for c in IDENTITY]
    return df.withColumn("key", F.sha2(F.concat_ws("\x1f", *parts), 256))


def merged(df: DataFrame) -> DataFrame:
    """One row for each identity: highest confidence, evidence in order and once, how many sources and their least confidence."""
    first = {c: F.min(c).alias(c) for c in IDENTITY}
    g = identity(df).groupBy("key").agg(*first.values(), F.max("confidence").alias("confidence"), F.min("confidence").alias("least"), F.array_sort(F.collect_set("evidence_id")).alias("evidence"), F.countDistinct("source_id").alias("sources"))
    return g


def best_alignment(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key with the greatest (confidence, kind, text)."""
    return df.groupBy(*keys).agg(F.max(F.struct("confidence", "kind", "text")).alias("b")).select(*keys, "b.*")


def contradictions(df: DataFrame) -> DataFrame:
    """Pairs of identities with the same ends and condition and conflicting types."""
    m = merged(df).select("key", *IDENTITY)
    table = df.sparkSession.createDataFrame([*CONFLICTS], "a_type string, b_type string")
    a = m.withColumnsRenamed({"key": "a_key", "relation_type": "a_type"}).join(F.broadcast(table), "a_type")
    b = m.withColumnsRenamed({"key": "b_key", "relation_type": "b_type"})
    return a.join(b, ["subject", "object", "condition", "b_type"]).select("subject", "object", "condition", "a_type", "b_type")


def accepted(df: DataFrame, least: float) -> DataFrame:
    """Adds status: quarantined where a conflicting relation is as trusted, review below ``least``, else accepted."""
    m = merged(df)
    table = df.sparkSession.createDataFrame([*CONFLICTS, *[(b, a) for a, b in CONFLICTS]], "relation_type string, other_type string")
    rival = m.select("subject", "object", "condition", F.col("relation_type").alias("other_type"), F.col("confidence").alias("rival"))
    j = m.join(F.broadcast(table), "relation_type", "left").join(rival, ["subject", "object", "condition", "other_type"], "left")
    j = j.groupBy("key", *IDENTITY, "confidence", "sources").agg(F.max("rival").alias("rival"))
    return j.withColumn("status", F.when(F.col("rival") >= F.col("confidence"), "quarantined").when(F.col("confidence") < least, "review").otherwise("accepted")).drop("rival")


def weighed(extraction: Column, evidence: Column, canonical: Column) -> Column:
    """0.55 of the extraction's confidence, 0.35 of the evidence's quality, 0.10 for canonical names."""
    return 0.55 * extraction + 0.35 * evidence + 0.10 * canonical


def compiled(df: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Adds reason: the first rule that a candidate relation breaks, or null; no row is dropped."""
    reason = (
        F.when(F.col("subject").isNull() | (F.trim("subject") == ""), "missing_subject")
        .when(F.col("object").isNull() | (F.trim("object") == ""), "missing_object")
        .when(~F.col("relation_type").isin(*types), "unknown_type")
        .when(F.lower("subject") == F.lower("object"), "same_ends")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "bad_confidence")
        .when(F.col("evidence_id").isNull(), "no_evidence")
    )
    return df.withColumn("reason", reason)


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rule and id of whatever breaks the graph's rules: ids twice, ends that aren't there, loops, ends of other sources."""
    twice = nodes.groupBy("id").count().where("count > 1").select(F.lit("node_twice").alias("rule"), F.col("id").cast("string").alias("id"))
    s, t = (nodes.select(F.col("id").alias(f"{x}_id"), F.col("source_id").alias(f"{x}_at")).distinct() for x in "st")
    j = edges.join(s, edges["src"] == s["s_id"], "left").join(t, edges["dst"] == t["t_id"], "left")
    name = F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))
    rules = [("end_missing", F.col("s_id").isNull() | F.col("t_id").isNull()), ("loop", F.col("src") == F.col("dst")), ("other_source", F.col("s_at") != F.col("t_at"))]
    return reduce(DataFrame.union, [j.where(c).select(F.lit(r).alias("rule"), name.alias("id")).distinct() for r, c in rules], twice)


def first_edges(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """Edges of several lists; of equal keys the first list's stays."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("owner", F.lit(i)) for i, df in enumerate(lists)])
    return rows.groupBy(*keys).agg(F.min("owner").alias("owner"))


def disagreements(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that only one of two sets holds, and which."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, keys, "full").where(F.col("_a").isNull() | F.col("_b").isNull())
    return j.select(*keys, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("only_in"))


def bounded_search(relations: DataFrame, start: list[str], hops: int, most: int) -> DataFrame:
    """node, hop and confidence of what ``start`` reaches within so many steps, nearest first, then trusted; ``most`` in all.

    A step joins the frontier with the edges; the frontier of a step is at most ``most`` nodes, so it stays a small side.
    ``relations``: subject, object, confidence, evidence (rows without evidence don't count).
    """
    spark = relations.sparkSession
    edges = relations.where(F.size("evidence") > 0).select("subject", "object", "confidence")
    both = edges.union(edges.select("object", "subject", "confidence")).toDF("node", "next", "confidence")
    reached = spark.createDataFrame([(n, 0, 1.0) for n in start], "node string, hop int, confidence double")
    frontier = reached.select("node")
    for hop in range(1, hops + 1):
        step = both.join(F.broadcast(frontier), "node").groupBy(F.col("next").alias("node")).agg(F.max("confidence").alias("confidence"))
        fresh = step.join(reached.select("node"), "node", "left_anti").orderBy(F.desc("confidence"), "node").limit(most)
        rows = [(r["node"], hop, r["confidence"]) for r in fresh.collect()]  # at most ``most``
        if not rows:
            break
        found = spark.createDataFrame(rows, "node string, hop int, confidence double")
        reached, frontier = reached.union(found), found.select("node")
    return reached.orderBy("hop", F.desc("confidence"), "node").limit(most)


def _reached(group: np.ndarray, word: np.ndarray, head: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of words by sentence: each row's word by number, its head's (-1: none such), and by number the depth (-1: unreached).

    Rows that are ``apart`` are neither heads nor below any.
    """
    values, at = np.unique(np.concatenate([word, head]), return_inverse=True)
    own, above = group * len(values) + at[: len(word)], group * len(values) + at[len(word) :]
    keys, child = np.unique(own, return_inverse=True)
    place = np.minimum(np.searchsorted(keys, above), max(len(keys) - 1, 0))
    parent = np.where((keys[place] == above) & ~apart if len(keys) else False, place, -1)
    depth = np.full(len(keys), -1)
    depth[child[head == 0]] = 0
    rows, level = np.flatnonzero((parent >= 0) & (depth[child] < 0)), 1
    while len(rows):
        below = depth[parent[rows]] >= 0
        if not below.any():
            break
        depth[child[rows[below]]] = level
        rows, level = rows[depth[child[rows]] < 0], level + 1
    return child, parent, depth


def tree_rows(table: pa.Table, sentence: str, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence number, word and the three arrays of ``_reached`` of a table of whole sentences; no head counts as one that isn't there."""
    group, null = group_numbers(table, sentence) if group is None else group, np.iinfo(np.int64).min
    word, head = column(table, "word", null), column(table, "head", null)
    # Nothing joins a null: such rows may be roots, and no more.
    apart = pc.is_null(table.column(sentence)).to_numpy() | (word == null) | (head == null)
    return group, word, *_reached(group, word, head, apart)


def tree_depths(words: DataFrame, sentence: str = "sentence") -> DataFrame:
    """sentence, word and depth of every word of dependency trees (head 0 is the root), each word once.

    Words that no root reaches (cycles) get no row; one with several heads has the least depth. Whole sentences go through
    a kernel, level by level, so neither the rows nor the depth are limited.
    """

    def kernel(table: pa.Table) -> pa.Table:
        _, word, child, _, depth = tree_rows(table, sentence)
        first = np.unique(child, return_index=True)[1]
        first = first[depth[child[first]] >= 0]
        rows = table.select([sentence, "word"]).take(pa.array(first))
        return rows.append_column("depth", pa.array(depth[child[first]].astype(np.int32)))

    out = T.StructType([words.schema[sentence], words.schema["word"], T.StructField("depth", T.IntegerType())])
    return by_group(words.select(sentence, "word", "head"), sentence, kernel, out)


def boundary_status(start: Column, end: Column, token_start: Column, token_end: Column, n: Column) -> Column:
    """How a span meets the tokens it touches: their first start, last end and number."""
    return (
        F.when(n.isNull() | (n == 0), "UNALIGNED")
        .when((start == token_start) & (end == token_end) & (n == 1), "EXACT")
        .when((start == token_start) & (end == token_end), "TOKEN_ALIGNED")
        .otherwise("PARTIAL")
    )
