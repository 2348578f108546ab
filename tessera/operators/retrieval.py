"""Retrieval: BM25, vector ranking, fusion, blended re-ranking, and what is composed of them.

Statistics of the corpus are those of the rows left after filters. Every ranking is a bounded top-k (no global sort),
with the id as the last key. Query terms and query vectors are literals in the plan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

from .ranking import preferred_bonus, source_weight
from .vectors import dot, literal

RRF_K = 60


def query_terms(question: str) -> list[str]:
    """Tokens of a question, repeats kept: a repeated term counts as often."""
    return [t for t in re.split("[^a-z0-9]+", question.lower()) if t]


def bm25(df: DataFrame, question: str, *, text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Adds bm25: two passes, one for the statistics (a single row, broadcast), one for the scores; no term is exploded."""
    terms = query_terms(question)
    names = sorted(set(terms))
    t = df.withColumn("_t", T.tokens(F.col(text))).withColumn("_n", F.size("_t"))
    for i, w in enumerate(names):
        t = t.withColumn(f"_f{i}", F.size("_t") - F.size(F.array_remove("_t", w)))
    t = t.drop("_t")
    stats = t.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_len"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(names))])
    t = t.crossJoin(F.broadcast(stats))  # one row
    avg = F.when(F.col("_len") > 0, F.col("_len")).otherwise(F.lit(1.0))
    score = F.lit(0.0)
    for w in terms:
        i = names.index(w)
        idf = F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5) + 1)
        f = F.col(f"_f{i}")
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / avg))).otherwise(F.lit(0.0))
    return t.withColumn("bm25", score).select(*df.columns, "bm25")


def top(df: DataFrame, score: str, k: int, place: str) -> DataFrame:
    """The k best rows by score, then id, with their place from 1."""
    best = df.orderBy(F.desc(score), "id").limit(k)
    return best.withColumn(place, F.row_number().over(W.orderBy(F.desc(score), "id")))


def rrf(*places: Column) -> Column:
    """Reciprocal rank fusion; a missing place adds nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(1 / (F.lit(float(RRF_K)) + p), F.lit(0.0)) for p in places])


def blended(similarity: Column, preferred: list[str]) -> Column:
    """Half similarity, half trust, a bonus for preferred types, all times the source's weight; 0 counts as unknown."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(0.5))
    trust = 0.6 * known("confidence") + 0.4 * known("source_score")
    return (0.5 * similarity + 0.5 * trust + preferred_bonus(F.col("insight_type"), preferred)) * source_weight(F.col("source"), F.col("rank"), F.col("rating"))


def retrieve(facts: DataFrame, question: str, vector: list[float], k: int, preferred: list[str] | None = None, *, exclude: DataFrame | None = None) -> DataFrame:
    """The k facts that fit best: both rankings are fused, the best of that are re-ranked by the blend.

    Returns the facts' id, text, insight_type, subject, role, source with fused, score (similarity) and final.
    """
    preferred = preferred or []
    rows = facts if exclude is None else facts.join(exclude, "id", "left_anti")
    fetch = max(3 * k, 50)
    scored = bm25(rows, question).withColumn("similarity", dot(F.col("embedding"), literal(vector))).drop("embedding")
    by_vector = top(scored, "similarity", fetch, "_v").select("id", "_v")
    by_words = top(scored, "bm25", fetch, "_w").select("id", "_w")
    fused = by_vector.join(by_words, "id", "full").withColumn("fused", rrf(F.col("_v"), F.col("_w")))
    fused = fused.orderBy(F.desc(F.round("fused", 12)), F.least("_v", "_w"), "id").limit(max(4 * k, 60))
    out = scored.join(F.broadcast(fused.select("id", "fused")), "id").withColumn("final", blended(F.col("similarity"), preferred))
    return out.orderBy(F.desc(F.round("final", 9)), "id").limit(k).select("id", "text", "insight_type", "subject", "role", "source", "fused", F.col("similarity").alias("score"), "final")


def retrieve_hosted(facts: DataFrame, vector: list[float], k: int, preferred: list[str] | None = None) -> DataFrame:
    """Without fusion: the nearest by vector, re-ranked by the blend."""
    scored = facts.withColumn("similarity", dot(F.col("embedding"), literal(vector))).drop("embedding")
    best = top(scored, "similarity", max(4 * k, 60), "_v")
    return best.withColumn("final", blended(F.col("similarity"), preferred or [])).orderBy(F.desc(F.round("final", 9)), "id").limit(k).select("id", F.col("similarity").alias("score"), "final")


def lexical(facts: DataFrame, question: str, k: int) -> DataFrame:
    """The k best by words alone, then confidence."""
    return bm25(facts, question).orderBy(F.desc(F.round("bm25", 9)), F.desc_nulls_last("confidence"), "id").limit(k).select("id", "bm25", "confidence")


def merged(lists: list[DataFrame], k: int) -> DataFrame:
    """Result lists as one: of equal text and type the first list's row stays, then the best k by final score."""
    marked = [df.withColumn("_list", F.lit(i)) for i, df in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, marked)
    first = F.row_number().over(W.partitionBy("text", "insight_type").orderBy("_list", F.desc("final"), "id"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r", "_list").orderBy(F.desc(F.round("final", 9)), "id").limit(k)


def retrieve_pair(facts: DataFrame, question: str, vector: list[float], sides: tuple[Column, ...], k: int, preferred: list[str] | None = None) -> DataFrame:
    """Facts on each of several sides: an equal share for each side, six at least, marked by side; texts once."""
    share = max(k // len(sides), 6)
    found = [retrieve(facts.where(s), question, vector, share, preferred).withColumn("side", F.lit(i)) for i, s in enumerate(sides)]
    rows = reduce(DataFrame.unionByName, found)
    first = F.row_number().over(W.partitionBy("text").orderBy("side", F.desc("final"), "id"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r")


def retrieve_duo(facts: DataFrame, question: str, vector: list[float], sides: tuple[Column, Column], k: int, preferred: list[str] | None = None) -> DataFrame:
    """Two sides with half the results each (six at least), texts once a side, and a third (four at least) from all facts.

    ``side`` is 0, 1, or 2 for the general evidence.
    """
    shares = [(s, max(k // 2, 6)) for s in sides] + [(F.lit(True), max(4, k // 3))]
    found = [retrieve(facts.where(s), question, vector, n, preferred).withColumn("side", F.lit(i)) for i, (s, n) in enumerate(shares)]
    rows = reduce(DataFrame.unionByName, found)
    first = F.row_number().over(W.partitionBy("side", "text").orderBy(F.desc("final"), "id"))
    return rows.withColumn("_r", first).where((F.col("_r") == 1) | (F.col("side") == 2)).drop("_r")


def expanded(facts: DataFrame, questions: list[str], vector: list[float], k: int) -> DataFrame:
    """Several wordings of a question, a share of results for each, merged and re-ranked."""
    share = max(k // len(questions), 6)
    return merged([retrieve(facts, q, vector, share) for q in questions], k)


def diversified(results: DataFrame, preferred: list[str], k: int, cap: int = 2) -> DataFrame:
    """One of each preferred type, then more of those, then others up to ``cap`` a type, then the rest; k in all.

    ``results`` is a result list (id, insight_type, final), so the stages are ranks within it.
    """
    by_type = W.partitionBy("insight_type").orderBy(F.desc("final"), "id")
    wanted = F.col("insight_type").isin(preferred) if preferred else F.lit(False)
    place = F.array_position(F.array(*[F.lit(p) for p in preferred or ["-"]]), F.col("insight_type"))
    r = results.withColumn("_n", F.row_number().over(by_type))
    stage = F.when(wanted & (F.col("_n") == 1), 0).when(wanted & (F.col("_n") <= cap), 1).when(F.col("_n") <= cap, 2).otherwise(3)
    r = r.withColumn("_stage", stage).withColumn("_place", F.when(stage == 0, place).otherwise(0))
    return r.orderBy("_stage", "_place", F.desc("final"), "id").limit(k).drop("_n", "_stage", "_place")


def sections(facts: DataFrame, plan: dict[str, list[str]], question: str, vector: list[float], k: int) -> DataFrame:
    """For each section its own facts and general ones, merged and diversified by the section's types."""
    general = facts.where(F.coalesce("subject_type", F.lit("general")) == "general")
    out = []
    for name, types in plan.items():
        both = merged([retrieve(facts, question, vector, k, types), retrieve(general, question, vector, k, types)], 2 * k)
        out.append(diversified(both, types, k).withColumn("section", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def transfer(facts: DataFrame, neighbours: DataFrame, subject: str, k: int) -> DataFrame:
    """Facts about a subject's neighbours, scored by similarity times confidence; ``neighbours``: subject, other, similarity."""
    n = neighbours.where(F.lower("subject") == subject.lower()).select(F.lower("other").alias("_o"), "similarity")
    rows = facts.join(n, F.lower(facts["subject"]) == F.col("_o")).drop("_o", "embedding")
    score = F.round(F.col("similarity") * F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)), 4)
    return rows.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k).select("id", "subject", "similarity", "score")


def coverage_note(counts: DataFrame, subject: str, least: int) -> DataFrame:
    """One row: whether a subject has enough facts of its own, or is answered from its kind."""
    n = counts.where(F.lower("subject") == subject.lower()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return n.select(F.lit(subject).alias("subject"), "n", F.when(F.col("n") >= least, "direct").when(F.col("n") > 0, "thin").otherwise("none").alias("coverage"))
