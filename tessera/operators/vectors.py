"""Vectors: products, centroids, neighbours by tiles, greedy duplicates.

All-pairs work goes through tiles: rows of a group are packed into tiles of bounded size, tiles of a group meet in a join,
and a task multiplies two matrices and hands on counts or the best few of each row, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE = 1024


def dot(a: Column, b: Column) -> Column:
    """The product of two vectors, summed as doubles in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; null for a vector of zeros."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Keys, vector (the mean, at length one) and n: grouped sums by place, so groups of any size need no collecting."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sums = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return means.withColumn("vector", unit(F.transform("s", lambda p: p["x"]))).drop("s").join(n, keys)


def _tiles(df: DataFrame, group: Column, tile: int) -> DataFrame:
    """g, t and packed ids, owners and vectors; ``df``: id, owner, vector."""
    n = max(1, -(-df.count() // tile))

    def pack(key, table):
        v = np.array(table.column("vector").to_pylist(), np.float32)
        return pa.table({"g": [key[0].as_py()], "t": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(v)], pa.int32()), "ids": [np.asarray(table.column("id")).astype(np.int64).tobytes()], "owners": [np.asarray(table.column("owner")).astype(np.int64).tobytes()], "vectors": [v.tobytes()]})

    rows = df.withColumn("g", group.cast("string")).withColumn("t", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return rows.select("g", "t", "id", "owner", "vector").groupBy("g", "t").applyInArrow(pack, "g string, t int, n int, ids binary, owners binary, vectors binary")


def _meet(queries: DataFrame, base: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(query ids, owners, vectors, base ids, owners, vectors) for all pairs of tiles of a group."""
    a = queries.select("g", *[F.col(c).alias(f"{c}_a") for c in ("n", "ids", "owners", "vectors")])
    b = base.select("g", *[F.col(c).alias(f"{c}_b") for c in ("n", "ids", "owners", "vectors")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sides = []
                for s in "ab":
                    sides += [np.frombuffer(r[f"ids_{s}"], np.int64), np.frombuffer(r[f"owners_{s}"], np.int64), np.frombuffer(r[f"vectors_{s}"], np.float32).reshape(r[f"n_{s}"], -1).astype(np.float64)]
                out = work(*sides)
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return a.join(b, "g").drop("g").mapInArrow(run, schema)


def neighbour_counts(df: DataFrame, group: Column, least: float, tile: int = TILE) -> DataFrame:
    """id and neighbours: rows of the same group and another owner whose product reaches ``least``; 0 where none does."""
    t = _tiles(df, group, tile)

    def work(ia, oa, va, ib, ob, vb):
        hits = ((va @ vb.T) >= least) & (oa[:, None] != ob[None, :])
        return pd.DataFrame({"id": ia, "k": hits.sum(axis=1).astype(np.int64)})

    return _meet(t, t, work, "id long, k long").groupBy("id").agg(F.sum("k").alias("neighbours"))


def cluster_scores(df: DataFrame, group: Column, least: float, full: int = 3, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """id, neighbours, cluster_score and confidence; ``df`` also has source_score (null counts as 0.5)."""
    n = neighbour_counts(df, group, least)
    c = F.least(F.col("neighbours") / F.lit(float(full)), F.lit(1.0))
    out = df.select("id", "source_score").join(n, "id")
    return out.select("id", "neighbours", F.round(c, 4).alias("cluster_score"), F.round(F.lit(weights[0]) * F.coalesce("source_score", F.lit(0.5)) + F.lit(weights[1]) * c, 4).alias("confidence"))


def nearest(queries: DataFrame, base: DataFrame, k: int, least: float = -1.0, tile: int = TILE) -> DataFrame:
    """id, other, similarity, place: the k rows of ``base`` nearest to each query (other owners only), ties by id.

    Each pair of tiles keeps its best k per query, and the final choice is among k for each tile of the base.
    """
    qa, ba = (_tiles(d, F.lit("all"), tile) for d in (queries, base))

    def work(ia, oa, va, ib, ob, vb):
        s = np.where(oa[:, None] != ob[None, :], va @ vb.T, -2.0)
        order = np.lexsort((np.broadcast_to(ib, s.shape), -np.round(s, 9)), axis=1)[:, :k]
        sims = np.take_along_axis(s, order, axis=1)
        keep = sims >= max(least, -1.5)
        rows = np.repeat(np.arange(len(ia)), keep.sum(axis=1))
        return pd.DataFrame({"id": ia[rows], "other": ib[order[keep]], "similarity": sims[keep]})

    found = _meet(qa, ba, work, "id long, other long, similarity double")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def greedy_duplicates(df: DataFrame, group: str, least: float) -> DataFrame:
    """id, repetition_count, is_duplicate: within a group, in id order, a row takes all later free rows near it.

    The choice depends on the order, so a group is one fold; groups are single source documents. Of a cluster the row
    with the highest source score stays (null as 0, the first on ties), with the cluster's size as repetitions.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        v = np.array(pdf["vector"].tolist(), np.float64)
        score = pdf["source_score"].fillna(0.0).to_numpy()
        rep, dup, seen = np.ones(len(pdf), np.int64), np.zeros(len(pdf), bool), np.zeros(len(pdf), bool)
        for i in range(len(pdf)):
            if seen[i]:
                continue
            near = [j for j in range(len(pdf)) if j != i and not seen[j] and v[i] @ v[j] >= least]
            if near:
                members = [i, *near]
                seen[members] = True
                lead = max(members, key=lambda m: score[m])
                rep[lead] = len(members)
                dup[[m for m in members if m != lead]] = True
        return pd.DataFrame({"id": pdf["id"], "repetition_count": rep, "is_duplicate": dup})

    return df.select(group, "id", "source_score", "vector").groupBy(group).applyInPandas(fold, "id long, repetition_count long, is_duplicate boolean")


def grounding(facts: DataFrame, windows: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """id and source_score: the largest product of a fact with a window of its document."""
    pairs = facts.join(windows, key)
    return (pairs if where is None else pairs.where(where)).groupBy("id").agg(F.max(dot(F.col("vector"), F.col("window_vector"))).alias("source_score"))
