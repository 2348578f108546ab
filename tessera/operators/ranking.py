"""Relational building blocks: filters, weights, peers, ranks, quotas and nearest rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights of sources; guides are weighed by the rank of their author (no rank counts 1) and their rating.
SOURCE_WEIGHTS = {"discord": 1.6, "aoe2_crossref": 0.9, "aoe2_wiki": 1.1, "aoe2_pdf": 2.0, "aoe2_video": 1.0, "aoe2_coaching": 1.0}
GUIDES = "mobafire_guide"
RANK_WEIGHTS = {"": 1.0, "diamond": 1.0, "emerald": 0.7, "master": 1.4, "grandmaster": 1.8, "challenger": 2.0}


def same_text(column: str, value: str | None) -> Column:
    """Equality without case; no value asks for nothing."""
    return F.lit(True) if value is None else F.lower(F.col(column)) == value.lower()


def filtered_facts(facts: DataFrame, documents: DataFrame, *, role: str | None = None, game: str | None = None, subject: str | None = None, insight_type: str | None = None) -> DataFrame:
    """Facts with their document's role and source and an effective subject, under optional filters."""
    d = documents.select("video_id", F.col("role").alias("_role"), F.col("source").alias("_source"), F.col("subject").alias("_subject"), F.col("champion").alias("_champion"))
    own = F.when(F.col("subject_type").isNotNull(), F.col("subject")).otherwise(F.coalesce("_subject", "_champion"))
    out = facts.join(d.where(same_text("_role", role)), "video_id").withColumn("source", F.coalesce("_source", F.lit("discord"))).withColumn("subject", own)
    return out.where(same_text("game", game) & same_text("subject", subject) & same_text("insight_type", insight_type))


def concat_stores(stores: dict[str, DataFrame | None]) -> DataFrame:
    """All stores that are there, as one table with the store's name; columns that one lacks are null."""
    found = [df.withColumn("source_db", F.lit(name)) for name, df in stores.items() if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def source_weight(source: Column, rank: Column, rating: Column) -> Column:
    guide = aliased_number(F.lower(rank), RANK_WEIGHTS, 1.0) * (1 + F.least(F.greatest((F.coalesce(rating, F.lit(8.5)) - 8.5) * 0.05, F.lit(0.0)), F.lit(0.15)))
    return F.when(source == GUIDES, guide).otherwise(aliased_number(F.coalesce(source, F.lit("discord")), SOURCE_WEIGHTS, 1.0))


def aliased_number(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def aliased(key: Column, names: dict[str, str]) -> Column:
    """A listed value's alias, or the value."""
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in names.items()], key)


def preferred_bonus(kind: Column, preferred: list[str]) -> Column:
    """0.12 for the first preferred type, 0.02 less for each one after it, never below 0."""
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), kind)
    return F.when(place > 0, F.greatest(F.lit(0.0), F.lit(0.12) - F.lit(0.02) * (place - 1))).otherwise(F.lit(0.0))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.60, "high").when(confidence >= 0.30, "medium").otherwise("low")


def commonest(df: DataFrame, group: list[str], member: str, most: int) -> DataFrame:
    """The ``most`` commonest members of each group; ties by name."""
    counts = df.groupBy(*group, member).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), member))).where(F.col("place") <= most)


def peer_z(df: DataFrame, peers: list[str], value: str) -> DataFrame:
    """Adds mean and z: distance from the peers' mean in sample deviations, 0 for fewer than 3 peers or no spread.

    The peers' moments are grouped sums that join back, so a large peer group isn't sorted in one task.
    """
    g = df.groupBy(*peers).agg(F.count(value).alias("_n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    z = F.when((F.col("_n") < 3) | F.col("_s").isNull() | (F.col("_s") == 0), F.lit(0.0)).otherwise((F.col(value) - F.col("mean")) / F.col("_s"))
    return df.join(g, peers).withColumn("z", z).drop("_n", "_s")


def drop_consecutive(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, within: int) -> DataFrame:
    """For each left event the nearest right event of the same key within so many seconds; ties by id.

    Both sides are cut into spans of that length, so that the join is by key and span (with its neighbours), and a key
    with many events spreads over its spans.
    """
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    a = left.select(key, F.col("event_id"), sec.alias("t")).withColumn("span", F.explode(F.array(*[F.floor(F.col("t") / within) + d for d in (-1, 0, 1)])))
    b = right.select(key, F.col("event_id").alias("nearest"), sec.alias("u")).withColumn("span", F.floor(F.col("u") / within))
    pairs = a.join(b, [key, "span"]).withColumn("gap", F.abs(F.col("t") - F.col("u"))).where(F.col("gap") <= within)
    return pairs.groupBy("event_id").agg(F.min(F.struct("gap", "nearest")).alias("m")).select("event_id", "m.nearest", "m.gap")


def nearest_consumed(left: DataFrame, right: DataFrame, key: str, within: int) -> DataFrame:
    """As ``nearest_in_time``, but a right event serves once: left events choose in time order, per key.

    The choice depends on all earlier ones of the key, so a key is one fold; candidates are cut to the time limit first.
    """
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = left.select(key, F.lit(0).alias("side"), "event_id", sec.alias("t")).union(right.select(key, F.lit(1), "event_id", sec))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf[pdf.side == 0].sort_values(["t", "event_id"])
        offers = pdf[pdf.side == 1].sort_values(["t", "event_id"])
        t, ids, free, out = offers.t.to_numpy(), offers.event_id.to_numpy(), [True] * len(offers), []
        for e, at in zip(asks.event_id, asks.t, strict=True):
            lo, hi = t.searchsorted([at - within, at + within + 1])
            near = [(abs(int(t[k]) - at), int(ids[k]), k) for k in range(lo, hi) if free[k]]
            if near:
                gap, other, k = min(near)
                free[k] = False
                out.append((e, other, gap))
        return pd.DataFrame(out, columns=["event_id", "nearest", "gap"]).astype("int64")

    return rows.groupBy(key).applyInPandas(fold, "event_id long, nearest long, gap long")


def numbered(df: DataFrame, lead: list[str], order: str, name: str, parts: int = 200) -> DataFrame:
    """Adds each row's place, from 1, in the order of ``lead`` (columns of few values) and a number, without one task for all.

    Rows are numbered within ranges of the number, cut at approximate quantiles (which decide on balance alone), and the
    ranges' sizes, a row for each, are added up.
    """
    cuts = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_part", part)
    by = [*lead, "_part"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumn("_before", F.sum("_size").over(W.orderBy(*by).rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")).drop("_size")
    same = sizes.select(*[F.col(c).alias(f"_b{k}") for k, c in enumerate(by)], "_before")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(by)])
    placed = rows.join(same, on).withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy(*by).orderBy(order)))
    return placed.drop("_part", "_before", *[f"_b{k}" for k in range(len(by))])


def evenly(df: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows, evenly spaced in the order of a number, both ends included."""
    n = df.count()
    ranked = numbered(df, [], order, "_i").withColumn("_i", F.col("_i") - 1).withColumn("_n", F.lit(n))
    # Row i is chosen where it is the rounded place of some k; k can only be the one next to i * (most - 1) / (n - 1).
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    near = F.floor(F.col("_i") / step)
    hit = reduce(lambda a, b: a | b, [F.bround((near + d) * step, 0) == F.col("_i") for d in (0, 1)])
    return ranked.where((F.col("_n") <= most) | hit).drop("_i", "_n")


def fill_slots(first_list: DataFrame, second_list: DataFrame, text: str, key: str, *, first: int, total: int) -> DataFrame:
    """Up to ``first`` rows of one list, then the other's best rows with other texts, up to ``total``."""
    best = [F.desc("score"), key]
    a = first_list.orderBy(*best).limit(first).withColumn("_tier", F.lit(0))
    b = second_list.join(a.select(text), text, "left_anti").orderBy(*best).limit(total).withColumn("_tier", F.lit(1))
    return a.unionByName(b.select(*a.columns)).orderBy("_tier", *best).limit(total).drop("_tier")


def quota_sample(df: DataFrame, *, least: int, total: int) -> DataFrame:
    """doc_id, category, place: ``least`` rows of each category, then the best of the rest, one row for each origin.

    Each category's and the whole's candidates are cut to the best ``total`` origins first, which bounds the final fold
    by categories times ``total``, whatever the table's size.
    """
    best = [F.desc("score"), "doc_id"]
    lead = df.withColumn("_o", F.row_number().over(W.partitionBy("origin").orderBy(*best))).where("_o = 1").drop("_o")
    few = lead.withColumn("_c", F.row_number().over(W.partitionBy("category").orderBy(*best))).where(F.col("_c") <= total)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True])
        taken = pdf.groupby("category", sort=True).head(least).sort_values(["category", "score", "doc_id"], ascending=[True, False, True]).head(total)
        rest = pdf[~pdf.doc_id.isin(taken.doc_id)].head(max(0, total - len(taken)))
        out = pd.concat([taken, rest])[["doc_id", "category"]].reset_index(drop=True)
        return out.assign(place=range(1, len(out) + 1))

    return few.select("doc_id", "category", "score").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: fold(pdf), "doc_id long, category string, place long")
