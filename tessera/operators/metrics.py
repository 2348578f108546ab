"""Ranking and classification metrics as grouped sums over ranked candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, window: list[str], threshold: float = 0.5) -> DataFrame:
    """Adds rank (by score, then id) within each window, and selected (score at the threshold or above)."""
    order = W.partitionBy(*window).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("selected", F.col("score") >= threshold)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def confusion(df: DataFrame, window: list[str]) -> DataFrame:
    """Counts, precision, recall, F1 and prevalence by window; ``df``: positive, selected."""
    p, s = F.col("positive"), F.col("selected")
    c = df.groupBy(*window).agg(F.count(F.lit(1)).alias("n"), F.count_if(p & s).alias("tp"), F.count_if(~p & s).alias("fp"), F.count_if(p & ~s).alias("fn"), F.count_if(~p & ~s).alias("tn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select(*c.columns, precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ratio(F.col("tp") + F.col("fn"), F.col("n")).alias("prevalence"))


def ranking_quality(df: DataFrame, window: list[str]) -> DataFrame:
    """average_precision (a step for each distinct score) and roc_auc (by mean ranks of ties); null for one class alone.

    Rows are grouped to distinct scores first, so the windows run over scores, not rows.
    """
    by_score = df.groupBy(*window, "score").agg(F.count_if("positive").alias("p"), F.count(F.lit(1)).alias("n"))
    down = W.partitionBy(*window).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    s = by_score.withColumn("tp", F.sum("p").over(down)).withColumn("seen", F.sum("n").over(down))
    below = F.col("total") - F.col("seen")  # rows with a lower score
    totals = df.groupBy(*window).agg(F.count_if("positive").alias("pos"), F.count(F.lit(1)).alias("total"))
    s = s.join(totals, window)
    rank_sum = F.sum(F.col("p") * (below + (F.col("n") + 1) / 2.0))
    out = s.groupBy(*window, "pos", "total").agg(F.sum(F.col("p") * F.col("tp").cast("double") / F.col("seen")).alias("gain"), rank_sum.alias("ranks"))
    neg = F.col("total") - F.col("pos")
    both = (F.col("pos") > 0) & (neg > 0)
    auc = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2.0) / (F.col("pos") * neg)
    return out.select(*window, F.when(both, F.col("gain") / F.col("pos")).alias("average_precision"), F.when(both, auc).alias("roc_auc"))


def at_k(df: DataFrame, window: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall and precision among the first k of each window; and pooled over windows, hits and totals summed."""
    hits = df.groupBy(*window).agg(F.count_if("positive").alias("pos"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("positive") & (F.col("rank") <= k)).alias(f"h{k}") for k in ks])
    rows = [hits.select(*window, F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), "pos", F.least(F.lit(k).cast("long"), F.col("n")).alias("shown")) for k in ks]
    long = reduce(DataFrame.unionByName, rows)
    return long.select(*window, "k", "hits", ratio(F.col("hits"), F.col("pos")).alias("recall"), ratio(F.col("hits"), F.col("shown")).alias("precision"))


def pooled_at_k(df: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """The same over all windows together; ``df``: positive, rank (within its window)."""
    sums = df.agg(F.count_if("positive").alias("pos"), *[F.count_if(F.col("positive") & (F.col("rank") <= k)).alias(f"h{k}") for k in ks])
    return reduce(DataFrame.unionByName, [sums.select(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), ratio(F.col(f"h{k}"), F.col("pos")).alias("recall")) for k in ks])


def rank_stats(df: DataFrame, window: list[str]) -> DataFrame:
    """Mean and exact median rank of the positives."""
    return df.where("positive").groupBy(*window).agg(F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"))


def class_weights(df: DataFrame, window: list[str]) -> DataFrame:
    """n / (2 * n of the class) for both classes; null where one is missing."""
    c = df.groupBy(*window).agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("pos"))
    return c.select(*window, ratio(F.col("n"), 2 * F.col("pos")).alias("positive_weight"), ratio(F.col("n"), 2 * (F.col("n") - F.col("pos"))).alias("negative_weight"))


def coverage(wanted: DataFrame, found: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """By bucket: how many of the wanted rows are found."""
    f = found.select(*keys).distinct().withColumn("_hit", F.lit(True))
    j = wanted.join(f, keys, "left")
    return j.groupBy(bucket).agg(F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("_hit").isNotNull()).alias("hits")).withColumn("recall", ratio(F.col("hits"), F.col("wanted")))


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def mean_importance(df: DataFrame, most: int) -> DataFrame:
    """Features by mean importance over folds, ties by name, and in how many folds they occur; ``df``: fold, feature, importance."""
    g = df.groupBy("feature").agg(F.avg("importance").alias("importance"), F.countDistinct("fold").alias("folds_seen"))
    return g.orderBy(F.desc(F.round("importance", 9)), "feature").limit(most)


def family_shares(importance: DataFrame, families: DataFrame) -> DataFrame:
    """family, importance and share: the features' importances summed by family; 0 where the whole is 0, null without one.

    ``importance``: feature, importance. ``families``: feature, family, one row for each feature.
    """
    sums = importance.join(families, "feature", "left").groupBy(F.coalesce("family", F.lit("other")).alias("family")).agg(F.sum("importance").alias("importance"))
    whole = sums.agg(F.sum("importance").alias("_whole"))
    share = F.when(F.col("_whole") != 0, F.col("importance") / F.col("_whole")).otherwise(F.lit(0.0))
    return sums.crossJoin(F.broadcast(whole)).select("family", "importance", share.alias("share"))  # one row


def missed_by_all(df: DataFrame) -> DataFrame:
    """Gold rows that no model selects; ``df``: id, model, selected."""
    return df.groupBy("id").agg(F.bool_or("selected").alias("_any")).where(~F.col("_any")).select("id")


def deltas(base: DataFrame, now: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """now - base by cell, and the direction; null where a side lacks it."""
    j = base.select(*keys, F.col(metric).alias("before")).join(now.select(*keys, F.col(metric).alias("after")), keys, "full")
    d = F.col("after") - F.col("before")
    return j.withColumn("delta", d).withColumn("moved", F.when(d > 0, "up").when(d < 0, "down").when(d == 0, "same"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
