"""Learned scores: features, balanced logistic models, grouped cross-validation, calibration, one-to-one matching."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["length", "upper", "signs"]


def document_features(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """id, group, label and a few shares of characters of each labelled document."""
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / n
    d = documents.join(labels, "doc_id").where(F.col("text").isNotNull())
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), F.col("quality").cast("double").alias("label"), F.log1p(F.length("text")).alias("length"), share("[A-Z]").alias("upper"), share("[^\\w\\s]").alias("signs"))


def _fit(train: DataFrame, columns: list[str]):
    """A scaled logistic model with weights that balance the classes; null if a class is missing."""
    c = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    if not c["p"] or c["p"] == c["n"]:
        return None
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, c["n"] / (2 * c["p"])).otherwise(c["n"] / (2 * (c["n"] - c["p"]))))
    assembled = VectorAssembler(inputCols=columns, outputCol="raw").transform(weighted)
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(assembled)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1.0 / c["n"], elasticNetParam=0.0, standardization=False, maxIter=50).fit(scaler.transform(assembled))
    return scaler, model


def _fit_trees(train: DataFrame, columns: list[str], trees: int):
    """Boosted trees of depth 3 with weights that balance the classes; null if a class is missing."""
    c = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    if not c["p"] or c["p"] == c["n"]:
        return None
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, c["n"] / (2 * c["p"])).otherwise(c["n"] / (2 * (c["n"] - c["p"]))))
    return GBTClassifier(featuresCol="raw", labelCol="label", weightCol="weight", maxDepth=3, maxIter=trees, stepSize=0.1, minInstancesPerNode=20, seed=42).fit(VectorAssembler(inputCols=columns, outputCol="raw").transform(weighted))


def leave_group_out_trees(df: DataFrame, folds: int, trees: int = 120) -> DataFrame:
    """As ``leave_group_out``, by boosted trees."""
    from pyspark.ml.functions import vector_to_array

    df = df.withColumn("fold", F.pmod(F.crc32("group"), F.lit(folds)).cast("int")).cache()
    out = []
    for k in range(folds):
        model, test = _fit_trees(df.where(F.col("fold") != k), FEATURES, trees), df.where(F.col("fold") == k)
        score = F.lit(0.5) if model is None else F.round(vector_to_array("probability")[1], 6)
        scored = test if model is None else model.transform(VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(test))
        out.append(scored.select("id", "fold", score.alias("score")))
    return reduce(DataFrame.unionByName, out)


def leave_group_out(df: DataFrame, folds: int) -> DataFrame:
    """id, fold and score of every row, from a model that has seen no row of its fold; groups are dealt to folds whole."""
    df = df.withColumn("fold", F.pmod(F.crc32("group"), F.lit(folds)).cast("int"))
    out = []
    for k in range(folds):
        fitted = _fit(df.where(F.col("fold") != k), FEATURES)
        test = df.where(F.col("fold") == k)
        if fitted is None:
            out.append(test.select("id", "fold", F.lit(0.5).alias("score")))
            continue
        scaler, model = fitted
        scored = model.transform(scaler.transform(VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(test)))
        from pyspark.ml.functions import vector_to_array

        out.append(scored.select("id", "fold", F.round(vector_to_array("probability")[1], 6).alias("score")))
    return reduce(DataFrame.unionByName, out)


def calibrate(df: DataFrame, columns: tuple[str, str] = ("length", "signs"), least: int = 50) -> DataFrame:
    """One row: the weights of two scores; null for fewer rows than ``least`` or one class alone."""
    spark = df.sparkSession
    n = df.count()
    fitted = _fit(df, list(columns)) if n >= least else None
    if fitted is None:
        return spark.createDataFrame([(n, None, None)], "n long, first double, second double")
    a, b = (abs(float(x)) for x in fitted[1].coefficients)
    total = (a + b) or 1.0
    return spark.createDataFrame([(n, round(a / total, 4), round(b / total, 4))], "n long, first double, second double")


MATCH = "array<struct<gold_start:long,gold_stop:long,found_start:long,found_stop:long,shared:long>>"


def _matched(gold: pd.Series, found: pd.Series) -> pd.Series:
    """Pairs of the spans of each window, both as start * 2**32 + end, largest overlap first, each span once."""
    spans = lambda packed: [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in sorted(packed)]

    def one(a, b):
        a, b, used, out = spans(a), spans(b), set(), []
        pairs = [(-shared, x, y) for x in a for y in b if (shared := min(x[1], y[1]) - max(x[0], y[0])) > 0]
        for less, x, y in sorted(pairs):
            if (0, x) not in used and (1, y) not in used:
                used |= {(0, x), (1, y)}
                out.append((*x, *y, -less))
        return [dict(zip(("gold_start", "gold_stop", "found_start", "found_stop", "shared"), row, strict=True)) for row in out]

    return pd.Series([one(a, b) for a, b in zip(gold, found, strict=True)])


def greedy_matches(gold: DataFrame, found: DataFrame, window: str) -> DataFrame:
    """window, gold and found starts and ends, shared: pairs of a window matched one to one, largest overlap first.

    A window's spans are a bounded number; the choice depends on earlier ones, so it is made on a window's two lists.
    """
    packed = (F.col("start") * F.lit(1 << 32) + F.col("end")).alias("span")
    rows = gold.select(window, F.lit(0).alias("side"), packed).union(found.select(window, F.lit(1), packed))
    side = lambda k: F.collect_set(F.when(F.col("side") == k, F.col("span")))
    both = rows.groupBy(window).agg(side(0).alias("gold"), side(1).alias("found")).where((F.size("gold") > 0) & (F.size("found") > 0))
    return both.select(F.col(window).alias("window"), F.inline(F.pandas_udf(_matched, MATCH)("gold", "found")))
