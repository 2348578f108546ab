"""Operator 9: a quality classifier with hierarchical empirical Bayes over sites.

A logistic model of surface features gives each document's own evidence. Sites (hosts) and sections of sites (paths)
get posterior rates of good documents: summed evidence of all their documents, shrunk towards the level above. The
strength of each prior is the one that the spread of rates suggests (method of moments), so sparse sites stay near the
global rate and large ones keep their own. A document's score multiplies its odds by the odds of its section relative
to the global odds.

Levels are grouped sums; their tables (a row for each site or section) are written, so joins broadcast them only where
they are small. The model is fitted on a bounded sample of labelled rows outside the held-out fold; rates cover all
documents. Null and empty texts have the features of the empty text; null hosts and paths are sites of their own;
repeated rows come out as often as they came in; without usable labels the own evidence is 0.5 everywhere.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, slices, text_of, written
from .supervised import fit_logistic, held_out, labelled_sample, sigmoid

NAMES = ("length", "words", "upper", "digits", "signs", "spaces", "other", "word_size", "distinct", "commonest", "ended", "line_words", "repeated_lines", "bars", "longest", "squeeze", "capitalised")
_KINDS = np.zeros(256, np.int64)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58] = 1, 2, 3
_KINDS[[9, 10, 11, 12, 13, 32]], _KINDS[128:] = 5, 6
_KINDS[_KINDS == 0] = 4


def features(text: str) -> list[float]:
    """Shares and sizes of characters, words and lines, in the order of ``NAMES``; all 0 for the empty text."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(kinds[1] + kinds[2] + kinds[6], 1e-9)
    return [
        np.log1p(len(raw)) / 10, np.log1p(len(words)) / 10, kinds[1] / letters, kinds[3], kinds[4], kinds[5], kinds[6],
        sum(map(len, words)) / len(words) / 10, len(counts) / len(words), counts.most_common(1)[0][1] / len(words),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), np.log1p(len(words) / len(lines)) / 5,
        1 - len(set(lines)) / len(lines), raw.count(b"|") / len(words), np.log1p(max(map(len, counts))) / 5,
        len(zlib.compress(raw, 1)) / (len(raw) + 20), sum(65 <= w[0] <= 90 for w in words) / len(words),
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    """Features and their squares, so that both extremes of a share can count against a document."""
    x = np.array([features(t or "") for t in texts], np.float64).reshape(-1, len(NAMES))
    return np.hstack([x, x * x])


class Quality:
    """The document classifier: logistic weights over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> Quality:
        sample = labelled_sample(docs, labels, label, key=key, text=text)
        n = 2 * len(NAMES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, "_text"):
                    x = _matrix(piece.column("_text").to_pylist())
                    yield pa.RecordBatch.from_arrays([piece.column("_label"), pa.array(list(x), pa.list_(pa.float64()))], names=["_label", "x"])

        rows = sample.select("_text", F.col("_label").cast("long").alias("_label")).mapInArrow(run, "_label long, x array<double>").toPandas()
        drop_written(sample)
        x = np.array([*rows["x"]], np.float64).reshape(-1, n)
        y = rows["_label"].to_numpy(np.float64)
        order = np.lexsort(np.column_stack([x, y]).T)
        x, y = x[order], y[order]
        if len(set(y)) < 2:
            return cls(np.zeros(n), np.ones(n), np.zeros(n + 1))
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        return cls(mean, scale, fit_logistic((x - mean) / scale, y))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        x = (_matrix(texts) - self.mean) / self.scale
        return np.clip(sigmoid(x @ self.weights[:-1] + self.weights[-1]), 1e-6, 1 - 1e-6)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _moments(rates: DataFrame, prior: Column) -> DataFrame:
    """One row: strength, the prior's weight in documents, from the spread of rates around their priors beyond chance."""
    big = rates.where("n >= 2").withColumn("p", prior)
    spread = F.greatest(F.avg((F.col("good") / F.col("n") - F.col("p")) ** 2 - F.col("p") * (1 - F.col("p")) / F.col("n")), F.lit(1e-4))
    return big.agg(F.least(F.greatest(F.coalesce(F.avg(F.col("p") * (1 - F.col("p"))) / spread - 1, F.lit(10.0)), F.lit(1.0)), F.lit(1e4)).alias("strength"))


def posterior_rates(evidence: DataFrame) -> DataFrame:
    """host, path, host_rate, path_rate and global_rate from (host, path, own): grouped sums, shrunk level by level."""
    paths = written(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("good")), "quality-paths")
    total = paths.agg((F.sum("good") / F.sum("n")).alias("global_rate")).first()["global_rate"]
    if total is None:
        return paths.select("host", "path", *(F.lit(None).cast("double").alias(c) for c in ("host_rate", "path_rate", "global_rate")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    m = _moments(hosts, F.lit(total)).first()["strength"]
    hosts = written(hosts.select(F.col("host").alias("_h"), ((F.col("good") + m * F.lit(total)) / (F.col("n") + m)).alias("host_rate")), "quality-hosts")
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    k = _moments(joined, F.col("host_rate")).first()["strength"]
    out = joined.select("host", "path", "host_rate", ((F.col("good") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"), F.lit(total).alias("global_rate"))
    return written(out, "quality-rates")


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, own (the document's evidence), host_rate, path_rate, score and predicted of every document."""
    model = Quality.train(docs, labels, key=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                own = model.predict(piece.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("host"), piece.column("path"), pa.array(own)], names=["doc_id", "host", "path", "own"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), text_of(docs, text).alias("_text"))
    own = written(rows.mapInArrow(run, "doc_id long, host string, path string, own double"), "quality-own")
    rates = posterior_rates(own).withColumnsRenamed({"host": "_h", "path": "_p"})
    out = own.join(rates, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    lift = logit(F.col("path_rate")) - logit(F.col("global_rate"))
    score = 1 / (1 + F.exp(-(logit(F.col("own")) + lift)))
    return out.select("doc_id", "own", "host_rate", "path_rate", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: scores every document; its source is the site, the languages of a source are the sections."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality(docs, labels, F.col("source"), F.col("lang"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.col("own").alias("own_score"), "host_rate", "path_rate")
