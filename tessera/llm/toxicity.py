"""Operator 7: toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lowers case, maps look-alike letters of other scripts to Latin, strips accents, maps digits and signs that stand
for letters, and parts words by single spaces. The lexicon holds whole words and stems (word beginnings). A small
built-in list is always in it; the rest and all weights are learned from labelled rows outside the held-out fold as
log-odds of toxic against other documents, for every term whose share differs beyond chance (a likelihood-ratio test).
Hits inside exception phrases don't count. A logistic model of the summed weights, as such and per word, turns hits
into a score. Texts are folded and matched a piece at a time and hits are summed as they come, so a text of any length
takes time in proportion to it and little memory.

Null and empty texts have no hits and get the score of such texts; repeated rows come out as often as they came in;
without usable labels the built-in list and fixed coefficients serve; an empty table gives an empty result; labels,
language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, slices, text_of
from .supervised import fit_logistic, held_out, labelled_sample, sigmoid

#: Always in the lexicon, with this weight until labels say otherwise.
BUILT_IN = "idiot moron stupid loser scum worthless pathetic disgusting retard bastard bitch asshole dumbass imbecile vermin idiota imbecil estupido basura asqueroso arschloch dummkopf abschaum widerlich trottel connard salope abruti ordure debile".split()
BUILT_IN_WEIGHT = 3.0
#: Harmless phrases with lexicon words in them.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "loser bracket", "losers bracket", "bastard file", "bastard sword", "scum line", "pond scum")
STEMS = (4, 5, 6)
LEAST_WEIGHT = 2.5
#: A learned term stands in this many documents of the toxic sample at least, and its likelihood ratio (G squared) is as
#: high as one term in ten thousand has by chance.
LEAST_DOCUMENTS = 4
LEAST_RATIO = 15.0
#: Characters that are folded at once, and terms that a task counts before it hands them on.
PIECE = 1 << 19
COUNTED = 400_000

#: Letters of other scripts that look like these.
LOOKALIKES = {"a": "аαɑ", "b": "вьβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "пη", "o": "оοσ", "p": "рρ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ"}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """A translation table that is filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        out = "".join(SUBSTITUTES.get(x, x) for x in out)
        out = out if out.isalnum() else " " if not unicodedata.combining(c) and unicodedata.category(c) != "Cf" else ""
        self[code] = out
        return out


FOLD = _Fold({ord(c): to for to, same in LOOKALIKES.items() for c in same})
_INNER = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")
_SPELLED = re.compile(r"(?<= )(?:\w ){3,}")


def fold(text: str) -> str:
    """The folded words, each with a space on both sides; words spelled out letter by letter are drawn together."""
    out = f" {_INNER.sub('i', text.lower()).translate(FOLD)} "
    return _SPELLED.sub(lambda m: m[0].replace(" ", "") + " ", out) if _SPELLED.search(out) else out


_SPARED = re.compile("(?<= )(?:" + "|".join(EXCEPTIONS) + ")(?= )")
_FIRST = {w for e in EXCEPTIONS for w in e.split()[:-1]}
#: Between two words of two letters or more, so that nothing spelled out is parted.
_CUT = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿα-ωА-я]{2})\s(?=[A-Za-zÀ-ÖØ-öø-ÿα-ωА-я]{2})")


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``most`` characters that can be folded and matched on their own."""
    at = 0
    while len(text) - at > most:
        for m in _CUT.finditer(text, at + most):
            before = fold(text[max(m.start() - 20, at) : m.start()]).split()
            if not before or before[-1] not in _FIRST:  # an exception phrase stays whole
                yield text[at : m.end()]
                at = m.end()
                break
        else:
            break
    yield text[at:]


def terms(folded: str) -> set[str]:
    """The distinct words (closed by a space) and stems (open) of a folded text, both opened by a space."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}


def term_counts(sample: DataFrame) -> DataFrame:
    """term, toxic and other: documents of the sample with each term, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                (bad if label else good).update(set().union(*(terms(fold(x)) for x in pieces(text))))
                if len(bad) + len(good) > COUNTED:
                    yield handed_on(bad, good)
                    bad, good = Counter(), Counter()
        yield handed_on(bad, good)

    def handed_on(bad: Counter, good: Counter) -> pa.RecordBatch:
        rows = list(bad | good)
        return pa.RecordBatch.from_pydict({"term": pa.array(rows, pa.string()), "toxic": pa.array([bad[t] for t in rows], pa.int64()), "other": pa.array([good[t] for t in rows], pa.int64())})

    return sample.mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights by term: log-odds of the terms that mark toxic documents, a stem in place of the words it begins."""
    n_bad, n_good = (sample.where(c).count() for c in ("_label = 1", "_label = 0"))
    found = {f" {w} ": BUILT_IN_WEIGHT for w in BUILT_IN}
    if not n_bad or not n_good:
        return found
    weight = F.log((F.col("toxic") + 0.5) / (n_bad + 1.0)) - F.log((F.col("other") + 0.5) / (n_good + 1.0))
    both = F.col("toxic") + F.col("other")
    cells = ((F.col("toxic"), both * n_bad), (F.col("other"), both * n_good), (n_bad - F.col("toxic"), (n_bad + n_good - both) * n_bad), (n_good - F.col("other"), (n_bad + n_good - both) * n_good))
    ratio = sum((F.when(n > 0, 2 * n * F.log(n * (n_bad + n_good) / expected)).otherwise(0.0) for n, expected in cells), F.lit(0.0))
    rows = term_counts(sample).where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("weight", weight).where((F.col("weight") >= LEAST_WEIGHT) & (ratio >= LEAST_RATIO))
    rows = rows.collect()  # each stands in four documents of a sample of bounded size
    kept: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"].rstrip()), r["term"])):
        t = r["term"]
        if not any(kept.get(t[:k], -9.0) >= r["weight"] - 0.7 for k in range(5, len(t.rstrip()) + 1)):
            kept[t] = r["weight"]
    return found | kept


def automaton(lexicon: dict[str, float]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for t, w in lexicon.items():
        out.add_word(t, (t, w))
    out.make_automaton()
    return out


def features(text: str, matcher: ahocorasick.Automaton, most: int = PIECE) -> tuple[float, float, float]:
    """Summed weights (log), summed weights a hundred words (log), and distinct terms hit (log)."""
    total, spaces, seen = 0.0, 2, set()
    for piece in pieces(text, most):
        folded = fold(piece)
        spaces += folded.count(" ") - 2
        for _, (t, w) in matcher.iter(_SPARED.sub("", folded) if _SPARED.search(folded) else folded):
            total += w
            seen.add(t)
    return math.log1p(total), math.log1p(100 * total / (10 + spaces)), math.log1p(len(seen))


def _featured(lexicon: dict[str, float], keep: list[str]):
    """A function for mapInArrow: the features of ``_text``, beside the columns to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(lexicon)
        for batch in batches:
            for piece in slices(batch, "_text"):
                x = np.array([features(t, matcher) for t in piece.column("_text").to_pylist()], np.float64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *(pa.array(x[:, k]) for k in range(3))], names=[*keep, "x0", "x1", "x2"])

    return run


class Toxicity:
    """A trained scorer: the lexicon and the logistic weights."""

    #: Coefficients where labels are missing: a hit in 20 words or several in more.
    DEFAULT = np.array([0.5, 1.5, 0.5, -4.0])

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Toxicity:
        sample = labelled_sample(docs, labels, label, key=key, text=text)
        lexicon = learn_lexicon(sample)
        rows = sample.select("_text", F.col("_label").cast("long").alias("_label")).mapInArrow(_featured(lexicon, ["_label"]), "_label long, x0 double, x1 double, x2 double").toPandas()
        drop_written(sample)
        y = rows["_label"].to_numpy(np.float64)
        order = np.lexsort(rows.to_numpy(np.float64).T)  # sums don't depend on the order in which rows came
        return cls(lexicon, fit_logistic(rows[["x0", "x1", "x2"]].to_numpy(np.float64)[order], y[order]) if len(set(y)) == 2 else cls.DEFAULT)

    def score(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every document."""
        featured, weights = _featured(self.lexicon, ["doc_id"]), self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in featured(batches):
                x = np.column_stack([np.asarray(batch.column(f"x{k}")) for k in range(3)])
                p = sigmoid(x @ weights[:3] + weights[3])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("_text"))
        return rows.mapInArrow(run, "doc_id long, score double, predicted int")

    def keep_clean(self, docs: DataFrame, *, text: str = "text") -> DataFrame:
        """The documents that aren't predicted toxic, unchanged; texts are scored where they are, nothing is shuffled."""
        lexicon, weights, schema = self.lexicon, self.weights, docs.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = automaton(lexicon)
            for batch in batches:
                for piece in slices(batch, text):
                    x = np.array([features(t or "", matcher) for t in piece.column(text).to_pylist()], np.float64).reshape(-1, 3)
                    yield piece.filter(pa.array(sigmoid(x @ weights[:3] + weights[3]) < 0.5))

        return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: scores every document; labels of the held-out fold aren't learned from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = Toxicity.train(docs, labels).score(docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
