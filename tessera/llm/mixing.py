"""Operator 3: mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its key; a source's budget is met by taking the documents whose hash is below a threshold,
so thresholds for growing budgets are nested, and no sort is needed. Thresholds come from histograms: words by source
and leading hash digits; the bucket in which the budget ends is refined by the next digits, and only its documents
are read again for that, until it holds a single hash.

A target of T words from a source of S words takes every document floor(T / S) times, and those below the threshold of
the rest once more. Targets stop at ``most`` times their source's size; what is above is shared again by weight.

The threshold keeps a document whose middle lies below the budget, so a source misses its target by at most half of
one document. Documents of equal key share a hash and are taken together. Null text has no words, a null source is a
source of its own (last in order), a null key hashes as the empty string; empty tables give empty results. Source totals
and thresholds are one row for each source; joins to them broadcast only where the written table is small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, unused, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Ranges that sources are numbered in.
RANGES = 200
#: Hexadecimal digits of the hash, and how many of them each histogram adds.
DIGITS, STEP = 15, 3
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash_digits(key: Column) -> Column:
    """The leading hexadecimal digits of the key's MD5: a uniform hash that any SQL engine can repeat."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, DIGITS)


def weighted(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds to each source its weight: they repeat over the sources in order, null last.

    Sources are numbered within ranges, cut at up to ``RANGES`` of them, so that many of them aren't one task's; which
    ones cut decides on balance alone.
    """
    cuts = sorted(r["source"] for r in sizes.where("source IS NOT NULL").orderBy(F.xxhash64("source"), "source").limit(RANGES).collect())
    inside = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("source"))) if cuts else F.lit(0)
    rows = sizes.withColumn("part", F.when(F.col("source").isNull(), F.lit(len(cuts) + 1)).otherwise(inside))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    counts = counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int"))
    return rows.join(counts, "part").withColumn("weight", weight).drop("part", "before")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets by source: shares by weight of the whole budget; nothing exceeds ``most`` times its source's size.

    At a common level L each source gets min(weight * L, most * size). The level starts without bounds and rises as those
    that reach their bound give the excess to the others, a grouped sum each time, until no more reach theirs.
    """
    s = written(weighted(sizes, weights).withColumn("bound", F.lit(most) * F.col("source_size")), "mix-sources")
    level, closed = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("bound")
        total, n, spent, waiting = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("bound"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == closed or not waiting:
            break
        level, closed = (share * total - spent) / waiting, n
    bound = F.col("bound").cast("double")
    target = bound if not waiting else F.when(F.col("weight") * F.lit(level) >= F.col("bound"), bound).otherwise(F.col("weight") * F.lit(level))
    return s.select("source", "source_size", target.alias("target"))


def same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """By source: ``below``, the hash digits under which a document is taken once more, for the words that ``need`` asks.

    ``rows``: source, size, digits. ``wanted``: source, source_size, target, times, need. A threshold grows by ``STEP``
    digits a round. Digits below it are taken; its own bucket is the one that the next round looks into.
    """
    state = written(wanted.withColumn("below", F.lit("")).withColumn("got", F.lit(0).cast("long")).withColumn("done", F.lit(False)), "mix-state")
    for digits in range(STEP, DIGITS + 1, STEP):
        s = state.where(~F.col("done")).select(F.col("source").alias("_s"), "below")
        inside = rows.join(s, same_source("source", "_s") & F.col("digits").startswith(F.col("below")))
        counts = inside.groupBy("source", F.substring("digits", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("source").orderBy("bucket")
        counts = counts.withColumn("before", F.sum("words").over(order) - F.col("words")).withColumn("last", F.lead("bucket").over(order).isNull())
        j = counts.join(state.select(F.col("source").alias("_s"), "need", "got"), same_source("source", "_s"))
        # The bucket where the budget ends: more is wanted than all buckets before it hold.
        at = j.where((F.col("got") + F.col("before") < F.col("need")) & ((F.col("got") + F.col("before") + F.col("words") >= F.col("need")) | F.col("last")))
        at = at.select(F.col("source").alias("_s"), "bucket", "before", "words", "n")
        nxt = state.join(at, same_source("source", "_s"), "left")
        single = F.col("n") == 1
        # A single document is taken where its middle lies below the budget; then the threshold lies past its bucket.
        taken = single & (F.col("got") + F.col("before") + F.col("words") / 2 <= F.col("need"))
        nxt = nxt.select(
            "source", "source_size", "target", "times", "need",
            F.when(F.col("bucket").isNull(), F.col("below")).when(taken, F.concat("bucket", F.lit("g"))).otherwise(F.col("bucket")).alias("below"),
            F.when(F.col("bucket").isNull(), F.col("got")).otherwise(F.col("got") + F.col("before") + F.when(taken, F.col("words")).otherwise(0)).cast("long").alias("got"),
            F.when(F.col("bucket").isNull(), F.lit(True)).otherwise(single | F.lit(digits >= DIGITS)).alias("done"),
        )
        state, old = written(nxt, "mix-state"), state
        drop_written(old)
        if state.where(~F.col("done")).isEmpty():
            break
    return state


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds to each document, last, _size, _source_size, _target (its source's) and _times, how often the mix takes it.

    Where the input has a column of such a name it stays, and the added one gets more underscores in front.
    """
    slim = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hash_digits(F.col(key)).alias("digits"))
    rows = written(slim, "mix-rows")
    want = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    want = want.withColumn("times", times).withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    state = thresholds(rows, want)
    drop_written(rows)
    size, source_size, target, taken, of, base, below, digits = unused(docs.columns, "_size", "_source_size", "_target", "_times", "_of", "_base", "_below", "_digits")
    s = state.select(F.col("source").alias(of), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("times").alias(base), F.col("below").alias(below))
    out = docs.withColumns({size: word_count(F.col(text)), digits: hash_digits(F.col(key))}).join(s, F.col(source).eqNullSafe(F.col(of)))
    return out.select(*docs.columns, size, source_size, target, (F.col(base) + (F.col(digits) < F.col(below)).cast("int")).alias(taken))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: mixes all documents to 150 % of their words, by weights 5, 2, 1."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS digits
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS bound FROM s),
r AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(bound) OVER before, 0) AS spent, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS waiting
  FROM w WINDOW before AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by((budget - spent) / waiting, spent) AS common FROM r WHERE (budget - spent) / waiting * weight < bound),
t AS (SELECT source, source_size, CASE WHEN common IS NULL OR weight * common >= bound THEN bound::DOUBLE ELSE weight * common END AS target FROM r, l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 1 END AS times FROM t),
o AS (
  SELECT d.*, n.source_size, n.target, n.times, n.target - n.times * n.source_size AS need,
         sum(size) OVER (PARTITION BY d.source ORDER BY digits) AS upto
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       size * (times + CASE WHEN need > 0 AND upto - size / 2 <= need THEN 1 ELSE 0 END)::BIGINT AS taken
FROM o
"""
