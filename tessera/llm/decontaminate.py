"""Operator 8: benchmark decontamination, in DataFrame functions only.

The test items' word windows become a table of distinct windows with a 64-bit hash each. The documents' windows are
hashed the same way and meet it in a hash join; hits are verified word by word. Where the window table is small (its
size is measured first) it is broadcast, so no text is shuffled: only hits and one slim row per document are. Beyond
that, hashes are shuffled, and the words of those documents that were hit by hash are fetched to verify. The result is
the same either way.

Null or empty texts and items have no words and no windows; repeated rows come out as often as they came in, rows with
equal id and text alike; an empty benchmark hits nothing; a null item_id counts as one item and is written as the empty
string; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused, written

WINDOW = 10
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words and what parts them, before A-Z are lowered.
CASED_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of the window table up to which it is broadcast: about 200 bytes each.
BROADCAST_WINDOWS = 250_000


def lowered(text: Column) -> Column:
    """The text, A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of letters, digits and anything beyond ASCII."""
    return F.array_remove(F.split(lowered(text), BREAK), "")


def _windows(row: Column, n: Column, size: int | Column, make) -> Column:
    """make(slice) for each window of ``size`` words; none if there are fewer."""
    size = F.lit(size) if isinstance(size, int) else size
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: make(F.slice(row, i, size)))
    return F.when(n >= size, every)


def benchmark_windows(benchmark: DataFrame, *, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: hash, size, win (its words) and items (the ids of the items it occurs in)."""
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    items = items.withColumn("n", F.size("w")).where("n > 0").withColumn("size", F.least("n", F.lit(window)))
    rows = items.select("item", "size", F.explode(_windows(F.col("w"), F.col("n"), F.col("size"), lambda s: s)).alias("win"))
    return rows.groupBy("size", "win").agg(F.collect_set("item").alias("items")).withColumn("hash", F.xxhash64("win"))


def hits(docs: DataFrame, windows: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = BROADCAST_WINDOWS) -> DataFrame:
    """For each document (id, and tie: a hash of its text) with hits: spans (start, size; words from 0) and items."""
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]  # at most WINDOW numbers
    slim = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tie"), words(F.col(text)).alias("w"))
    slim = slim.withColumn("n", F.size("w"))
    small = windows.count() <= most

    def rows_of(make) -> Column:
        blocks = [F.coalesce(_windows(F.col("w"), F.col("n"), s, make), F.array().cast("array<bigint>")) for s in sizes]
        return F.concat(*blocks) if len(blocks) > 1 else blocks[0]

    if not sizes:
        return slim.where(F.lit(False)).select("id", "tie", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"))).alias("spans"), F.array(F.lit("")).alias("items"))
    # The blocks of the sizes follow each other in the row of hashes; a hit's size tells where its block starts.
    before, start = F.lit(0), F.lit(None).cast("int")
    for s in sizes:
        start = F.when(F.col("size") == s, F.col("at") - before).otherwise(start)
        before = before + F.greatest(F.col("n") - s + 1, F.lit(0))
    own = ["w"] if small else []
    found = slim.select("id", "tie", "n", *own, F.posexplode(rows_of(lambda s: F.xxhash64(s))).alias("at", "hash"))
    found = found.join(F.broadcast(windows) if small else windows, "hash").withColumn("start", start).where("start >= 0")
    if not small:
        texts = slim.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "w").dropDuplicates(["_id", "_tie"])
        found = found.join(texts, F.col("id").eqNullSafe(F.col("_id")) & F.col("tie").eqNullSafe(F.col("_tie")))
    found = found.where(F.slice("w", F.greatest(F.col("start") + 1, F.lit(1)), F.col("size")) == F.col("win"))
    return found.groupBy("id", "tie").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def hit_words(spans: Column) -> Column:
    """The numbers of the words inside any of the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every document's id, tie, n_words, n_hit, n_items, item ids and hit words."""
    windows = written(benchmark_windows(benchmark, text=text, window=window), "windows")
    found = written(hits(docs, windows, key=key, text=text), "hits")
    found = found.select(F.col("id").alias("__t_id"), F.col("tie").alias("__t_tie"), "items", hit_words(F.col("spans")).alias("hit"))
    every = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tie"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    out = every.join(found, F.col("id").eqNullSafe(F.col("__t_id")) & (F.col("tie") == F.col("__t_tie")), "left")
    items, hit = (F.coalesce(F.col(c), F.array().cast(t)) for c, t in (("items", "array<string>"), ("hit", "array<int>")))
    return out.select("id", "tie", "n_words", F.size(hit).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.array_sort(items).alias("items"), hit.alias("hit"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without any hit, unchanged."""
    windows = written(benchmark_windows(benchmark, text=text, window=window), "windows")
    found = written(hits(docs, windows, key=key, text=text), "hits")
    of, tie = unused(docs.columns, "_of", "_tie")
    bad = found.select(F.col("id").alias(of), F.col("tie").alias(tie))
    return docs.join(bad, F.col(key).eqNullSafe(F.col(of)) & (F.xxhash64(F.col(text)) == F.col(tie)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All documents, without the words that are hit; what stands between words stays."""
    found = contamination(docs, benchmark, key=key, text=text, window=window).where("n_hit > 0").dropDuplicates(["id", "tie"])
    of, tie, hit = unused(docs.columns, "_of", "_tie", "_hit")
    found = found.select(F.col("id").alias(of), F.col("tie").alias(tie), F.col("hit").alias(hit))
    parts = F.regexp_extract_all(F.col(text), F.lit(f"{CASED_WORD}|{CASED_BREAK}"), F.lit(0))
    first = F.when(F.col(text).rlike(f"^{CASED_WORD}"), 0).otherwise(1)  # words and what parts them alternate
    kept = F.filter(parts, lambda p, i: ((i + first) % 2 == 1) | ~F.array_contains(hit, ((i - first) / 2).cast("int")))
    joined = docs.join(found, F.col(key).eqNullSafe(F.col(of)) & (F.xxhash64(F.col(text)) == F.col(tie)), "left")
    return joined.withColumn(text, F.when(F.col(hit).isNull(), F.col(text)).otherwise(F.array_join(kept, ""))).drop(of, tie, hit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: which words of which documents lie in benchmark windows."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT doc_id, item_id, bw.size, p FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
