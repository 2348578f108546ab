"""Windows over texts, spans that grow together, and finding one text in others."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import surface
from tessera.functions import text as T

from .groups import blocks, by_batch, nested, places

BLANK = "[ \n\t\r]+"
#: Words by whose hash a quotation is looked up.
LEAD = 8
#: Words times queries that a table of both may have.
CELLS = 1 << 24
#: Words of all quotations together that go to the tasks; beyond it they are joined.
HELD_WORDS = 1 << 22


def word_windows(df: DataFrame, size: int, stride: int, *, text: str = "text") -> DataFrame:
    """One row for each window of words: start and words, joined by spaces; one at least for each text."""
    w = df.withColumn("_w", F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), ""))
    w = w.withColumn("start", F.explode(T.chunk_starts(F.size("_w"), size, stride)))
    return w.withColumn("words", F.array_join(F.slice("_w", F.col("start") + 1, size), " ")).drop("_w", text)


def context_windows(df: DataFrame, size: int, overlap: int, *, text: str = "text") -> DataFrame:
    """Overlapping windows that reach the end of the text: start and words, as arrays."""
    w = df.withColumn("_w", F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), ""))
    w = w.withColumn("start", F.explode(T.context_starts(F.size("_w"), size, overlap)))
    return w.withColumn("words", F.slice("_w", F.col("start") + 1, size)).drop("_w", text)


def token_windows(df: DataFrame, size: int, *, text: str = "text") -> DataFrame:
    """One row for each run of ``size`` tokens of a text, the last perhaps shorter: k (from 0) and w, the tokens."""
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(T.token_chunks(F.col(text), size)).alias("k", "w"))
    return out.withColumn("w", F.split(F.trim("w"), " "))


def raw_windows(df: DataFrame, size: int, *, text: str = "text") -> DataFrame:
    """One row for each run of ``size`` words of a text as they stand, the last perhaps shorter: k (from 0) and w."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?:[^ \\n\\t\\r]+[ \\n\\t\\r]*){{1,{size}}}"), F.lit(0))
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(runs).alias("k", "w"))
    return out.withColumn("w", F.array_remove(F.split("w", BLANK), ""))


def coalesced(spans: DataFrame, group: list[str]) -> DataFrame:
    """start and end of the islands that overlapping or touching spans form within a group.

    Nulls sort last; a span without an end may lie in an island, but doesn't extend it.
    """
    order = W.partitionBy(*group).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("_fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*group, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def ngrams(df: DataFrame, words: str, most: int) -> DataFrame:
    """All runs of up to ``most`` words: start (from 1), size and phrase."""
    out = df.withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))))).where(F.size(words) > 0)
    out = out.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - F.col("start") + 1))))
    return out.withColumn("phrase", F.array_join(F.slice(words, F.col("start"), F.col("size")), " ")).drop(words)


def run_flags(df: DataFrame, words: str, most: int) -> DataFrame:
    """All runs of up to ``most`` words: start (from 0), stop and the flags of ``cues.surface_flags``."""
    known: dict[str, int] = {}

    def kernel(b: pa.RecordBatch, at: np.ndarray, size: np.ndarray, flat: pa.Array) -> dict[str, pa.Array]:
        return {c: pa.array(x) for c, x in surface.run_flags(surface.looked_up(flat, known, surface.facts), at, size, most).items()}

    return _of_runs(df, words, most, kernel, [T_.StructField(c, T_.BooleanType()) for c in surface.FLAGS])


def run_hints(df: DataFrame, words: str, most: int) -> DataFrame:
    """All runs of up to ``most`` words: start (from 0), stop and the hints of ``cues.type_hints``, joined by commas."""
    known: dict[str, int] = {}

    def kernel(b: pa.RecordBatch, at: np.ndarray, size: np.ndarray, flat: pa.Array) -> dict[str, pa.Array]:
        return {"hints": surface.HINTS.take(pa.array(surface.run_hints(surface.looked_up(flat, known, surface.hints), at, size, most)))}

    return _of_runs(df, words, most, kernel, [T_.StructField("hints", T_.StringType())])


def _of_runs(df: DataFrame, words: str, most: int, kernel, fields: list) -> DataFrame:
    keys = [c for c in df.columns if c != words]

    def of_batch(b: pa.RecordBatch) -> pa.Table:
        n, flat = nested(b.column(words))
        row, start, size = surface.runs(n, most)
        rows = pa.array(row)
        columns = {c: b.column(c).take(rows) for c in keys} | {"start": pa.array(start), "stop": pa.array(start + size)}
        return pa.table(columns | kernel(b, (n.cumsum() - n)[row] + start, size, flat))

    places_ = [T_.StructField(c, T_.LongType()) for c in ("start", "stop")]
    return by_batch(df.select(*keys, words), of_batch, T_.StructType([*[df.schema[c] for c in keys], *places_, *fields]))


def run_sizes(df: DataFrame, words: str, most: int) -> DataFrame:
    """How many runs of each size up to ``most`` the words of a row have, and their characters with single spaces between.

    The sums that ``ngrams`` would give by row and size, from the lengths of the words alone: a run's characters are a
    difference of prefix sums, and all runs of a size one of sums of those, so a row costs its words and not its runs.
    """
    keys = [c for c in df.columns if c != words]

    def kernel(b: pa.RecordBatch) -> pa.Table:
        n, values = nested(b.column("_n"))
        longest = int(n.max(initial=0))
        out = {"_row": [], "size": [], "spans": [], "chars": []}
        lengths, first = values.to_numpy(zero_copy_only=False).astype(np.int64), n.cumsum() - n
        for lo, hi in blocks(np.full(len(n), longest + 2)) if longest else ():
            k = n[lo:hi]
            at = np.repeat(np.arange(hi - lo), k), places(np.zeros(hi - lo, np.int64), k)
            wide = np.zeros((hi - lo, int(k.max(initial=0)) + 1), np.int64)
            wide[at[0], at[1] + 1] = lengths[first[lo] : first[lo] + k.sum()]
            upto = wide.cumsum(axis=1)  # characters of the first j words
            sums = np.concatenate([np.zeros((hi - lo, 1), np.int64), upto.cumsum(axis=1)], axis=1)  # of upto[0 .. j - 1]
            some = np.arange(hi - lo)
            for size in range(1, min(most, int(k.max(initial=0))) + 1):
                r = some[k >= size]
                spans = k[r] - size + 1
                chars = (sums[r, k[r] + 1] - sums[r, size]) - sums[r, spans] + spans * (size - 1)
                for c, x in zip(out, (r + lo, np.full(len(r), size), spans, chars), strict=True):
                    out[c].append(x)
        joined = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}
        rows = pa.array(joined.pop("_row"))
        return pa.table({c: b.column(c).take(rows) for c in keys} | {c: pa.array(x) for c, x in joined.items()})

    schema = T_.StructType([*[df.schema[c] for c in keys], *[T_.StructField(c, T_.LongType()) for c in ("size", "spans", "chars")]])
    return by_batch(df.select(*keys, F.transform(words, F.length).alias("_n")), kernel, schema)


def lexical_candidates(queries: DataFrame, documents: DataFrame, size: int, stride: int, most: int) -> DataFrame:
    """The windows of documents that share most words with each query: 0.8 of its words found, 0.2 of the window's.

    Up to ``CELLS`` of distinct words times queries, a table of both goes to the tasks, which count with it and hand on the
    best of theirs. Beyond that, queries and windows meet in a join by word and the counts are grouped sums.
    """
    q = queries.select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("q")).withColumn("nq", F.size("q"))
    if size % stride:
        raise ValueError("a window is a whole number of strides")
    # A window is some chunks in a row, the last ones of a text fewer; the text itself isn't carried along.
    chunk = lambda k, j: F.coalesce(F.get(F.col("c"), k + j), F.lit(""))
    d = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.array(T.token_chunks(F.col("text"), stride))).alias("c"))
    window = lambda k: F.struct((k * stride).alias("start"), F.concat(*[x for j in range(size // stride) for x in (chunk(k, j), F.lit(" "))]).alias("w"))
    d = d.where(F.size("c") > 0).select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), F.size("c") - 1), window)))
    score = F.round(F.lit(0.8) * F.col("n") / F.col("nq") + F.lit(0.2) * F.col("n") / F.col("nw"), 6)
    size_of = q.agg(F.count(F.lit(1)).alias("queries"), F.sum("nq").alias("words")).first()
    if size_of["queries"] * (size_of["words"] or 0) <= CELLS and isinstance(d.schema["doc_id"].dataType, T_.IntegralType):
        counts = _best_counts(q.collect(), d, most, q.schema["item_id"])
    else:
        counts = _joined_counts(q, d)
    r = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "start"))
    return counts.withColumn("score", score).withColumn("r", r).where(F.col("r") <= most).select("item_id", "doc_id", "start", "score")


def _joined_counts(q: DataFrame, d: DataFrame) -> DataFrame:
    d = d.select("doc_id", "start", F.array_distinct(F.array_remove(F.split("w", " "), "")).alias("w")).withColumn("nw", F.size("w"))
    shared = q.select("item_id", "nq", F.explode("q").alias("token")).join(d.select("doc_id", "start", "nw", F.explode("w").alias("token")), "token")
    return shared.groupBy("item_id", "doc_id", "start", "nq", "nw").agg(F.count(F.lit(1)).alias("n"))


def _best_counts(asked: list, d: DataFrame, most: int, item_id: T_.StructField) -> DataFrame:
    """item_id, doc_id, start, nq, nw and n (words shared) of the windows that may be among the ``most`` best of each query."""
    asked = [r for r in asked if r["nq"]]
    at = {w: k for k, w in enumerate(dict.fromkeys(w for r in asked for w in r["q"]))}
    nq, ids = np.array([r["nq"] for r in asked], np.int64), [r["item_id"] for r in asked]
    holds = np.zeros((len(at), len(asked)), np.int16)
    for k, r in enumerate(asked):
        holds[[at[w] for w in r["q"]], k] = 1

    def kept(c: np.ndarray) -> np.ndarray:
        """Rows of candidates (item, doc, start, n, nw) that can be among the best: a row less than a millionth behind may tie when rounded."""
        s = 0.8 * c[3] / nq[c[0]] + 0.2 * c[3] / c[4]
        order = np.lexsort((c[2], c[1], -s, c[0]))
        c, s = c[:, order], s[order]
        new = np.concatenate([[True], c[0, 1:] != c[0, :-1]])
        first = np.flatnonzero(new)[new.cumsum() - 1]
        fifth = s[np.minimum(first + most - 1, np.concatenate([np.flatnonzero(new)[1:], [len(s)]])[new.cumsum() - 1] - 1)]
        # Of equal scores only the first by document and start count.
        same = np.concatenate([[True], new[1:] | (s[1:] != s[:-1])])
        place = np.arange(len(s)) - np.flatnonzero(same)[same.cumsum() - 1]
        return c[:, (s >= fifth - 2e-6) & (place < most)]

    def run(batches):
        best, floor = np.zeros((5, 0), np.int64), np.zeros(len(asked))
        for b in batches:
            docs, starts, texts = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("start").to_numpy(zero_copy_only=False), b.column("w").to_pylist()
            for lo in range(0, len(texts), 512):
                words = [set(t.split()) for t in texts[lo : lo + 512]]
                known = [[at[w] for w in ws if w in at] for ws in words]
                rows = [k for k, ws in enumerate(known) if ws]
                if not rows or not asked:
                    continue
                n = np.add.reduceat(holds[np.concatenate([known[k] for k in rows])], np.concatenate([[0], np.cumsum([len(known[k]) for k in rows])[:-1]]), axis=0)
                nw = np.array([len(words[k]) for k in rows])
                s = n * (0.8 / nq) + n * (0.2 / nw)[:, None]
                w, item = np.nonzero((n > 0) & (s >= floor - 4e-6))
                if len(w):
                    found = np.stack([item, docs[lo:][np.array(rows)[w]], starts[lo:][np.array(rows)[w]], n[w, item], nw[w]]).astype(np.int64)
                    best = kept(np.concatenate([best, found], axis=1))
                    size = np.bincount(best[0], minlength=len(asked))
                    low = np.full(len(asked), np.inf)
                    np.minimum.at(low, best[0], 0.8 * best[3] / nq[best[0]] + 0.2 * best[3] / best[4])
                    floor = np.where(size >= most, low, 0.0)
        if best.shape[1]:
            item, doc, start, n, nw = best
            yield pa.RecordBatch.from_pydict({
                "item_id": pa.array([ids[k] for k in item]).cast(item_type), "doc_id": pa.array(doc).cast(doc_type), "start": pa.array(start.astype(np.int32)),
                "nq": pa.array(nq[item].astype(np.int32)), "nw": pa.array(nw.astype(np.int32)), "n": pa.array(n),
            })

    item_type, doc_type = to_arrow_type(item_id.dataType), to_arrow_type(d.schema["doc_id"].dataType)
    ints = [T_.StructField(c, T_.IntegerType()) for c in ("start", "nq", "nw")]
    return d.select("doc_id", "start", "w").mapInArrow(run, T_.StructType([item_id, d.schema["doc_id"], *ints, T_.StructField("n", T_.LongType())]))


def _run_hashes(row: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; null for fewer words."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(row) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(row, i, k)))
    return F.when(F.size(row) >= k, every)


def _joined_holders(q: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id and doc_id of the documents that hold a query's words in a row, by a join on the hash of the first."""
    d = documents.select("doc_id", T.tokens(F.col("text")).alias("t"))
    parts = []
    for k in sorted(r["lead"] for r in q.select("lead").distinct().where("lead > 0").collect()):  # LEAD numbers at most
        starts = _run_hashes(F.col("t"), k)
        wanted = q.where(F.col("lead") == k).select("item_id", "q", "n", F.xxhash64(F.slice("q", 1, k)).alias("h"))
        hits = d.select("doc_id", "t", F.posexplode(starts).alias("at", "h")).join(wanted, "h").where(F.slice("t", F.col("at") + 1, F.col("n")) == F.col("q"))
        parts.append(hits.select("item_id", "doc_id").distinct())
    none = q.where(F.lit(False)).select("item_id", F.lit(0).cast("long").alias("doc_id"))
    return reduce(DataFrame.union, parts, none)


def _held(asked: list, documents: DataFrame, item_id: T_.StructField) -> DataFrame:
    """The same, with the queries at hand in the tasks; one pass over each document's words."""
    leads: dict[str, dict[int, dict[tuple, list]]] = {}
    for r in asked:
        leads.setdefault(r["q"][0], {}).setdefault(r["lead"], {}).setdefault(tuple(r["q"][: r["lead"]]), []).append((r["item_id"], r["q"]))

    def held(text: str) -> set:
        t, found = text.split(), set()
        for i, w in enumerate(t):
            if w in leads:
                for k, starts in leads[w].items():
                    for item, words in starts.get(tuple(t[i : i + k]), ()):
                        if item not in found and t[i : i + len(words)] == words:
                            found.add(item)
        return found

    def run(batches):
        for b in batches:
            found = [held(t) for t in b.column("t").to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([i for f in found for i in f], item_type), "doc_id": b.column("doc_id").take(rows)})

    item_type = to_arrow_type(item_id.dataType)
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), T.NOT_WORD, " "))
    d = documents.select("doc_id", plain.alias("t"))
    return d.mapInArrow(run, T_.StructType([item_id, d.schema["doc_id"]])).distinct()


def resolution(queries: DataFrame, documents: DataFrame, *, floor: float = 0.12, margin: float = 0.02) -> DataFrame:
    """item_id, state, doc_id and score: where each query's text comes from.

    exact: one document holds it as it stands; ambiguous_exact: several do; otherwise the best window decides: lexical,
    ambiguous_lexical where a window of another document comes within ``margin``, unresolved below ``floor`` or for
    fewer than two words. Texts meet where a query's first ``LEAD`` words stand, and are compared in full only there: in one
    pass over the documents, or by a join on hashes where the queries have over ``HELD_WORDS`` words.
    """
    q = queries.select("item_id", T.tokens(F.col("text")).alias("q")).withColumn("n", F.size("q"))
    q = q.withColumn("lead", F.least("n", F.lit(LEAD)))
    words = q.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = _held(q.where("n > 0").collect(), documents, q.schema["item_id"]) if words <= HELD_WORDS else _joined_holders(q, documents)
    exact = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"), F.min("doc_id").alias("exact_doc"))
    best = lexical_candidates(queries, documents, 120, 60, 5)
    few = best.groupBy("item_id").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"), -F.col("start"))).alias("best_doc"), F.max("score").alias("best"), F.collect_list(F.struct("score", "doc_id")).alias("all"))
    top = few.withColumn("next", F.array_max(F.transform(F.filter("all", lambda x: x["doc_id"] != F.col("best_doc")), lambda x: x["score"]))).drop("all")
    out = q.select("item_id", "n").join(exact, "item_id", "left").join(top, "item_id", "left")
    state = (
        F.when(F.col("hits") == 1, "exact")
        .when(F.col("hits") > 1, "ambiguous_exact")
        .when((F.col("n") < 2) | F.col("best").isNull() | (F.col("best") < floor), "unresolved")
        .when(F.col("best") - F.coalesce("next", F.lit(0.0)) <= margin, "ambiguous_lexical")
        .otherwise("lexical")
    )
    return out.select("item_id", state.alias("state"), F.coalesce("exact_doc", "best_doc").alias("doc_id"), F.when(F.col("hits").isNull(), F.col("best")).otherwise(F.lit(1.0)).alias("score"))
