"""Joins and features of half-open spans within windows of text.

A window holds a bounded number of spans, so joins are by window first and by the span condition then. Containment comes
in three strengths, which differ for spans that share an end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .groups import blocks, by_batch, nested, places


def overlaps(a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{a}.end") > F.col(f"{b}.start"))


def differs(a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}.start") != F.col(f"{b}.start")) | (F.col(f"{a}.end") != F.col(f"{b}.end"))


def holds(a: str = "a", b: str = "b") -> Column:
    """a contains b, and is another span."""
    return (F.col(f"{a}.start") <= F.col(f"{b}.start")) & (F.col(f"{a}.end") >= F.col(f"{b}.end")) & differs(a, b)


def holds_strictly(a: str = "a", b: str = "b") -> Column:
    """a reaches beyond b on both sides."""
    return (F.col(f"{a}.start") < F.col(f"{b}.start")) & (F.col(f"{a}.end") > F.col(f"{b}.end"))


def pairs(spans: DataFrame, window: list[str], condition: Column, others: DataFrame | None = None) -> DataFrame:
    """Pairs of spans a and b of a window under a condition."""
    a, b = spans.alias("a"), (others if others is not None else spans).alias("b")
    by = [F.col(f"a.{w}") == F.col(f"b.{w}") for w in window]
    on = by[0]
    for c in by[1:]:
        on = on & c
    return a.join(b, on & condition)


def gathered(spans: DataFrame, window: list[str], *more: str) -> DataFrame:
    """One row a window: ``spans``, all its spans (start, end and what else is named)."""
    return spans.groupBy(*window).agg(F.collect_list(F.struct("start", "end", *more)).alias("spans"))


def interval_features(spans: DataFrame, window: list[str]) -> DataFrame:
    """Each span with its length, how many others it overlaps, holds and lies in, and its rank among those of its start."""
    return features_within(gathered(spans, window), window)


_FEATURES = ["overlapping", "contained", "containers", "strictly_contained", "same_start", "same_end"]


def features_within(windows: DataFrame, window: list[str]) -> DataFrame:
    """The interval features of windows that each hold all their ``spans`` (start, end).

    Windows of equal spans have equal features, which are counted once; no pairs leave the kernel.
    """
    known: dict[bytes, np.ndarray] = {}

    def features(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        key = start.tobytes() + end.tobytes()
        if (found := known.get(key)) is None:
            found = _counted(start, end)
            if len(known) >= 1000:
                known.clear()
            if len(start) <= 1000:
                known[key] = found
        return found

    def kernel(b: pa.RecordBatch) -> pa.Table:
        n, values = nested(b.column("spans"))
        start, end = (c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in values.flatten()[:2])
        edges = np.concatenate([[0], n.cumsum()])
        found = [features(start[x:y], end[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
        rows = np.repeat(np.arange(b.num_rows), [f.shape[1] for f in found])
        f = np.concatenate(found, axis=1)
        columns = {w: b.column(w).take(pa.array(rows)) for w in window}
        columns |= {k: pa.array(x).cast(t) for k, x, t in zip(("start", "end"), f, place, strict=False)} | {"length": pa.array(f[1] - f[0]).cast(place[0])}
        return pa.table(columns | {k: pa.array(x) for k, x in zip(_FEATURES, f[2:], strict=True)})

    span = windows.schema["spans"].dataType.elementType
    place = [to_arrow_type(span[c].dataType) for c in ("start", "end")]
    out = [*[windows.schema[w] for w in window], *[T.StructField(c, span[c].dataType) for c in ("start", "end")], T.StructField("length", span["start"].dataType)]
    return by_batch(windows.select(*window, "spans"), kernel, T.StructType(out + [T.StructField(c, T.LongType()) for c in _FEATURES]))


def _counted(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Start, end and the features of the distinct spans of a window; a span given several times counts so often on both sides."""
    (s, e), times = np.unique(np.stack([start, end]), axis=1, return_counts=True)
    out, step = np.zeros((8, len(s)), np.int64), max(1, (1 << 20) // max(len(s), 1))
    out[0], out[1] = s, e
    for a in range(0, len(s), step):
        x, y = s[a : a + step, None], e[a : a + step, None]
        met = (x < e) & (y > s) & ((x != s) | (y != e))
        parts = [met, met & (x <= s) & (y >= e), met & (s <= x) & (e >= y), met & (x < s) & (y > e), met & (x == s), met & (y == e)]
        out[2:, a : a + step] = np.stack([p @ times for p in parts]) * times[a : a + step]
    return out


def overlap_diagnostics(spans: DataFrame, window: list[str]) -> DataFrame:
    """For each positive span: the size of its overlap cluster (itself included), its rank there, and who outranks it.

    ``spans`` also has score and positive.
    """
    return diagnostics_within(gathered(spans, window, "score", "positive"), window)


def diagnostics_within(windows: DataFrame, window: list[str]) -> DataFrame:
    """The overlap diagnostics of windows that each hold all their ``spans`` (start, end, score, positive)."""
    names = ["cluster", "rank", "longer_ahead", "shorter_ahead"]

    def kernel(b: pa.RecordBatch) -> pa.Table:
        n, values = nested(b.column("spans"))
        s, e = (c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in values.flatten()[:2])
        score = pc.fill_null(values.flatten()[2].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        of, first = np.repeat(np.arange(len(n)), n), n.cumsum() - n
        p = np.flatnonzero(pc.fill_null(values.flatten()[3], False).to_numpy(zero_copy_only=False))
        counts, found = n[of[p]], np.zeros((4, len(p)), np.int64)
        for lo, hi in blocks(counts):
            x, y = np.repeat(p[lo:hi], counts[lo:hi]), places(first[of[p[lo:hi]]], counts[lo:hi])
            near = (s[x] < e[y]) & (e[x] > s[y]) & ((s[x] != s[y]) | (e[x] != e[y]))
            x, y, i = x[near], y[near], np.repeat(np.arange(hi - lo), counts[lo:hi])[near]
            ahead = (score[y] > score[x]) | ((score[y] == score[x]) & ((s[y] < s[x]) | ((s[y] == s[x]) & (e[y] < e[x]))))
            for k, which in enumerate((slice(None), ahead, ahead & (s[y] <= s[x]) & (e[y] >= e[x]), ahead & (s[x] <= s[y]) & (e[x] >= e[y]))):
                found[k, lo:hi] = np.bincount(i[which], minlength=hi - lo)
        # A span given several times is one row.
        keys, at = np.unique(np.stack([of[p], s[p], e[p]]), axis=1, return_inverse=True)
        sums = [np.bincount(at, x, minlength=keys.shape[1]).astype(np.int64) for x in found]
        sums[0], sums[1] = sums[0] + 1, sums[1] + 1
        columns = {w: b.column(w).take(pa.array(keys[0])) for w in window} | {k: pa.array(x).cast(t) for k, x, t in zip(("start", "end"), keys[1:], place, strict=True)}
        return pa.table(columns | {k: pa.array(x) for k, x in zip(names, sums, strict=True)})

    span = windows.schema["spans"].dataType.elementType
    place = [to_arrow_type(span[c].dataType) for c in ("start", "end")]
    out = [*[windows.schema[w] for w in window], *[T.StructField(c, span[c].dataType) for c in ("start", "end")]]
    return by_batch(windows.select(*window, F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["score"], x["positive"])).alias("spans")), kernel, T.StructType(out + [T.StructField(c, T.LongType()) for c in names]))


def relation(a: str = "a", b: str = "b") -> Column:
    """How span b stands to span a."""
    return F.when(~differs(a, b), "EXACT").when(holds(b, a), "LONGER").when(holds(a, b), "SHORTER").otherwise("OTHER")


def distance(a: str = "a", b: str = "b") -> Column:
    """Characters between two spans; 0 where they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(F.col(f"{a}.start") - F.col(f"{b}.end"), F.col(f"{b}.start") - F.col(f"{a}.end")))


def membership(spans: DataFrame, segments: DataFrame, window: list[str]) -> DataFrame:
    """The numbers of the segments that each span touches, in order."""
    joined = pairs(spans, window, overlaps(), segments)
    keys = [*window, "start", "end"]
    return joined.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.array_sort(F.collect_set("b.segment")).alias("segments"))


def near_pairs(nodes: DataFrame, window: list[str], compatible: DataFrame, gap: int = 600, apart: int = 2) -> DataFrame:
    """Ordered pairs of nodes (start, end, segment, kind) that lie near enough and whose kinds may be related."""
    near = differs() & (distance() <= gap) & (F.abs(F.col("a.segment") - F.col("b.segment")) <= apart)
    joined = pairs(nodes, window, near).join(F.broadcast(compatible), (F.col("a.kind") == F.col("source_kind")) & (F.col("b.kind") == F.col("target_kind")))
    return joined.select(*[F.col(f"a.{w}").alias(w) for w in window], F.col("a.start").alias("source_start"), F.col("a.end").alias("source_end"), F.col("b.start").alias("target_start"), F.col("b.end").alias("target_end"), "edge", distance().alias("gap"))


def gold_labels(spans: DataFrame, gold: DataFrame, window: list[str]) -> DataFrame:
    """Every span with the gold labels of exactly its place: one row, several labels as a list, none as DROP."""
    keys = [*window, "start", "end"]
    g = gold.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return spans.join(g, keys, "left").withColumn("verdict", _verdict())


def _verdict() -> Column:
    return F.when(F.col("labels").isNull(), "DROP").otherwise("KEEP")


def gold_within(windows: DataFrame, window: list[str]) -> DataFrame:
    """The gold labels of windows that each hold all their ``spans`` (start, end) and all their ``gold`` (start, end, label)."""
    here = lambda s: F.filter("gold", lambda g: (g["start"] == s["start"]) & (g["end"] == s["end"]))
    labels = lambda g: F.when(F.size(g) > 0, F.array_sort(F.array_distinct(F.array_compact(F.transform(g, lambda x: x["label"])))))
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), labels(here(s)).alias("labels")))
    return windows.select(*window, F.inline(each)).withColumn("verdict", _verdict())


def envelope(pairs_of: DataFrame, segments: DataFrame, window: list[str]) -> DataFrame:
    """For each pair of spans the smallest start and largest end of the segments that either touches."""
    p, s = pairs_of.alias("p"), segments.alias("s")
    touch = lambda side: (F.col(f"p.{side}_start") < F.col("s.end")) & (F.col(f"p.{side}_end") > F.col("s.start"))
    on = F.lit(True)
    for w in window:
        on = on & (F.col(f"p.{w}") == F.col(f"s.{w}"))
    keys = [*window, "source_start", "source_end", "target_start", "target_end"]
    return p.join(s, on & (touch("source") | touch("target"))).groupBy(*[F.col(f"p.{k}").alias(k) for k in keys]).agg(F.min("s.start").alias("from"), F.max("s.end").alias("to"))
