"""Features of spans in dependency trees.

``words``: sentence, word (from 1), head (0 for the root), start, end, upos, feats, deprel. ``spans``: sentence, id, start,
end. All is joins by sentence, whose words are a bounded number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import tree_rows
from .groups import blocks, by_group, column, group_numbers, places


def feature(feats: Column, name: str) -> Column:
    """A value out of a list like ``VerbForm=Fin|Tense=Past``."""
    return F.nullif(F.regexp_extract(F.coalesce(feats, F.lit("")), rf"(?:^|\|){name}=([^|]*)", 1), F.lit(""))


def word_flags(words: DataFrame) -> DataFrame:
    """Adds finite, modal, negated, predicate and clause_root."""
    modal = F.lower(F.coalesce("text", F.lit(""))).isin("can", "could", "may", "might", "must", "shall", "should", "will", "would")
    return words.withColumns({
        "finite": feature(F.col("feats"), "VerbForm").eqNullSafe("Fin"),
        "modal": (F.col("upos") == "AUX") & modal,
        "negated": feature(F.col("feats"), "Polarity").eqNullSafe("Neg"),
        "predicate": F.col("upos").isin("VERB", "AUX"),
        "clause_root": F.col("deprel").isin("root", "ccomp", "xcomp", "advcl", "acl", "conj", "parataxis"),
    })


def span_tree_features(words: DataFrame, spans: DataFrame) -> DataFrame:
    """For each span: words inside, its head (least deep, then first), how many heads lie outside, arcs that cross its
    border, whether it is connected, and whether it is exactly a subtree.

    Words and spans meet by whole sentences in a kernel; rows given twice count once.
    """
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = words.select("sentence", "word", "head", "start", "end", null(spans, "id"), F.lit(False).alias("span"))
    rows = rows.union(spans.select("sentence", null(words, "word"), null(words, "head"), "start", "end", "id", F.lit(True))).where(F.col("sentence").isNotNull())

    def kernel(table: pa.Table) -> pa.Table:
        return _span_features(table.sort_by([("sentence", "ascending"), ("span", "ascending")]))

    long = lambda n: T.StructField(n, T.LongType())
    out = T.StructType([
        rows.schema["sentence"], rows.schema["id"], long("n_words"), T.StructField("head_word", rows.schema["word"].dataType), T.StructField("head_depth", T.IntegerType()),
        long("external_heads"), long("crossing_arcs"), T.StructField("connected", T.BooleanType()), T.StructField("subtree", T.BooleanType()),
    ])
    return by_group(rows, "sentence", kernel, out)


def _span_features(table: pa.Table) -> pa.Table:
    """The features of the spans of whole sentences, in whose rows words come before spans."""
    group, is_span = group_numbers(table, "sentence"), table.column("span").to_numpy()
    n_words = int((~is_span).sum())
    of_words, of_spans = table.filter(pa.array(~is_span)), table.filter(pa.array(is_span))
    _, word, child, parent, depth = tree_rows(of_words, "sentence", group[~is_span])
    # Each word once: where rows differ in head or place, each of them counts.
    start, end = column(of_words, "start"), column(of_words, "end")
    kept = np.unique(np.stack([child, parent, column(of_words, "head", -1), start, end]), axis=1, return_index=True)[1] if n_words else np.zeros(0, np.int64)
    kept.sort()
    word, child, parent, start, end, of = word[kept], child[kept], parent[kept], start[kept], end[kept], group[~is_span][kept]
    s, e, span_of = column(of_spans, "start"), column(of_spans, "end"), group[is_span]
    lo, hi = np.searchsorted(of, span_of), np.searchsorted(of, span_of, "right")
    counts, done = hi - lo, []
    for a, b in blocks(counts):
        n = counts[a:b]
        span = np.repeat(np.arange(a, b), n)
        row = places(lo[a:b], n)
        inside = (start[row] < e[span]) & (end[row] > s[span])
        # A word of a sentence and a span of it make one number.
        wide = len(depth) + 1
        members = np.unique(span[inside] * wide + child[row[inside]])
        governed = (parent[row] >= 0) & np.isin(span * wide + parent[row], members)
        is_member = np.isin(span * wide + child[row], members)
        size = b - a
        count = lambda which: np.bincount(span[which] - a, minlength=size)
        words_in, external, outside = count(inside), count(inside & ~governed), count(~is_member & governed)
        reached = np.where(depth[child] < 0, 1 << 30, depth[child])
        m, r = span[inside], row[inside]
        order = np.lexsort((word[r], reached[r], m))
        first = order[np.unique(m[order], return_index=True)[1]]
        some = m[first] - a
        d = reached[r[first]]
        done.append((m[first], words_in[some], word[r[first]], np.where(d < 1 << 30, d, -1), external[some], outside[some]))
    at, n, head, d, external, outside = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 6
    found = of_spans.take(pa.array(at))
    return pa.table({
        "sentence": found.column("sentence"), "id": found.column("id"), "n_words": pa.array(n.astype(np.int64)), "head_word": pa.array(head).cast(table.schema.field("word").type),
        "head_depth": pa.array(d.astype(np.int32), mask=d < 0), "external_heads": pa.array(external.astype(np.int64)), "crossing_arcs": pa.array((external + outside).astype(np.int64)),
        "connected": pa.array(external == 1), "subtree": pa.array((external == 1) & (outside == 0)),
    })


def role_evidence(words: DataFrame, spans: DataFrame) -> DataFrame:
    """For each span the kinds of arguments that its words have inside it and outside it."""
    inside = words.alias("w").join(spans.alias("s"), (F.col("w.sentence") == F.col("s.sentence")) & (F.col("w.start") < F.col("s.end")) & (F.col("w.end") > F.col("s.start")))
    member = inside.select(F.col("s.sentence").alias("sentence"), "s.id", F.col("w.word").alias("word"))
    kids = words.select("sentence", F.col("word").alias("child"), F.col("head").alias("word"), "deprel").join(member, ["sentence", "word"])
    marked = kids.join(member.select("sentence", "id", F.col("word").alias("child"), F.lit(True).alias("_in")), ["sentence", "id", "child"], "left")
    return marked.groupBy("sentence", "id").agg(F.array_sort(F.collect_set(F.when(F.col("_in"), F.col("deprel")))).alias("internal"), F.array_sort(F.collect_set(F.when(F.col("_in").isNull(), F.col("deprel")))).alias("external"))


def parse_violations(words: DataFrame) -> DataFrame:
    """rule and sentence of whatever breaks a parse: no root or several, heads that aren't there, words that no root reaches.

    One pass over whole sentences; rows given twice count once.
    """

    def kernel(table: pa.Table) -> pa.Table:
        group, _, child, parent, depth = tree_rows(table, "sentence")
        head = column(table, "head", np.iinfo(np.int64).min)
        given, first = pc.is_valid(table.column("head")).to_numpy(), np.unique(group, return_index=True)[1]
        roots = _distinct_roots(group, child, head, len(first))
        unreached = (depth[child] < 0) | pc.is_null(table.column("sentence")).to_numpy() | pc.is_null(table.column("word")).to_numpy()
        broken = {"roots": np.flatnonzero(roots != 1), "head_missing": np.unique(group[given & (head != 0) & (parent < 0)]), "unreached": np.unique(group[unreached])}
        rule = np.repeat(list(broken), [len(g) for g in broken.values()])
        return pa.table({"rule": pa.array(rule, pa.string()), "sentence": table.column("sentence").take(pa.array(first[np.concatenate([*broken.values()])]))})

    return by_group(words.select("sentence", "word", "head"), "sentence", kernel, T.StructType([T.StructField("rule", T.StringType()), words.schema["sentence"]]))


def _distinct_roots(group: np.ndarray, child: np.ndarray, head: np.ndarray, groups: int) -> np.ndarray:
    """How many words of each sentence are roots."""
    root = np.flatnonzero(head == 0)
    root = root[np.unique(child[root], return_index=True)[1]]
    return np.bincount(group[root], minlength=groups)


def resolved_references(decisions: DataFrame) -> DataFrame:
    """reference, antecedent, status: one antecedent gives an edge, several stay candidates, none is unresolved.

    ``decisions``: reference, antecedent, chosen.
    """
    g = decisions.groupBy("reference").agg(F.array_sort(F.collect_set(F.when(F.col("chosen"), F.col("antecedent")))).alias("a"))
    status = F.when(F.size("a") == 1, "RESOLVED").when(F.size("a") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    return g.select("reference", F.when(F.size("a") == 1, F.col("a")[0]).alias("antecedent"), F.size("a").cast("long").alias("candidates"), status.alias("status"))


def apply_qualifiers(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Nodes with the qualifiers decided for them, in order; ``decisions``: id, kind, value, accepted."""
    d = decisions.where("accepted").groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "kind", "value"))).alias("qualifiers"))
    return nodes.join(d, "id", "left").withColumn("qualifiers", F.coalesce("qualifiers", F.array().cast("array<string>")))
