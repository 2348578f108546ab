"""Queries on files, model envelopes, dependency trees and incremental work."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import extraction as E
from tessera.operators import syntax as Y
from tessera.sources import files
from tessera.streaming import incremental
from tessera.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@register("s7_optional_table", """SELECT n_nationkey::BIGINT AS id, n_name AS name, 'none' AS scope, 0.5::DOUBLE AS confidence FROM nation""")
def _(spark, sf):
    """A table that may lack columns, with defaults for them."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return files.with_defaults(n, {"id": ("bigint", 0), "name": ("string", ""), "scope": ("string", "none"), "confidence": ("double", 0.5)}, spark)


@register("s10_paged_text", """SELECT conv_id, string_agg('## Page ' || turn || chr(10) || trim(regexp_replace(text, '[ \\t]+', ' ', 'g')), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def _(spark, sf):
    """Documents from numbered pages."""
    return files.paged_text(table(spark, sf, "conversations").withColumnRenamed("turn", "page"), "conv_id")


@register("s22_text_fallbacks", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN nullif(trim(text), '') ELSE nullif(trim(lang), '') END AS text, CASE WHEN doc_id % 3 = 0 AND nullif(trim(text), '') IS NOT NULL THEN 0 ELSE 1 END AS source FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    """A text from the first source that has one."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    a = d.where("doc_id % 3 = 0").select("doc_id", "text")
    b = d.select("doc_id", F.col("lang").alias("text"))
    return files.first_text(d, "doc_id", [a, b])


def _echo(prompt: str) -> str:
    """A stand-in for a model: the sentences of the text as a JSON list."""
    return json.dumps({"facts": [s.strip() for s in prompt.split("\n", 1)[1].split(".") if s.strip()][:3]})


@register("m1_extracted_facts")
def _(spark, sf):
    """Facts by chunk from an injected model, numbered by content."""
    return E.extract_facts(table(spark, sf, "documents").select("doc_id", "text"), _echo, size=4000).select("doc_id", "chunk", "item", "id")


def _tagger(prompt: str) -> str:
    text = prompt.split("\n", 1)[1]
    return "no json" if "!!" in text else json.dumps({"tags": [w for w in ("the", "of", "odd") if f" {w} " in text]})


@register("m2_labelled_facts", """SELECT doc_id AS id, list_filter([CASE WHEN contains(text, ' the ') THEN 'the' END, CASE WHEN contains(text, ' of ') THEN 'of' END], lambda x: x IS NOT NULL) AS tags FROM documents WHERE doc_id % 2 = 0 AND NOT contains(text, '!!')""")
def _(spark, sf):
    """M2: labels for facts that lack them; invalid answers leave them unlabelled."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return E.label_facts(d, d.where("id % 2 = 1"), _tagger, ("the", "of"))


def _chooser(prompt: str) -> str:
    ids = json.loads(prompt.removeprefix("Choose from "))
    return json.dumps({"selected": ids[:1] + (["unknown"] if len(ids) % 5 == 0 else [])})


@register("m6_selected_candidates", """SELECT o_custkey AS "win", o_orderkey::VARCHAR AS candidate, CASE WHEN n % 5 = 0 THEN 'invalid' WHEN r = 1 THEN 'selected' ELSE 'rejected' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def _(spark, sf):
    """M6, M7, M9, X11: a closed choice among candidates; answers with unknown ids select nothing."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("window")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("candidates"))
    return E.select_candidates(o, _chooser).withColumnRenamed("window", "win")


@register("t47_slot_candidates", """WITH a AS (SELECT * FROM (VALUES ('entity', 'E1', 'the of'), ('entity', 'E2', 'that'), ('relation', 'R1', 'with and for')) v(slot, name, alias)),
w AS (SELECT slot, name, alias, len(string_split(alias, ' ')) AS n, unnest(string_split(alias, ' ')) AS token FROM a),
t AS (SELECT DISTINCT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM documents)
SELECT id, slot, name, round(count(*) / n::DOUBLE, 6) AS score FROM t JOIN w USING (token) GROUP BY id, slot, name, n""")
def _(spark, sf):
    """Entities and relations whose names stand in a text."""
    a = spark.createDataFrame([("entity", "E1", "the of"), ("entity", "E2", "that"), ("relation", "R1", "with and for")], "slot string, name string, alias string")
    return E.slot_candidates(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), a, 5)


def word_rows(spark, sf):
    """Dependency trees: one sentence an order, each word's head at half its number; a word once for each line of its number."""
    l = table(spark, sf, "lineitem")
    i = F.col("l_linenumber")
    return l.select(
        F.col("l_orderkey").alias("sentence"), i.cast("int").alias("word"), F.floor(i / 2).cast("int").alias("head"), (i * 3).cast("long").alias("start"), (i * 3 + 2).cast("long").alias("end"),
        F.when(i % 2 == 0, "VERB").otherwise("NOUN").alias("upos"), F.concat(F.lit("VerbForm="), F.when(i % 3 == 0, "Fin").otherwise("Inf"), F.lit("|Polarity="), F.when(i % 4 == 0, "Neg").otherwise("Pos")).alias("feats"),
        F.when(i == 1, "root").when(i % 2 == 0, "nsubj").otherwise("obj").alias("deprel"), F.lit("might").alias("text"),
    )


def words(spark, sf):
    return word_rows(spark, sf).distinct()


WORDS = """words AS (SELECT DISTINCT l_orderkey AS sentence, l_linenumber AS word, l_linenumber // 2 AS head, l_linenumber * 3 AS a, l_linenumber * 3 + 2 AS b, CASE WHEN l_linenumber = 1 THEN 'root' WHEN l_linenumber % 2 = 0 THEN 'nsubj' ELSE 'obj' END AS deprel FROM lineitem),
sp AS (SELECT DISTINCT sentence, 1 AS id, 6 AS s, 12 AS e FROM words UNION ALL SELECT DISTINCT sentence, 2, 3, 12 FROM words),
m AS (SELECT w.sentence, id, word, head FROM words w JOIN sp ON w.sentence = sp.sentence AND a < e AND b > s)"""


def tree_spans(w):
    s = w.select("sentence").distinct()
    one = s.select("sentence", F.lit(1).alias("id"), F.lit(6).cast("long").alias("start"), F.lit(12).cast("long").alias("end"))
    return one.union(s.select("sentence", F.lit(2), F.lit(3).cast("long"), F.lit(12).cast("long")))


@register("v19_span_heads", f"""WITH {WORDS}, h AS (SELECT m.sentence, m.id, count(*) AS n_words, count(*) FILTER (NOT EXISTS (SELECT 1 FROM m x WHERE x.sentence = m.sentence AND x.id = m.id AND x.word = m.head)) AS external_heads, min(m.word)::INT AS head_word FROM m GROUP BY 1, 2),
c AS (SELECT m.sentence, m.id, count(*) AS k FROM words w JOIN m ON w.sentence = m.sentence AND w.head = m.word WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.sentence = m.sentence AND x.id = m.id AND x.word = w.word) GROUP BY 1, 2)
SELECT sentence, id, n_words, head_word, external_heads, external_heads + coalesce(k, 0) AS crossing_arcs, external_heads = 1 AS connected, external_heads = 1 AND coalesce(k, 0) = 0 AS subtree FROM h LEFT JOIN c USING (sentence, id)""")
def _(spark, sf):
    """Heads, outside heads, crossing arcs, connection and subtrees of spans."""
    w = word_rows(spark, sf)
    return Y.span_tree_features(w, tree_spans(w)).drop("head_depth")


@register("v20_word_flags", """SELECT DISTINCT l_orderkey AS sentence, l_linenumber::INT AS word, l_linenumber % 3 = 0 AS finite, l_linenumber % 4 = 0 AS negated, l_linenumber % 2 = 0 AS predicate, l_linenumber = 1 AS clause_root FROM lineitem""")
def _(spark, sf):
    """What a word's features say."""
    return Y.word_flags(words(spark, sf)).select("sentence", "word", "finite", "negated", "predicate", "clause_root")


@register("v21_role_evidence", f"""WITH {WORDS}, k AS (SELECT m.sentence, m.id, w.deprel, EXISTS (SELECT 1 FROM m x WHERE x.sentence = m.sentence AND x.id = m.id AND x.word = w.word) AS inside FROM words w JOIN m ON w.sentence = m.sentence AND w.head = m.word)
SELECT sentence, id, coalesce(string_agg(DISTINCT deprel, ',' ORDER BY deprel) FILTER (inside), '') AS internal, coalesce(string_agg(DISTINCT deprel, ',' ORDER BY deprel) FILTER (NOT inside), '') AS external FROM k GROUP BY 1, 2""")
def _(spark, sf):
    """Arguments that a span's words have inside and outside it."""
    w = words(spark, sf)
    return Y.role_evidence(w, tree_spans(w)).select("sentence", "id", F.array_join("internal", ",").alias("internal"), F.array_join("external", ",").alias("external"))


@register("x30_parse_violations", """WITH RECURSIVE w AS (SELECT DISTINCT l_orderkey AS sentence, l_linenumber AS word, l_linenumber // 2 AS head FROM lineitem),
t AS (SELECT sentence, word FROM w WHERE head = 0 UNION SELECT w.sentence, w.word FROM w JOIN t ON w.sentence = t.sentence AND w.head = t.word)
SELECT 'roots' AS rule, sentence FROM w GROUP BY 2 HAVING count(*) FILTER (head = 0) <> 1
UNION ALL SELECT DISTINCT 'head_missing', sentence FROM w WHERE head <> 0 AND NOT EXISTS (SELECT 1 FROM w x WHERE x.sentence = w.sentence AND x.word = w.head)
UNION ALL SELECT DISTINCT 'unreached', sentence FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.sentence = w.sentence AND t.word = w.word)""")
def _(spark, sf):
    """Parses that break the rules, all words of a sentence looked at."""
    return Y.parse_violations(word_rows(spark, sf))


@register("x15_resolved_references", """SELECT reference, CASE WHEN n = 1 THEN a END AS antecedent, n AS candidates, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status FROM (SELECT o_custkey AS reference, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS n, min(o_orderkey) FILTER (o_orderstatus = 'F') AS a FROM orders GROUP BY 1)""")
def _(spark, sf):
    """References with one, several or no antecedents."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("reference"), F.col("o_orderkey").alias("antecedent"), (F.col("o_orderstatus") == "F").alias("chosen"))
    return Y.resolved_references(o)


@register("x14_qualified_nodes", """SELECT c_custkey AS id, coalesce((SELECT string_agg(DISTINCT o_orderpriority || '=' || o_orderstatus, ',' ORDER BY o_orderpriority || '=' || o_orderstatus) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P'), '') AS qualifiers FROM customer""")
def _(spark, sf):
    """Nodes with the qualifiers decided for them."""
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("value"), (F.col("o_orderstatus") != "P").alias("accepted"))
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return Y.apply_qualifiers(n, d).select("id", F.array_join("qualifiers", ",").alias("qualifiers"))


@register("r3_quota_windows", """SELECT user_id, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS asked, count(*) - 2 AS refused FROM events GROUP BY 1, 2 HAVING count(*) > 2""")
def _(spark, sf):
    """Users over their daily quota, by event-time windows that a stream can close."""
    c = incremental.over_quota(incremental.daily_counts(table(spark, sf, "events")), 2)
    return c.select("user_id", F.date_format("day.start", "yyyy-MM-dd").alias("day"), "asked", "refused")


@register("t61_mechanical_text")
def _(spark, sf):
    """Texts tidied by rule, with their letters kept."""
    @F.pandas_udf("struct<shown:string,kept:boolean>")
    def tidy(texts: pd.Series) -> pd.DataFrame:
        shown = [E.mechanical(t)[0] for t in texts]
        return pd.DataFrame({"shown": shown, "kept": [E.letters_preserved(a or "", b) for a, b in zip(texts, shown, strict=True)]})

    return table(spark, sf, "documents").select("doc_id", tidy("text").alias("t")).select("doc_id", F.length("t.shown").alias("n"), "t.kept")
