"""Queries on the evidence graph, on changes to tables, and on incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import upserts as U
from tessera.session import table

from .base import VIDEOS, videos

QUERIES: dict = {}
SQL: dict[str, str] = {}
TYPES = ("counters", "supports", "enables", "prevents", "needs")


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def relations(spark, sf):
    """Relations between suppliers and parts, one for each line of an order."""
    l = table(spark, sf, "lineitem")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return l.select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")).alias("subject"), kind.alias("relation_type"), F.concat(F.lit("p"), (F.col("l_partkey") % 25).cast("string")).alias("object"),
        F.col("l_returnflag").alias("condition"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_orderkey").alias("evidence_id"), (F.col("l_orderkey") % 97).alias("source_id"),
    )


REL = f"""rel AS (SELECT 's' || (l_suppkey % 40) AS subject, {list(TYPES)}[1 + l_linenumber % 5] AS relation_type, 'p' || (l_partkey % 25) AS object, l_returnflag AS condition, l_discount * 10 AS confidence, l_orderkey AS evidence_id, l_orderkey % 97 AS source_id FROM lineitem),
mer AS (SELECT subject, relation_type, object, condition, max(confidence) AS confidence, min(confidence) AS least, count(DISTINCT evidence_id) AS evidence, count(DISTINCT source_id) AS sources FROM rel GROUP BY 1, 2, 3, 4)"""


@register("a20_merged_relations", f"WITH {REL} SELECT subject, relation_type, object, condition, round(confidence, 6) AS confidence, round(least, 6) AS least, evidence, sources FROM mer")
def _(spark, sf):
    """Relations by identity, evidence gathered, the highest confidence kept."""
    m = G.merged(relations(spark, sf))
    return m.select("subject", "relation_type", "object", "condition", F.round("confidence", 6).alias("confidence"), F.round("least", 6).alias("least"), F.size("evidence").cast("long").alias("evidence"), "sources")


@register("a21_best_alignment", """SELECT o_custkey, max(o_totalprice) AS confidence, arg_max(o_orderpriority, struct_pack(a := o_totalprice, b := o_orderpriority, c := o_orderstatus)) AS kind FROM orders GROUP BY 1""")
def _(spark, sf):
    """The best alignment of each key."""
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("confidence"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("text"))
    return G.best_alignment(o, ["o_custkey"]).select("o_custkey", "confidence", "kind")


@register("a23_weighed_confidence", f"WITH {REL} SELECT subject, relation_type, object, condition, round(0.55::DOUBLE * max(confidence) + 0.35::DOUBLE * avg(confidence) + 0.10::DOUBLE, 6) AS confidence FROM rel GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    """Confidence from extraction, evidence and canonical names."""
    g = relations(spark, sf).groupBy(*G.IDENTITY).agg(F.max("confidence").alias("x"), F.avg("confidence").alias("e"))
    return g.select(*G.IDENTITY, F.round(G.weighed(F.col("x"), F.col("e"), F.lit(1.0)), 6).alias("confidence"))


@register("a24_ordinal_max", """SELECT o_custkey, arg_max(o_orderpriority, r) AS worst FROM (SELECT o_custkey, o_orderpriority, -substr(o_orderpriority, 1, 1)::INT AS r FROM orders) GROUP BY 1""")
def _(spark, sf):
    """The greatest of listed values."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", -F.substring("o_orderpriority", 1, 1).cast("int")).alias("worst"))


@register("j25_contradictions", f"""WITH {REL} SELECT a.subject, a.object, a.condition, a.relation_type AS a_type, b.relation_type AS b_type FROM mer a JOIN mer b ON a.subject = b.subject AND a.object = b.object AND a.condition = b.condition WHERE (a.relation_type, b.relation_type) IN (('counters', 'supports'), ('enables', 'prevents'))""")
def _(spark, sf):
    """Relations that can't both hold."""
    return G.contradictions(relations(spark, sf))


@register("v33_accepted", f"""WITH {REL}, c AS (SELECT * FROM (VALUES ('counters', 'supports'), ('supports', 'counters'), ('enables', 'prevents'), ('prevents', 'enables')) v(t, o)),
j AS (SELECT m.*, (SELECT max(r.confidence) FROM mer r JOIN c ON c.t = m.relation_type AND r.relation_type = c.o WHERE r.subject = m.subject AND r.object = m.object AND r.condition = m.condition) AS rival FROM mer m)
SELECT CASE WHEN rival >= confidence THEN 'quarantined' WHEN confidence < 0.5 THEN 'review' ELSE 'accepted' END AS status, count(*) AS n FROM j GROUP BY 1""")
def _(spark, sf):
    """What is accepted, what waits for review, what is set aside for a contradiction."""
    return G.accepted(relations(spark, sf), 0.5).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("v32_compile_reasons", f"""WITH {REL} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN relation_type NOT IN ('counters', 'supports', 'enables') THEN 'unknown_type' WHEN NOT confidence BETWEEN 0 AND 0.8 THEN 'bad_confidence' END AS reason FROM rel) GROUP BY 1""")
def _(spark, sf):
    """Candidates with the first rule they break; none is dropped."""
    r = relations(spark, sf).withColumn("confidence", F.when(F.col("confidence") <= 0.8, F.col("confidence")).otherwise(F.lit(2.0)))
    return G.compiled(r, ("counters", "supports", "enables")).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("v25_graph_violations", """WITH n AS (SELECT s_suppkey AS id, s_nationkey AS at FROM supplier), e AS (SELECT s_suppkey AS src, s_suppkey + 1 AS dst FROM supplier UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)
SELECT DISTINCT rule, id FROM (SELECT 'end_missing' AS rule, src || '>' || dst AS id FROM e WHERE dst NOT IN (SELECT id FROM n) UNION ALL SELECT 'loop', src || '>' || dst FROM e WHERE src = dst UNION ALL SELECT 'other_source', src || '>' || dst FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.at <> b.at)""")
def _(spark, sf):
    """What breaks the rules of a graph."""
    s = table(spark, sf, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("source_id"))
    edges = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst")).union(s.where("s_suppkey % 10 = 0").select("s_suppkey", "s_suppkey"))
    return G.violations(nodes, edges)


@register("v26_first_edges", """SELECT src, dst, min(owner) AS owner FROM (SELECT s_nationkey AS src, s_suppkey % 25 AS dst, 0 AS owner FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_nationkey, s_suppkey % 25, 1 FROM supplier) GROUP BY 1, 2""")
def _(spark, sf):
    """Edges of several lists, the first list's win."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 25).alias("dst"), "s_suppkey")
    return G.first_edges([s.where("s_suppkey % 2 = 0").drop("s_suppkey"), s.drop("s_suppkey")], ["src", "dst"])


@register("x16_disagreements", """SELECT src, dst, CASE WHEN a THEN 'first' ELSE 'second' END AS only_in FROM (SELECT src, dst, bool_or(w = 'a') AS a, bool_or(w = 'b') AS b FROM (SELECT s_nationkey AS src, s_suppkey % 7 AS dst, 'a' AS w FROM supplier UNION ALL SELECT c_nationkey, c_custkey % 5, 'b' FROM customer) GROUP BY 1, 2) WHERE a <> b""")
def _(spark, sf):
    """Edges that only one of two sets holds."""
    a = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 7).alias("dst"))
    b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 5).alias("dst"))
    return G.disagreements(a, b, ["src", "dst"])


@register("v27_bounded_search", f"""WITH RECURSIVE {REL}, e AS (SELECT subject AS a, object AS b, confidence AS c FROM mer WHERE relation_type = 'needs' AND condition = 'R' AND confidence >= 0.9 UNION ALL SELECT object, subject, confidence FROM mer WHERE relation_type = 'needs' AND condition = 'R' AND confidence >= 0.9),
h1 AS (SELECT b AS node, 1 AS hop, max(c) AS c FROM e WHERE a = 's7' AND b <> 's7' GROUP BY 1), h2 AS (SELECT e.b AS node, 2 AS hop, max(e.c) AS c FROM e JOIN h1 ON e.a = h1.node WHERE e.b <> 's7' AND e.b NOT IN (SELECT node FROM h1) GROUP BY 1)
SELECT node, hop, round(c, 6) AS confidence FROM (SELECT 's7' AS node, 0 AS hop, 1.0::DOUBLE AS c UNION ALL FROM h1 UNION ALL FROM h2)""")
def _(spark, sf):
    """What a node reaches in two steps over trusted relations with evidence."""
    r = G.merged(relations(spark, sf)).where("relation_type = 'needs' AND condition = 'R' AND confidence >= 0.9")
    return G.bounded_search(r, ["s7"], 2, 1000).select("node", "hop", F.round("confidence", 6).alias("confidence"))


@register("v17_tree_depths", """WITH RECURSIVE w AS (SELECT l_orderkey AS sentence, l_linenumber::INT AS word, (l_linenumber // 2)::INT AS head FROM lineitem),
t AS (SELECT sentence, word, 0 AS depth FROM w WHERE head = 0 UNION ALL SELECT w.sentence, w.word, t.depth + 1 FROM w JOIN t ON w.sentence = t.sentence AND w.head = t.word) SELECT DISTINCT sentence, word, depth FROM t""")
def _(spark, sf):
    """Depths in dependency trees."""
    w = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sentence"), F.col("l_linenumber").cast("int").alias("word"), F.floor(F.col("l_linenumber") / 2).cast("int").alias("head"))
    return G.tree_depths(w)


@register("v18_boundary_status", """WITH s AS (SELECT doc_id, doc_id % 7 AS a, doc_id % 7 + 3 + doc_id % 5 AS b FROM documents), t AS (SELECT doc_id, k * 3 AS x, k * 3 + 3 AS y FROM documents, range(0, 5) r(k)),
j AS (SELECT s.doc_id, a, b, min(x) AS x, max(y) AS y, count(x) AS n FROM s LEFT JOIN t ON s.doc_id = t.doc_id AND a < y AND b > x GROUP BY 1, 2, 3)
SELECT doc_id, CASE WHEN n = 0 THEN 'UNALIGNED' WHEN a = x AND b = y AND n = 1 THEN 'EXACT' WHEN a = x AND b = y THEN 'TOKEN_ALIGNED' ELSE 'PARTIAL' END AS status FROM j""")
def _(spark, sf):
    """Whether spans end where tokens do."""
    i = F.col("doc_id")
    s = table(spark, sf, "documents").select("doc_id", (i % 7).alias("a"), (i % 7 + 3 + i % 5).alias("b"))
    t = table(spark, sf, "documents").select(i.alias("d"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("d", (F.col("k") * 3).alias("x"), (F.col("k") * 3 + 3).alias("y"))
    j = s.join(t, (s["doc_id"] == t["d"]) & (F.col("a") < F.col("y")) & (F.col("b") > F.col("x")), "left").groupBy("doc_id", "a", "b").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.count("x").alias("n"))
    return j.select("doc_id", G.boundary_status(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.col("n")).alias("status"))


# Changes to tables


def halves(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)


_HALVES = "o AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


@register("k1_insert_or_ignore", f"WITH {_HALVES} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def _(spark, sf):
    """Rows whose key is new are added."""
    old, new = halves(spark, sf)
    return U.insert_or_ignore(old, new, ["c_custkey"])


@register("k2_append_numbered", """SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region UNION ALL SELECT 4 + row_number() OVER (ORDER BY n_name), n_name FROM nation""")
def _(spark, sf):
    """K2: rows are added with the next ids."""
    old = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return U.append_numbered(old, table(spark, sf, "nation").select(F.col("n_name").alias("name")), "id", ["name"])


@register("k3_status_update", f"WITH {VIDEOS} SELECT video_id, CASE WHEN status = 'pending' AND length(transcription) > 500 THEN 'transcribed' ELSE status END AS status FROM videos")
def _(spark, sf):
    """K3: a status moves on where a condition holds."""
    v = videos(spark, sf)
    return U.update_where(v, (F.col("status") == "pending") & (F.length("transcription") > 500), {"status": F.lit("transcribed")}).select("video_id", "status")


@register("k4_score_update", f"WITH {_HALVES} SELECT o.c_custkey, o.c_mktsegment, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM o LEFT JOIN n USING (c_custkey)")
def _(spark, sf):
    """K4: scores take new values where there are some."""
    old, new = halves(spark, sf)
    return U.update_from(old, new, ["c_custkey"], ["c_acctbal"]).select("c_custkey", "c_mktsegment", "c_acctbal")


@register("k5_upsert", f"WITH {_HALVES} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def _(spark, sf):
    """Rows replace those of their key, or are added."""
    old, new = halves(spark, sf)
    return U.upsert(old, new, ["c_custkey"])


@register("k7_sync_counts", f"""WITH {_HALVES} SELECT 'customer' AS "table", count(*) FILTER (o.c_custkey IS NULL) AS inserted, count(*) FILTER (o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL) AS updated, count(*) FILTER (n.c_custkey IS NULL) AS untouched FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def _(spark, sf):
    """K7: what a synchronisation would do, without doing it."""
    old, new = halves(spark, sf)
    return U.sync_counts({"customer": (old, new, ["c_custkey"])})


@register("k9_replace_owned", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1 UNION ALL SELECT DISTINCT l_orderkey, l_linenumber + 100 FROM lineitem WHERE l_orderkey % 2 = 0""")
def _(spark, sf):
    """K9: an owner's rows give way to new ones."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return U.replace_owned(l, l.where("l_orderkey % 2 = 0").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber")), ["l_orderkey"])


@register("k11_cascading_delete", """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1""")
def _(spark, sf):
    """Documents go, and their facts with them."""
    o, l = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), table(spark, sf, "lineitem")
    return U.remove(o, l, "l_orderkey", F.col("o_orderpriority").startswith("1"))[1].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@register("k12_reset", f"WITH {VIDEOS} SELECT video_id, CASE WHEN game = 'fr' THEN 'pending' ELSE status END AS status FROM videos")
def _(spark, sf):
    """Documents to do again get their first status, and their facts go."""
    v = videos(spark, sf)
    return U.reset(v, v, "video_id", F.col("game") == "fr", "pending")[0].select("video_id", "status")


@register("k13_constraints", """SELECT 'key' AS "constraint", 0::BIGINT AS rows UNION ALL SELECT 'range:l_discount', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) FROM lineitem UNION ALL SELECT 'required:l_returnflag', count(*) FILTER (l_returnflag IS NULL OR trim(l_returnflag) = '') FROM lineitem""")
def _(spark, sf):
    """Constraints as queries that count what breaks them."""
    l = table(spark, sf, "lineitem").withColumn("k", F.monotonically_increasing_id())
    return U.constraint_violations(l, ["k"], {"l_discount": (0, 0.05)}, ["l_returnflag"])


@register("k14_category_rewrite", """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|tin') THEN 'hard' WHEN regexp_matches(lower(p_type), 'copper') THEN 'soft' ELSE p_type END AS category FROM part""")
def _(spark, sf):
    """Categories rewritten by pattern."""
    t = F.lower("p_type")
    return table(spark, sf, "part").select("p_partkey", F.when(t.rlike("steel|tin"), "hard").when(t.rlike("copper"), "soft").otherwise(F.col("p_type")).alias("category"))


@register("r1_pending_work", f"WITH {VIDEOS} SELECT video_id, row_number() OVER (ORDER BY game, video_id) AS place FROM videos WHERE status IN ('pending', 'transcribed') AND coalesce(source, '') <> 'aoe2_wiki'")
def _(spark, sf):
    """What is still to be done, in order."""
    from pyspark.sql import Window as W

    v = videos(spark, sf).where(F.col("status").isin("pending", "transcribed") & (F.coalesce("source", F.lit("")) != "aoe2_wiki"))
    return v.select("video_id", F.row_number().over(W.orderBy("game", "video_id")).cast("long").alias("place"))


@register("r3_daily_quota", """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS asked, greatest(0, count(*) - 3) AS refused FROM events GROUP BY 1, 2""")
def _(spark, sf):
    """Requests by user and day, and those over the quota."""
    e = table(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("asked"))
    return e.select("user_id", "day", "asked", F.greatest(F.lit(0).cast("long"), F.col("asked") - 3).alias("refused"))


@register("x9_listed_lookup", """SELECT id, c_name IS NULL AS unknown FROM (SELECT unnest([3, 1, 999999999, 7]) AS id) LEFT JOIN customer ON c_custkey = id""")
def _(spark, sf):
    """Rows by listed ids, unknown ones marked."""
    ids = spark.createDataFrame([(3,), (1,), (999_999_999,), (7,)], "id int")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return ids.join(c, ids["id"] == c["c_custkey"], "left").select("id", F.col("c_name").isNull().alias("unknown"))


@register("x28_fold_audit", """SELECT source, doc_id % 5 AS fold, count(*) AS rows, count(DISTINCT lang) AS langs FROM documents GROUP BY 1, 2""")
def _(spark, sf):
    """What each fold holds."""
    return table(spark, sf, "documents").groupBy("source", (F.col("doc_id") % 5).alias("fold")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("lang").alias("langs"))


@register("x30_feature_maps", """SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders""")
def _(spark, sf):
    """Features written as key=value lists."""
    o = table(spark, sf, "orders").withColumn("feats", F.concat(F.lit("Status="), "o_orderstatus", F.lit("|Priority="), "o_orderpriority"))
    m = F.str_to_map("feats", F.lit("\\|"), F.lit("="))
    return o.select("o_orderkey", m["Status"].alias("status"), m["Priority"].alias("priority"))


@register("x40_json_records", """SELECT o_custkey, list_sort(list(o_orderkey)) AS ids FROM orders GROUP BY 1""")
def _(spark, sf):
    """Lists written as JSON and read back."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list("o_orderkey"))).alias("j"))
    return g.select("o_custkey", F.from_json("j", "array<long>").alias("ids"))
