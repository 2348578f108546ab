"""Queries on vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval, vectors
from tessera.session import table

from .base import INSIGHTS, TOKENS_SQL, insights
from .relational import _WEIGHT

QUERIES: dict = {}
SQL: dict[str, str] = {}
QUESTION = "the that of thing the"
ASKED = 7


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def asked_vector(spark, sf, vec_id: int = ASKED) -> list[float]:
    """The embedding that stands for the question."""
    return list(table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def _dot(a: str, b: str) -> str:
    return f"list_inner_product(({a})::DOUBLE[], ({b})::DOUBLE[])"


_Q = f"(SELECT embedding FROM embeddings WHERE vec_id = {ASKED})"


@register("v1_similarities", f"SELECT vec_id, round({_dot('embedding', _Q)}, 6) AS similarity FROM embeddings")
def _(spark, sf):
    """V1: products with a question's vector."""
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), vectors.literal(asked_vector(spark, sf))), 6).alias("similarity"))


@register("v2_unit_vectors", f"SELECT vec_id, round({_dot('u', 'u')}, 6) AS length FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt({_dot('embedding', 'embedding')})) AS u FROM embeddings)")
def _(spark, sf):
    """V2: vectors at length one."""
    u = table(spark, sf, "embeddings").select("vec_id", vectors.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("u"))
    return u.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("length"))


@register("v4_vector_literals", """SELECT vec_id, len(embedding) AS dims, printf('%.4f', embedding[1]::DOUBLE) AS first FROM embeddings""")
def _(spark, sf):
    """V4: dimensions checked, numbers written with fixed digits."""
    return table(spark, sf, "embeddings").where(F.assert_true(F.size("embedding") > 0).isNull()).select("vec_id", F.size("embedding").cast("long").alias("dims"), F.format_string("%.4f", F.col("embedding")[0].cast("double")).alias("first"))


_CENTROIDS = """means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
cents AS (SELECT label, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS norm FROM means GROUP BY label),
units AS (SELECT label, list_transform(v, lambda x: x / norm) AS v FROM cents)"""


@register("a9_centroids", f"WITH {_CENTROIDS} SELECT label, n, round(v[1], 6) AS first, round(v[64], 6) AS last FROM units JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label)")
def _(spark, sf):
    """Mean vectors of groups, at length one."""
    c = vectors.centroids(table(spark, sf, "embeddings"), ["label"], "embedding")
    return c.select("label", "n", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


@register("w5_centroid_neighbours", f"""WITH {_CENTROIDS}, p AS (SELECT a.label, b.label AS other, {_dot('a.v', 'b.v')} AS s FROM units a JOIN units b ON a.label <> b.label)
SELECT label, other, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, other) AS r FROM p WHERE s >= -0.5) WHERE r <= 5""")
def _(spark, sf):
    """The five groups nearest to each group."""
    c = vectors.centroids(table(spark, sf, "embeddings"), ["label"], "embedding").select(F.col("label").cast("long").alias("id"), F.col("label").cast("long").alias("owner"), "vector")
    n = vectors.nearest(c, c, 5, -0.5)
    return n.select(F.col("id").cast("int").alias("label"), F.col("other").cast("int").alias("other"), F.round("similarity", 6).alias("similarity"))


@register("w6_row_neighbours", f"""WITH p AS (SELECT a.vec_id, b.vec_id AS other, {_dot('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0)
SELECT vec_id, other, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, other) AS r FROM p) WHERE r <= 6""")
def _(spark, sf):
    """The six rows nearest to each asked row; rows whose id is divisible by 100 ask, all rows answer."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("owner"), F.col("embedding").alias("vector"))
    return vectors.nearest(e.where("id % 100 = 0"), e, 6).select(F.col("id").alias("vec_id"), "other", F.round("similarity", 6).alias("similarity"))


@register("a10_cluster_scores", f"""WITH {INSIGHTS}, n AS (SELECT a.id, a.source_score, count(b.id) AS neighbours FROM insights a LEFT JOIN insights b ON a.game = b.game AND a.video_id <> b.video_id AND {_dot('a.embedding', 'b.embedding')} >= 0.3 GROUP BY 1, 2)
SELECT id, neighbours, round(least(neighbours / 3.0::DOUBLE, 1), 4)::DOUBLE AS cluster_score, round(0.6::DOUBLE * coalesce(source_score, 0.5) + 0.4::DOUBLE * least(neighbours / 3.0::DOUBLE, 1), 4)::DOUBLE AS confidence FROM n""")
def _(spark, sf):
    """How many documents of the same game say much the same, and the confidence that follows."""
    i = insights(spark, sf).select("id", F.col("video_id").alias("owner"), F.col("embedding").alias("vector"), "source_score", "game")
    return vectors.cluster_scores(i, F.col("game"), 0.3)


@register("a11_greedy_duplicates")
def _(spark, sf):
    """Near-equal facts within a document, greedily in id order."""
    i = insights(spark, sf).select("id", "video_id", F.col("embedding").alias("vector"), "source_score")
    return vectors.greedy_duplicates(i, "video_id", 0.1)


@register("a18_grounding", f"""WITH {INSIGHTS} SELECT a.id, round(max({_dot('a.embedding', 'b.embedding')}), 6) AS source_score FROM insights a JOIN insights b ON a.video_id = b.video_id AND a.id <> b.id GROUP BY 1""")
def _(spark, sf):
    """The best support of a fact among the windows of its document."""
    i = insights(spark, sf)
    w = i.select("video_id", F.col("id").alias("window_id"), F.col("embedding").alias("window_vector"))
    g = vectors.grounding(i.select("id", "video_id", F.col("embedding").alias("vector")), w, "video_id", F.col("id") != F.col("window_id"))
    return g.select("id", F.round("source_score", 6).alias("source_score"))


def _bm25_sql(source: str, score: str = "bm25") -> str:
    parts = " + ".join(
        f"CASE WHEN f_{w} > 0 THEN ln((docs - d_{w} + 0.5::DOUBLE) / (d_{w} + 0.5::DOUBLE) + 1) * f_{w} * 2.5::DOUBLE / (f_{w} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avglen)) ELSE 0 END"
        for w in retrieval.query_terms(QUESTION)
    )
    names = sorted(set(retrieval.query_terms(QUESTION)))
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f_{w}" for w in names)
    dfs = ", ".join(f"count(*) FILTER (f_{w} > 0) AS d_{w}" for w in names)
    return f"""tf AS (SELECT * EXCLUDE t, len(t) AS n, {counts} FROM (SELECT *, {TOKENS_SQL.format('text')} AS t FROM {source})),
st AS (SELECT count(*) AS docs, avg(n) AS avglen, {dfs} FROM tf), bm AS (SELECT tf.*, {parts} AS {score} FROM tf, st)"""


@register("t2_bm25", f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_bm25_sql('src')} SELECT id, round(bm25, 6) AS bm25 FROM bm")
def _(spark, sf):
    """BM25 of every document; a term asked for twice counts twice."""
    return retrieval.bm25(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), QUESTION).select("id", F.round("bm25", 6).alias("bm25"))


@register("l2_lexical_top", f"WITH {INSIGHTS}, {_bm25_sql('insights')} SELECT id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 9) DESC, confidence DESC NULLS LAST, id LIMIT 30")
def _(spark, sf):
    """The best facts by words, then confidence."""
    return retrieval.lexical(insights(spark, sf), QUESTION, 30).select("id", F.round("bm25", 6).alias("bm25"))


@register("w3_rank_fusion", f"""WITH {INSIGHTS}, {_bm25_sql('insights')}, s AS (SELECT *, {_dot('embedding', _Q)} AS sim FROM bm),
v AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS r FROM s), w AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) AS r FROM s)
SELECT id, round(coalesce(1 / (60.0::DOUBLE + v.r), 0) + coalesce(1 / (60.0::DOUBLE + w.r), 0), 9) AS fused FROM (SELECT * FROM v WHERE r <= 50) v FULL JOIN (SELECT * FROM w WHERE r <= 50) w USING (id)""")
def _(spark, sf):
    """Two rankings fused by reciprocal ranks."""
    s = retrieval.bm25(insights(spark, sf), QUESTION).withColumn("sim", vectors.dot(F.col("embedding"), vectors.literal(asked_vector(spark, sf)))).select("id", "bm25", "sim")
    v, w = retrieval.top(s, "sim", 50, "_v").select("id", "_v"), retrieval.top(s, "bm25", 50, "_w").select("id", "_w")
    return v.join(w, "id", "full").select("id", F.round(retrieval.rrf(F.col("_v"), F.col("_w")), 9).alias("fused"))


_BLEND = f"""(0.5::DOUBLE * sim + 0.5::DOUBLE * (0.6::DOUBLE * coalesce(nullif(confidence, 0), 0.5) + 0.4::DOUBLE * coalesce(nullif(source_score, 0), 0.5))
  + CASE insight_type WHEN 'type1' THEN 0.12::DOUBLE WHEN 'type3' THEN 0.10 ELSE 0 END) * ({_WEIGHT})"""


@register("c1_hybrid_retrieve", f"""WITH {INSIGHTS}, {_bm25_sql('insights')}, s AS (SELECT *, {_dot('embedding', _Q)} AS sim FROM bm),
v AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS vr FROM s), w AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) AS wr FROM s),
f AS (SELECT id, coalesce(1 / (60.0::DOUBLE + vr), 0) + coalesce(1 / (60.0::DOUBLE + wr), 0) AS fused, least(vr, wr) AS best FROM (SELECT * FROM v WHERE vr <= 50) FULL JOIN (SELECT * FROM w WHERE wr <= 50) USING (id)),
c AS (SELECT * FROM f ORDER BY round(fused, 12) DESC, best, id LIMIT 60)
SELECT id, insight_type, round(sim, 6) AS score, round(fused, 9) AS fused, round({_BLEND}, 6) AS final FROM s JOIN c USING (id) ORDER BY round({_BLEND}, 9) DESC, id LIMIT 12""")
def _(spark, sf):
    """Hybrid retrieval with fusion and blended re-ranking."""
    r = retrieval.retrieve(insights(spark, sf), QUESTION, asked_vector(spark, sf), 12, ["type1", "type3"])
    return r.select("id", "insight_type", F.round("score", 6).alias("score"), F.round("fused", 9).alias("fused"), F.round("final", 6).alias("final"))


@register("c1_hosted_retrieve", f"""WITH {INSIGHTS}, s AS (SELECT *, {_dot('embedding', _Q)} AS sim FROM insights), c AS (SELECT * FROM s ORDER BY sim DESC, id LIMIT 60)
SELECT id, round(sim, 6) AS score, round({_BLEND}, 6) AS final FROM c ORDER BY round({_BLEND}, 9) DESC, id LIMIT 12""")
def _(spark, sf):
    """C1, C10 hosted: vector ranking, then the blend."""
    r = retrieval.retrieve_hosted(insights(spark, sf), asked_vector(spark, sf), 12, ["type1", "type3"])
    return r.select("id", F.round("score", 6).alias("score"), F.round("final", 6).alias("final"))


@register("c2_pair_retrieve")
def _(spark, sf):
    """Two sides of a comparison, texts once."""
    r = retrieval.retrieve_pair(insights(spark, sf), QUESTION, asked_vector(spark, sf), (F.col("game") == "en", F.col("game") == "fr"), 12)
    return r.select("id", "side", F.round("final", 6).alias("final"))


@register("c3_team_retrieve")
def _(spark, sf):
    """Four members, a share for each."""
    sides = tuple(F.col("role") == r for r in ("top", "jungle", "mid", "support"))
    return retrieval.retrieve_pair(insights(spark, sf), QUESTION, asked_vector(spark, sf), sides, 24).select("id", "side", F.round("final", 6).alias("final"))


@register("c7_sections")
def _(spark, sf):
    """Sections of an overview, each merged and diversified."""
    r = retrieval.sections(insights(spark, sf), {"early": ["type0", "type1"], "late": ["type2"]}, QUESTION, asked_vector(spark, sf), 6)
    return r.select("section", "id", "insight_type", F.round("final", 6).alias("final"))


@register("c8_expanded")
def _(spark, sf):
    """Several wordings of a question."""
    r = retrieval.expanded(insights(spark, sf), ["the of", "that thing", "with one"], asked_vector(spark, sf), 18)
    return r.select("id", F.round("final", 6).alias("final"))


@register("c9_transfer_and_coverage")
def _(spark, sf):
    """What is known of a subject's like, where little is known of itself."""
    i = insights(spark, sf)
    c = vectors.centroids(i, ["subject"], "embedding").withColumn("id", F.substring("subject", 4, 10).cast("long")).withColumn("owner", F.col("id"))
    n = vectors.nearest(c.select("id", "owner", "vector"), c.select("id", "owner", "vector"), 5)
    names = n.select(F.concat(F.lit("src"), "id").alias("subject"), F.concat(F.lit("src"), "other").alias("other"), "similarity")
    return retrieval.transfer(i, names, "SRC3", 15).select("id", "subject", F.round("similarity", 6).alias("similarity"), F.round("score", 4).alias("score"))


@register("l4_merged_lists")
def _(spark, sf):
    """Two result lists as one."""
    i, v = insights(spark, sf), asked_vector(spark, sf)
    r = retrieval.merged([retrieval.retrieve(i, "the", v, 10), retrieval.retrieve(i, "that", v, 10)], 15)
    return r.select("id", F.round("final", 6).alias("final"))


@register("v7_tag_whitelist", """SELECT p_partkey, list_filter(string_split(lower(p_type), ' '), lambda x: x IN ('steel', 'tin', 'small', 'large')) AS tags FROM part""")
def _(spark, sf):
    """V7: tags that are allowed, each once, in order."""
    allowed = F.array(*[F.lit(x) for x in ("steel", "tin", "small", "large")])
    return table(spark, sf, "part").select("p_partkey", F.array_intersect(F.split(F.lower("p_type"), " "), allowed).alias("tags"))


@register("x4_first_wins", """SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY p, v) AS r FROM (SELECT n_regionkey AS k, n_name AS v, 0 AS p FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_regionkey, upper(n_name), 1 FROM nation)) WHERE r = 1""")
def _(spark, sf):
    """A map from several stores, where the first store that has a key wins."""
    n = table(spark, sf, "nation")
    both = n.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("v"), F.lit(0).alias("p")).union(n.select("n_regionkey", F.upper("n_name"), F.lit(1)))
    return both.groupBy("k").agg(F.min(F.struct("p", "v")).alias("m")).select("k", "m.v")

