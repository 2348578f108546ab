"""Scans, projections, joins, aggregations, ranking, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ranking
from tessera.session import table

from .base import INSIGHTS, VIDEOS, insights, videos

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# Scans


@register("s4_filtered_vectors", f"""WITH {INSIGHTS}, {VIDEOS}
SELECT i.id, i.insight_type, coalesce(v.source, 'discord') AS source,
       CASE WHEN i.subject_type IS NOT NULL THEN i.subject ELSE coalesce(v.subject, v.champion) END AS subject, len(i.embedding)::BIGINT AS dims
FROM insights i JOIN videos v ON i.video_id = v.video_id
WHERE lower(v.role) = lower('MID') AND i.game = 'en'""")
def _(spark, sf):
    """Facts with their documents, effective subject, optional filters."""
    return ranking.filtered_facts(insights(spark, sf), videos(spark, sf), role="MID", game="en").select("id", "insight_type", "source", "subject", F.size("embedding").cast("long").alias("dims"))


@register("s5_many_sources_concat", """SELECT source_db, count(*) AS n, min(custkey) AS low, max(custkey) AS high FROM (
  SELECT 'even' AS source_db, c_custkey AS custkey FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'odd', c_custkey FROM customer WHERE c_custkey % 2 = 1) GROUP BY ALL""")
def _(spark, sf):
    """Several stores as one table, marked by store; stores that are missing are skipped."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    stores = {"even": c.where("custkey % 2 = 0"), "odd": c.where("custkey % 2 = 1"), "missing": None}
    return ranking.concat_stores(stores).groupBy("source_db").agg(F.count(F.lit(1)).alias("n"), F.min("custkey").alias("low"), F.max("custkey").alias("high"))


@register("s6_typed_payloads", """SELECT c_custkey AS id, coalesce(nullif(trim(c_mktsegment), ''), 'none') AS segment, coalesce(c_acctbal, 0.0::DOUBLE) AS balance, c_acctbal > 0 AS active FROM customer""")
def _(spark, sf):
    """Rows as typed payloads with defaults for null and blank."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(T.non_empty(F.col("c_mktsegment")), F.lit("none")).alias("segment"), F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"), (F.col("c_acctbal") > 0).alias("active"))


@register("s9_first_alias", """SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.missing')), ''), nullif(trim(json_extract_string(props, '$.k')), ''), 'none') AS picked FROM events""")
def _(spark, sf):
    """The first alias that holds something."""
    k = [F.get_json_object("props", f"$.{a}") for a in ("missing", "k")]
    return table(spark, sf, "events").select("event_id", F.coalesce(T.non_empty(*k), F.lit("none")).alias("picked"))


@register("s20_ranked_values", """SELECT p_brand AS brand, string_agg(v, '/' ORDER BY low, v) AS listing FROM (
  SELECT p_brand, p_size::VARCHAR AS v, min(p_partkey) AS low FROM part GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    """Distinct values in order of first appearance, joined by slashes."""
    p = table(spark, sf, "part").groupBy("p_brand", F.col("p_size").cast("string").alias("v")).agg(F.min("p_partkey").alias("low"))
    return p.groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "v"))), lambda x: x["v"]), "/").alias("listing"))


@register("s21_json_values", """SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1""")
def _(spark, sf):
    """Fields out of JSON columns, with a schema."""
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))


# Projections and predicates


@register("p3_general_only", f"""WITH {INSIGHTS} SELECT id, coalesce(subject_type, 'general') AS scope FROM insights WHERE game <> 'en' OR coalesce(subject_type, 'general') = 'general'""")
def _(spark, sf):
    """One game without a subject shows general facts only."""
    scope = F.coalesce("subject_type", F.lit("general"))
    return insights(spark, sf).where((F.col("game") != "en") | (scope == "general")).select("id", scope.alias("scope"))


_WEIGHT = """CASE source WHEN 'discord' THEN 1.6::DOUBLE WHEN 'aoe2_crossref' THEN 0.9 WHEN 'aoe2_wiki' THEN 1.1 WHEN 'aoe2_pdf' THEN 2.0 WHEN 'aoe2_video' THEN 1.0
  ELSE (CASE lower(rank) WHEN 'emerald' THEN 0.7::DOUBLE WHEN 'master' THEN 1.4 WHEN 'grandmaster' THEN 1.8 WHEN 'challenger' THEN 2.0 ELSE 1.0 END) * (1 + least(greatest((rating - 8.5) * 0.05, 0), 0.15)) END"""


@register("p5_source_weight", f"WITH {INSIGHTS} SELECT id, round({_WEIGHT}, 6) AS weight FROM insights")
def _(spark, sf):
    """P5: trust in a source; guides by rank and rating."""
    return insights(spark, sf).select("id", F.round(ranking.source_weight(F.col("source"), F.col("rank"), F.col("rating")), 6).alias("weight"))


@register("p6_source_label", f"""WITH {INSIGHTS} SELECT id, CASE source WHEN 'discord' THEN 'Coaching session' WHEN 'mobafire_guide' THEN concat_ws(' · ', 'Guide', role, 'rated ' || printf('%.1f', rating)) WHEN 'aoe2_wiki' THEN 'Wiki' ELSE 'Other: ' || source END AS label FROM insights""")
def _(spark, sf):
    """A readable label of a source."""
    guide = F.concat_ws(" · ", F.lit("Guide"), F.col("role"), F.concat(F.lit("rated "), F.format_string("%.1f", "rating")))
    label = F.when(F.col("source") == "discord", "Coaching session").when(F.col("source") == "mobafire_guide", guide).when(F.col("source") == "aoe2_wiki", "Wiki").otherwise(F.concat(F.lit("Other: "), "source"))
    return insights(spark, sf).select("id", label.alias("label"))


@register("p7_preferred_bonus", f"""WITH {INSIGHTS} SELECT id, round(coalesce(greatest(0, 0.12 - 0.02 * (list_position(['type2', 'type0', 'type3'], insight_type) - 1)), 0)::DOUBLE, 6) AS bonus FROM insights""")
def _(spark, sf):
    """A bonus for preferred types that falls with the place in the list."""
    return insights(spark, sf).select("id", F.round(ranking.preferred_bonus(F.col("insight_type"), ["type2", "type0", "type3"]), 6).alias("bonus"))


@register("p8_confidence_bands", f"""WITH {INSIGHTS} SELECT CASE WHEN coalesce(confidence, 0.5) >= 0.6 THEN 'high' WHEN coalesce(confidence, 0.5) >= 0.3 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM insights GROUP BY 1""")
def _(spark, sf):
    """Facts by band of confidence."""
    return insights(spark, sf).groupBy(ranking.confidence_band(F.coalesce("confidence", F.lit(0.5))).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("p9_grounding_flags", f"""WITH {INSIGHTS} SELECT id, source_score < 0.3 AS weak FROM insights WHERE source_score IS NOT NULL""")
def _(spark, sf):
    """Facts that their source hardly supports."""
    return insights(spark, sf).where("source_score IS NOT NULL").select("id", (F.col("source_score") < 0.30).alias("weak"))


@register("p10_predicates", """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority NOT IN ('5-LOW') AND o_totalprice BETWEEN 1000 AND 200000 AND trim(o_orderpriority) <> '' AND o_custkey IS NOT NULL""")
def _(spark, sf):
    """P10: lists, ranges, null and blank tests, all pushed to the scan."""
    o = table(spark, sf, "orders")
    return o.where(F.col("o_orderstatus").isin("O", "P") & ~F.col("o_orderpriority").isin("5-LOW") & F.col("o_totalprice").between(1000, 200000) & (F.trim("o_orderpriority") != "") & F.col("o_custkey").isNotNull()).select("o_orderkey", "o_orderpriority")


@register("p11_candidate_filter_chain", """SELECT doc_id, n_chars FROM documents
WHERE (n_chars = 0 OR n_chars BETWEEN 300 AND 21600) AND lang = 'en' AND NOT regexp_matches(lower(text), 'license|idiot') AND regexp_matches(lower(text), 'the') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
ORDER BY n_chars DESC, doc_id LIMIT 50""")
def _(spark, sf):
    """Documents to fetch: new, of fitting length, not blocked, on topic; the longest fifty."""
    d = table(spark, sf, "documents").where((F.col("n_chars") == 0) | F.col("n_chars").between(300, 21600))
    d = d.where((F.col("lang") == "en") & ~F.lower("text").rlike("license|idiot") & F.lower("text").rlike("the"))
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "n_chars")


@register("p12_english_title", """SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AND NOT regexp_matches(lower(text), '(espa|deutsch|fran)') AS english FROM documents""")
def _(spark, sf):
    """Titles without other than ASCII or language marks."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", (~t.rlike(r"[^\x00-\x7F]") & ~F.lower(t).rlike("(espa|deutsch|fran)")).alias("english"))


@register("p13_low_signal", """SELECT doc_id, len(w) < 550 OR len(list_filter(l, lambda x: length(x) >= 40)) < 18 OR len(list_filter(l, lambda x: regexp_matches(x, '[.!?]'))) < 10 AS low_signal
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS l FROM documents)""")
def _(spark, sf):
    """Documents with few words, long lines or sentences."""
    d = table(spark, sf, "documents").select("doc_id", F.array_remove(F.split("text", "[ \n\t]+"), "").alias("w"), F.split("text", "\n").alias("l"))
    low = (F.size("w") < 550) | (F.size(F.filter("l", lambda x: F.length(x) >= 40)) < 18) | (F.size(F.filter("l", lambda x: x.rlike("[.!?]"))) < 10)
    return d.select("doc_id", low.alias("low_signal"))


@register("p14_quality_gate", f"""WITH {INSIGHTS} SELECT id FROM insights WHERE role IN ('top', 'jungle') OR rating >= 8.5""")
def _(spark, sf):
    """Guides of top rank, or rated well."""
    return insights(spark, sf).where(F.col("role").isin("top", "jungle") | (F.col("rating") >= 8.5)).select("id")


@register("p15_case_order", """SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders""")
def _(spark, sf):
    """An order by listed values."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "3-MEDIUM", 1).otherwise(2)
    return ranking.numbered(table(spark, sf, "orders").select("o_orderkey", rank.alias("rank")), ["rank"], "o_orderkey", "place").select("o_orderkey", "place")


@register("p16_enum_alias", """SELECT doc_id, coalesce(MAP {'en': 'english', 'fr': 'french'}[lang], lang) AS label FROM documents""")
def _(spark, sf):
    """Aliases of listed values; others pass."""
    return table(spark, sf, "documents").select("doc_id", ranking.aliased(F.col("lang"), {"en": "english", "fr": "french"}).alias("label"))


@register("p17_two_lists", """SELECT doc_id, CASE WHEN a - b >= 2 THEN 'first' WHEN b - a >= 2 THEN 'second' ELSE 'uncertain' END AS verdict
FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'tion')) AS a, len(regexp_extract_all(lower(text), 'ing')) AS b FROM documents)""")
def _(spark, sf):
    """Two lists of marks, a margin of two, else uncertain."""
    a, b = (F.regexp_count(F.lower("text"), F.lit(x)) for x in ("tion", "ing"))
    return table(spark, sf, "documents").select("doc_id", F.when(a - b >= 2, "first").when(b - a >= 2, "second").otherwise("uncertain").alias("verdict"))


@register("p18_status_by_flags", """SELECT o_custkey AS custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'conflict' WHEN count(DISTINCT o_orderpriority) >= 3 THEN 'trusted' WHEN count(*) > 1 THEN 'supported' ELSE 'candidate' END AS status FROM orders GROUP BY 1""")
def _(spark, sf):
    """A status from flags gathered over a group."""
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("p"), F.countDistinct("o_orderpriority").alias("d"), F.count(F.lit(1)).alias("n"))
    return g.select("custkey", F.when(F.col("p"), "conflict").when(F.col("d") >= 3, "trusted").when(F.col("n") > 1, "supported").otherwise("candidate").alias("status"))


@register("p19_inspector_filters", f"""WITH {INSIGHTS} SELECT id FROM insights WHERE contains(lower(text), 'tion') AND list_contains([insight_type, role], 'mid') AND coalesce(confidence, 0) >= 0.25""")
def _(spark, sf):
    """Substring, membership and least confidence together."""
    return insights(spark, sf).where(F.lower("text").contains("tion") & F.array_contains(F.array("insight_type", "role"), "mid") & (F.coalesce("confidence", F.lit(0.0)) >= 0.25)).select("id")


# Joins


@register("j1_facts_with_documents", f"""WITH {INSIGHTS}, {VIDEOS} SELECT v.status, count(*) AS n, count(DISTINCT i.video_id) AS documents FROM insights i JOIN videos v USING (video_id) GROUP BY 1""")
def _(spark, sf):
    """Facts join their documents by id."""
    return insights(spark, sf).join(videos(spark, sf).select("video_id", "status"), "video_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video_id").alias("documents"))


@register("j2_composite_key", """SELECT l_returnflag, count(*) AS n FROM lineitem l JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) f ON l.l_orderkey = f.l_orderkey AND l.l_linenumber = f.l_linenumber GROUP BY 1""")
def _(spark, sf):
    """A join on two keys."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    first = l.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    return l.join(first, ["l_orderkey", "l_linenumber"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@register("j3_left_lower_key", f"""WITH {VIDEOS} SELECT v.video_id, c.n FROM videos v LEFT JOIN (SELECT lower(source) AS k, count(*) AS n FROM documents GROUP BY 1) c ON lower(v.champion) = c.k""")
def _(spark, sf):
    """A left join on keys without case."""
    c = table(spark, sf, "documents").groupBy(F.lower("source").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return videos(spark, sf).select("video_id", F.lower("champion").alias("k")).join(c, "k", "left").select("video_id", "n")


@register("j4_unrated", """SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)""")
def _(spark, sf):
    """Rows without a partner."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@register("j6_exists", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def _(spark, sf):
    """Rows with some partner."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@register("j7_counts_with_zero", """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    """Counts of partners, none included; orders are counted before the join."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@register("j21_evidence_required", """SELECT o_orderkey, list_sort(list(l_linenumber)) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1""")
def _(spark, sf):
    """Owners with their evidence; those without any drop out."""
    l = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    return table(spark, sf, "orders").select("o_orderkey").join(l, "o_orderkey").select("o_orderkey", "lines")


@register("j22_listed_ids", """SELECT q.query_id, avg(o_totalprice) AS mean_price, count(*) AS found FROM (
  SELECT c_custkey AS query_id, unnest([c_custkey, c_custkey + 1, c_custkey + 2]) AS id FROM customer) q JOIN orders ON o_orderkey = q.id GROUP BY 1""")
def _(spark, sf):
    """Ids out of JSON lists, looked up."""
    c = F.col("c_custkey")
    q = table(spark, sf, "customer").select(c.alias("query_id"), F.to_json(F.array(c, c + 1, c + 2)).alias("ids"))
    q = q.select("query_id", F.explode(F.from_json("ids", "array<long>")).alias("o_orderkey"))
    return q.join(table(spark, sf, "orders"), "o_orderkey").groupBy("query_id").agg(F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("found"))


@register("j23_compare_two", """SELECT 'BRAND' AS what, abs(a - b) >= 100 AS apart FROM (SELECT avg(p_retailprice) FILTER (p_size <= 10) AS a, avg(p_retailprice) FILTER (p_size > 40) AS b FROM part)""")
def _(spark, sf):
    """Two groups side by side, and whether they lie apart."""
    p = table(spark, sf, "part").agg(F.avg(F.when(F.col("p_size") <= 10, F.col("p_retailprice"))).alias("a"), F.avg(F.when(F.col("p_size") > 40, F.col("p_retailprice"))).alias("b"))
    return p.select(F.lit("BRAND").alias("what"), (F.abs(F.col("a") - F.col("b")) >= 100).alias("apart"))


@register("j8_nearest_in_time", """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
r AS (SELECT p.event_id, v.event_id AS nearest, abs(floor(epoch(p.ts)) - floor(epoch(v.ts)))::BIGINT AS gap,
  row_number() OVER (PARTITION BY p.event_id ORDER BY abs(floor(epoch(p.ts)) - floor(epoch(v.ts))), v.event_id) AS place
  FROM p JOIN v ON p.user_id = v.user_id AND abs(floor(epoch(p.ts)) - floor(epoch(v.ts))) <= 7200)
SELECT event_id, nearest, gap FROM r WHERE place = 1""")
def _(spark, sf):
    """J8 without consumption: the nearest view of the same user within two hours of each purchase."""
    e = table(spark, sf, "events")
    return ranking.nearest_in_time(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", 7200)


@register("j8_nearest_consumed")
def _(spark, sf):
    """Each view is used up by the first purchase (in time order) that it is nearest to."""
    e = table(spark, sf, "events")
    return ranking.nearest_consumed(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", 7200)


# Aggregations


@register("a1_status_pivot", f"""WITH {VIDEOS} SELECT role, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'transcribed') AS transcribed, count(*) FILTER (status = 'analyzed') AS analyzed, count(*) FILTER (status = 'no_transcript') AS no_transcript, count(*) FILTER (status = 'error') AS error FROM videos GROUP BY 1""")
def _(spark, sf):
    """A1: documents by role and status, statuses as columns."""
    return videos(spark, sf).groupBy("role").pivot("status", ["pending", "transcribed", "analyzed", "no_transcript", "error"]).count().fillna(0)


@register("a2_group_counts", f"WITH {VIDEOS} SELECT champion, role, count(*) AS n FROM videos GROUP BY 1, 2")
def _(spark, sf):
    """A2: counts by two keys."""
    return videos(spark, sf).groupBy("champion", "role").agg(F.count(F.lit(1)).alias("n"))


@register("a3_primary_group", """SELECT n_name, coalesce(segment, 'none') AS primary_segment FROM nation LEFT JOIN (
  SELECT c_nationkey, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) x ON c_nationkey = n_nationkey AND r = 1""")
def _(spark, sf):
    """A3: the commonest member of each group, with a fallback."""
    top = ranking.commonest(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment", 1).select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    return table(spark, sf, "nation").join(top, "n_nationkey", "left").select("n_name", F.coalesce("c_mktsegment", F.lit("none")).alias("primary_segment"))


@register("a4_two_commonest", """SELECT c_nationkey, c_mktsegment, r AS place FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r <= 2""")
def _(spark, sf):
    """A4: the two commonest members of each group."""
    return ranking.commonest(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment", 2).select("c_nationkey", "c_mktsegment", F.col("place").cast("long").alias("place"))


@register("a5_distinct_counts", f"WITH {VIDEOS} SELECT count(DISTINCT subject) AS subjects, count(DISTINCT lower(champion)) AS champions, count(DISTINCT game) AS games FROM videos")
def _(spark, sf):
    """A5: exact distinct counts."""
    return videos(spark, sf).agg(F.countDistinct("subject").alias("subjects"), F.countDistinct(F.lower("champion")).alias("champions"), F.countDistinct("game").alias("games"))


@register("a6_percentages", """SELECT lang, round(100.0 * sum(quality) / count(*), 4)::DOUBLE AS good_percent, count(*) FILTER (toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def _(spark, sf):
    """Shares overall and by group."""
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return j.rollup("lang").agg(F.round(100 * F.avg("quality"), 4).alias("good_percent"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@register("a7_commonest_overall", """SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10""")
def _(spark, sf):
    """The commonest groups."""
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@register("a8_tag_frequency", """SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20""")
def _(spark, sf):
    """The commonest tags out of lists."""
    return table(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@register("a12_repetition_weight", """SELECT o_custkey AS custkey, round(ln(1 + count(*)) / ln(5), 6) AS weight FROM orders GROUP BY 1""")
def _(spark, sf):
    """The weight of repetition."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.round(F.log1p(F.count(F.lit(1))) / F.log(F.lit(5.0)), 6).alias("weight"))


_Z = """z AS (SELECT p_partkey, p_brand, p_type, p_retailprice, CASE WHEN n < 3 OR s IS NULL OR s = 0 THEN 0 ELSE (p_retailprice - m) / s END AS z, m FROM (
  SELECT *, count(*) OVER w AS n, avg(p_retailprice) OVER w AS m, stddev_samp(p_retailprice) OVER w AS s FROM part WINDOW w AS (PARTITION BY p_brand)))"""


@register("a13_peer_z_scores", f"WITH {_Z} SELECT p_partkey, round(z, 6) AS z FROM z")
def _(spark, sf):
    """How far a value lies from its peers, in sample deviations; 0 for fewer than three peers."""
    return ranking.peer_z(table(spark, sf, "part"), ["p_brand"], "p_retailprice").select("p_partkey", F.round("z", 6).alias("z"))


@register("a14_percent_difference", f"WITH {_Z} SELECT p_partkey, CASE WHEN d >= 0 THEN '+' ELSE '' END || d || '%' AS apart FROM (SELECT p_partkey, floor((p_retailprice - m) / m * 100 + 0.5)::BIGINT AS d FROM z)")
def _(spark, sf):
    """The difference from the peers' mean as a signed percentage."""
    d = F.floor((F.col("p_retailprice") - F.col("mean")) / F.col("mean") * 100 + 0.5)
    z = ranking.peer_z(table(spark, sf, "part"), ["p_brand"], "p_retailprice")
    return z.select("p_partkey", F.concat(F.when(d >= 0, "+").otherwise(""), d.cast("string"), F.lit("%")).alias("apart"))


@register("a15_peer_choice", """WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN b.n >= 3 AND b.n >= t.n THEN 'brand' WHEN t.n >= 3 THEN 'type' ELSE 'all' END AS peers FROM part JOIN b USING (p_brand) JOIN t USING (p_type)""")
def _(spark, sf):
    """The larger of two peer groups, everything where both are small."""
    p = table(spark, sf, "part")
    b, t = (F.count(F.lit(1)).over(W.partitionBy(c)) for c in ("p_brand", "p_type"))
    return p.select("p_partkey", F.when((b >= 3) & (b >= t), "brand").when(t >= 3, "type").otherwise("all").alias("peers"))


@register("a16_anomaly_notes", """WITH u AS (SELECT p_brand, p_partkey, stat, v FROM (UNPIVOT (SELECT p_brand, p_partkey, p_retailprice AS price, p_size::DOUBLE AS size FROM part) ON price, size INTO NAME stat VALUE v)),
z AS (SELECT p_partkey, stat, CASE WHEN count(*) OVER w < 3 OR coalesce(stddev_samp(v) OVER w, 0) = 0 THEN 0 ELSE (v - avg(v) OVER w) / stddev_samp(v) OVER w END AS z FROM u WINDOW w AS (PARTITION BY p_brand, stat))
SELECT p_partkey, stat, CASE WHEN z > 0 THEN 'high' ELSE 'low' END || ' ' || stat AS note FROM z WHERE abs(z) >= 1.5""")
def _(spark, sf):
    """Notes on values far from their peers, over several statistics at once."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    z = ranking.peer_z(p.unpivot(["p_brand", "p_partkey"], ["price", "size"], "stat", "v"), ["p_brand", "stat"], "v")
    return z.where(F.abs("z") >= 1.5).select("p_partkey", "stat", F.concat(F.when(F.col("z") > 0, "high ").otherwise("low "), "stat").alias("note"))


@register("a17_any_tag", """SELECT p_brand, bool_or(list_has_any(string_split(p_type, ' '), ['STEEL', 'BRASS'])) AS metal FROM part GROUP BY 1""")
def _(spark, sf):
    """Whether any row of a group carries one of the tags."""
    return table(spark, sf, "part").groupBy("p_brand").agg(F.bool_or(F.arrays_overlap(F.split("p_type", " "), F.array(F.lit("STEEL"), F.lit("BRASS")))).alias("metal"))


# Ranking, limits and sets


@register("w4_consecutive_duplicates", """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def _(spark, sf):
    """Rows that repeat the one before are dropped."""
    return ranking.drop_consecutive(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@register("w8_best_per_group", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def _(spark, sf):
    """The best row of each group, by max_by on an ordered struct (no sort)."""
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct(F.col("o_totalprice"), -F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@register("w10_padded_aliases", f"""WITH {INSIGHTS} SELECT id, 'c' || lpad(row_number() OVER (PARTITION BY video_id ORDER BY id)::VARCHAR, 3, '0') AS alias FROM insights""")
def _(spark, sf):
    """Aliases numbered within a group."""
    return insights(spark, sf).select("id", F.concat(F.lit("c"), F.lpad(F.row_number().over(W.partitionBy("video_id").orderBy("id")).cast("string"), 3, "0")).alias("alias"))


@register("w11_focal_groups", """SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS request FROM lineitem""")
def _(spark, sf):
    """Rows that share a start go into one request."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.dense_rank().over(W.partitionBy("l_orderkey").orderBy("l_shipdate")).cast("long").alias("request"))


@register("l5_many_keys", """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY (o_orderstatus = 'F') DESC, o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25""")
def _(spark, sf):
    """A limit after an order by several keys."""
    return table(spark, sf, "orders").orderBy(F.desc(F.col("o_orderstatus") == "F"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@register("l6_largest_deviations", f"WITH {_Z} SELECT p_partkey, round(z, 6) AS z FROM z ORDER BY abs(round(z, 6)) DESC, p_partkey LIMIT 20")
def _(spark, sf):
    """The largest deviations, either way."""
    z = ranking.peer_z(table(spark, sf, "part"), ["p_brand"], "p_retailprice").select("p_partkey", F.round("z", 6).alias("z"))
    return z.orderBy(F.desc(F.abs("z")), "p_partkey").limit(20)


@register("l7_nulls_last", f"WITH {INSIGHTS} SELECT id, source_score FROM insights ORDER BY source_score DESC NULLS LAST, id LIMIT 40")
def _(spark, sf):
    """A descending order with nulls last."""
    return insights(spark, sf).orderBy(F.desc_nulls_last("source_score"), "id").limit(40).select("id", "source_score")


@register("l8_even_subsample", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
t AS (SELECT round_even(k * (n - 1) / 19.0, 0)::BIGINT AS i FROM (SELECT DISTINCT n FROM r), range(20) x(k)) SELECT DISTINCT o_orderkey FROM r JOIN t USING (i)""")
def _(spark, sf):
    """Twenty of a long list, evenly spaced, both ends included."""
    return ranking.evenly(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 20)


@register("l9_fill_slots", """WITH a AS (SELECT p_partkey, p_name, 0 AS tier, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size = 1),
f AS (SELECT * FROM a WHERE r <= 12), b AS (SELECT p_partkey, p_name, 1 AS tier, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size = 2 AND p_name NOT IN (SELECT p_name FROM f))
SELECT p_partkey FROM (SELECT *, row_number() OVER (ORDER BY tier, r) AS place FROM (SELECT * FROM f UNION ALL SELECT * FROM b)) WHERE place <= 30""")
def _(spark, sf):
    """Slots left over are filled from a second list, without its repeats of the first."""
    p = table(spark, sf, "part").withColumn("score", F.col("p_retailprice"))
    return ranking.fill_slots(p.where("p_size = 1"), p.where("p_size = 2"), "p_name", "p_partkey", first=12, total=30).select("p_partkey")


@register("l10_quota_sample")
def _(spark, sf):
    """A quota for each language, one document a source, then the best of the rest."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"), F.concat_ws("-", "source", F.col("doc_id") % 10).alias("origin"), F.col("n_chars").cast("double").alias("score"))
    return ranking.quota_sample(d, least=3, total=20)


@register("u2_union_distinct", """SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT DISTINCT c_mktsegment FROM customer""")
def _(spark, sf):
    """The union of name sets."""
    a, b, c = (table(spark, sf, t).select(F.col(x).alias("name")) for t, x in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment")))
    return a.union(b).union(c).distinct()


@register("u4_tag_overlap", """SELECT a.p_partkey, len(list_intersect(string_split(a.p_type, ' '), ['STANDARD', 'POLISHED', 'TIN'])) AS shared FROM part a WHERE list_has_any(string_split(a.p_type, ' '), ['STANDARD', 'POLISHED', 'TIN'])""")
def _(spark, sf):
    """U4: shared tags."""
    want, tags = F.array(*[F.lit(x) for x in ("STANDARD", "POLISHED", "TIN")]), F.split("p_type", " ")
    return table(spark, sf, "part").where(F.arrays_overlap(tags, want)).select("p_partkey", F.size(F.array_intersect(tags, want)).cast("long").alias("shared"))


@register("u5_ordered_distinct", """SELECT first AS doc_id FROM (SELECT text, min(doc_id) AS first FROM documents GROUP BY text)""")
def _(spark, sf):
    """The first of rows with equal text; a digest stands for the text in the shuffle."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@register("u6_out_of_vocabulary", """SELECT DISTINCT t AS token FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM benchmark) EXCEPT SELECT DISTINCT t FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM documents)""")
def _(spark, sf):
    """Words of the held-out set that the corpus lacks."""
    a, b = (table(spark, sf, t).select(F.explode(T.tokens(F.col("text"))).alias("token")) for t in ("benchmark", "documents"))
    return a.distinct().join(b, "token", "left_anti")


@register("u7_split_isolation", """SELECT a.doc_id AS train_id, b.doc_id AS test_id FROM (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0) a JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 5 = 0) b ON sha256(a.text) = sha256(b.text)""")
def _(spark, sf):
    """Texts that stand on both sides of a split, which should be none."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.where("doc_id % 5 <> 0").withColumnRenamed("doc_id", "train_id").join(d.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "test_id"), "h").drop("h")
