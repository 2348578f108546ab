"""Queries on canonical names, cues, shares and models that complete the families of the other modules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions import cues
from tessera.functions import spans as S
from tessera.operators import canonical, propositions, retrieval, scoring
from tessera.operators import metrics as M
from tessera.session import table

from .base import INSIGHTS, insights
from .knowledge import QUESTION, asked_vector

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


NAMES = [("Britons",), ("Burgundians",), ("United Kingdom",), ("Saudi Arabia",), ("France",), ("Aztecs",)]
ALIASES = [("Brits", "Britons"), ("u.k.", "United Kingdom"), ("Great Britain", "United Kingdom"), ("aztec", "Aztecs")]
WRITTEN = ("Britons", "briton", "BRITS", "United-Kingdom", "united kingdom", "U.K.", "GreatBritain", "France ", "Franc", "aztec", "Saudi arabia", "saudiarabia", "Peru", "")


@register("t16_canonical_names", f"""WITH names(name) AS (VALUES {_values(NAMES)}), aliases(alias, name) AS (VALUES {_values(ALIASES)}),
k AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g') AS k, 0 AS p FROM names), a AS (SELECT name, regexp_replace(lower(alias), '[^a-z0-9 ]', '', 'g') AS k, 1 AS p FROM aliases),
w AS (SELECT * FROM k UNION ALL SELECT name, replace(k, ' ', ''), 0 FROM k UNION ALL SELECT name, k[:-2], 0 FROM k WHERE k LIKE '%s' UNION ALL SELECT name, replace(k, ' ', '')[:-2], 0 FROM k WHERE k LIKE '%s' UNION ALL SELECT * FROM a UNION ALL SELECT name, replace(k, ' ', ''), 1 FROM a),
l AS (SELECT k, name FROM (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY p DESC, name DESC) AS r FROM w) WHERE r = 1),
c AS (SELECT c_custkey, {list(WRITTEN)!r}[1 + c_custkey % {len(WRITTEN)}] AS written FROM customer)
SELECT c_custkey, written, name AS canonical FROM c LEFT JOIN l ON trim(regexp_replace(lower(trim(written)), '[^a-z0-9 ]', '', 'g')) = l.k""")
def _(spark, sf):
    """Names in any way of writing, as their one form."""
    c = table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(w) for w in WRITTEN]), (F.col("c_custkey") % len(WRITTEN) + 1).cast("int")).alias("written"))
    return canonical.canonical_names(c, "written", spark.createDataFrame(NAMES, "name string"), spark.createDataFrame(ALIASES, "alias string, name string"))


CONCEPTS = ("economy_anodized", "standard", "small", "large", "promo")
CONCEPT_ALIASES = {"economy anodized steel": "economy_anodized", "promo brushed tin": "promo", "large plated brass": "large", "nothing": "unlisted"}


@register("t48_canonical_terms", f"""SELECT p_partkey, CASE WHEN raw IN {CONCEPTS!r} THEN raw ELSE coalesce(alias.name, NULL) END AS term FROM (SELECT p_partkey, translate(lower(trim(v)), '- ', '__') AS raw, trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) AS k FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_type, ' ', 1) ELSE p_type END AS v FROM part)) LEFT JOIN (VALUES {_values((a, b) for a, b in CONCEPT_ALIASES.items() if b in CONCEPTS)}) alias(alias, name) ON k = alias.alias""")
def _(spark, sf):
    """Terms of a closed vocabulary, as they are or by alias."""
    v = F.when(F.col("p_partkey") % 2 == 0, F.split("p_type", " ")[0]).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", canonical.canonical_term(v, CONCEPTS, CONCEPT_ALIASES).alias("term"))


ENTITIES = [("nation", "FRANCE", "n:fr"), ("nation", "germany", "n:de"), ("region", "EUROPE", "r:eu"), ("nation", "united states", "n:us")]


@register("t48_canonical_entities", f"""WITH a(kind, alias, name) AS (VALUES {_values(ENTITIES)}), e AS (SELECT n_nationkey AS id, ' Nation' AS kind, n_name || ' (no. ' || n_nationkey || ')' AS value FROM nation UNION ALL SELECT 100 + r_regionkey, 'region', r_name FROM region)
SELECT id, max(a.name) AS key FROM e LEFT JOIN a ON lower(trim(e.kind)) = a.kind AND trim(regexp_replace(lower(a.alias), '[^a-z0-9]+', ' ', 'g')) IN (trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(regexp_replace(value, '\\s*\\([^)]*\\)', '')), '[^a-z0-9]+', ' ', 'g'))) GROUP BY id""")
def _(spark, sf):
    """Entities by kind and alias, brackets aside; unlisted ones have no key."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit(" Nation").alias("kind"), F.concat("n_name", F.lit(" (no. "), F.col("n_nationkey").cast("string"), F.lit(")")).alias("value"))
    r = table(spark, sf, "region").select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("value"))
    return canonical.canonical_entities(n.union(r), "kind", "value", spark.createDataFrame(ENTITIES, "kind string, alias string, name string")).select("id", "key")


SLOTS = [("Ann", "Q", "the / of"), ("Ann", "E", "That One"), ("Bob", "Q", "with"), ("Bob", "W", None)]


@register("t50_exposed_aliases", """WITH s(owner, slot, alias) AS (VALUES ('Ann', 'Q', 'Ann Q'), ('Ann', 'Q', 'the'), ('Ann', 'Q', 'of'), ('Ann', 'Q', 'Ann the / of'), ('Ann', 'E', 'Ann E'), ('Ann', 'E', 'That One'), ('Ann', 'E', 'Ann That One'), ('Bob', 'Q', 'Bob Q'), ('Bob', 'Q', 'with'), ('Bob', 'Q', 'Bob with'), ('Bob', 'W', 'Bob W')),
b AS (SELECT owner, slot, slot AS alias FROM (VALUES ('Ann', 'Q'), ('Ann', 'E'), ('Bob', 'Q'), ('Bob', 'W')) v(owner, slot)),
o AS (SELECT item_id AS id, unnest(CASE WHEN length(text) % 3 = 0 THEN ['Ann', 'Bob'] WHEN length(text) % 3 = 1 THEN ['Ann'] ELSE ['Bob'] END) AS owner, 'E. ' || text || ' Bob W' AS text FROM benchmark),
n AS (SELECT *, count(*) OVER (PARTITION BY id) AS owners FROM o), every AS (SELECT owner, slot, alias, false AS bare FROM s UNION ALL SELECT owner, slot, alias, true FROM b)
SELECT DISTINCT id, alias, owner || ' ' || slot AS canonical FROM n JOIN every USING (owner) WHERE (NOT bare OR owners = 1) AND regexp_matches(lower(text), '(^|[^a-z0-9])' || lower(alias) || '($|[^a-z0-9])')""")
def _(spark, sf):
    """The names of slots that a text mentions itself; bare slots where one owner alone may be meant."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    n = F.length("text") % 3
    owners = b.select("id", F.explode(F.when(n == 0, F.array(F.lit("Ann"), F.lit("Bob"))).when(n == 1, F.array(F.lit("Ann"))).otherwise(F.array(F.lit("Bob")))).alias("owner"))
    texts = b.select("id", F.concat(F.lit("E. "), "text", F.lit(" Bob W")).alias("text"))
    return canonical.exposed_aliases(texts, owners, spark.createDataFrame(SLOTS, "owner string, slot string, name string"))


SAID = [
    ("POLARITY", "never", "NEGATIVE"), ("CONDITIONALITY", "if", "CONDITIONAL,HYPOTHETICAL,COUNTERFACTUAL"), ("RESTRICTION", "not only", "ADDITIVE"), ("RESTRICTION", "only", "EXCLUSIVE"), ("MODALITY", "needs to", "NECESSARY,OBLIGATORY"), ("MODALITY", "shouldn’t", "OBLIGATORY"),
    ("MODALITY", "Would", "POSSIBLE,COUNTERFACTUAL"), ("MODALITY", "likely", "PROBABLE"), ("MODALITY", "won't", "ASSERTED"), ("MODALITY", "can", "POSSIBLE"), ("TEMPORAL_SCOPE", "often", "HABITUAL"), ("TEMPORAL_SCOPE", "now", "PRESENT"), ("TEMPORAL_SCOPE", "later", "FUTURE"),
    ("TEMPORAL_SCOPE", "already", "PAST"), ("TEMPORAL_SCOPE", "while", "ONGOING,BOUNDED"), ("TEMPORAL_SCOPE", "until", "BOUNDED"), ("COMPARATIVE_DEGREE", "same", "EQUAL"), ("COMPARATIVE_DEGREE", "farthest", "MAXIMUM"), ("COMPARATIVE_DEGREE", "worst", "MINIMUM"), ("COMPARATIVE_DEGREE", "fewer", "LESS"),
    ("COMPARATIVE_DEGREE", "than", "GREATER,LESS"), ("COMPARATIVE_DEGREE", "more", "GREATER"), ("UNCERTAINTY", "probably", "LIKELY"), ("UNCERTAINTY", "might", "POSSIBLE"), ("UNCERTAINTY", "unclear", "UNCERTAIN"),
]


@register("t40_cue_values", f"""SELECT conv_id, turn, kind, "values" FROM conversations, (VALUES {_values((k, c, v) for k, c, v in SAID)}) c(kind, cue, "values") WHERE turn = 0""")
def _(spark, sf):
    """The values that cues of each kind allow."""
    said = spark.createDataFrame([x[:2] for x in SAID], "kind string, cue string")
    first = table(spark, sf, "conversations").where("turn = 0").select("conv_id", "turn", F.explode(F.lit([k for k in dict.fromkeys(x[0] for x in SAID)])).alias("kind"))
    return first.join(said, "kind").select("conv_id", "turn", "kind", F.array_join(cues.allowed_values(F.col("kind"), F.col("cue")), ",").alias("values"))


@register("c4_duo_retrieve")
def _(spark, sf):
    """C4: two sides of a comparison with a share of general evidence."""
    r = retrieval.retrieve_duo(insights(spark, sf), QUESTION, asked_vector(spark, sf), (F.col("game") == "en", F.col("game") == "fr"), 15)
    return r.select("id", "side", F.round("final", 6).alias("final"))


@register("a36_family_shares", """SELECT family, round(sum(importance), 6) AS importance, round(sum(importance) / sum(sum(importance)) OVER (), 6) AS share FROM (SELECT p_retailprice::DOUBLE AS importance, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'one' WHEN p_brand LIKE 'Brand#2%' THEN 'two' ELSE 'other' END AS family FROM part) GROUP BY 1""")
def _(spark, sf):
    """Importance by family of features."""
    p = table(spark, sf, "part")
    families = p.select(F.col("p_brand").alias("feature")).distinct().withColumn("family", F.when(F.col("feature").startswith("Brand#1"), "one").when(F.col("feature").startswith("Brand#2"), "two")).where("family IS NOT NULL")
    s = M.family_shares(p.select(F.col("p_brand").alias("feature"), F.col("p_retailprice").cast("double").alias("importance")), families)
    return s.select("family", F.round("importance", 6).alias("importance"), F.round("share", 6).alias("share"))


@register("j12_other_subjects", f"""WITH {INSIGHTS} SELECT a.id, count(b.id) AS others FROM insights a JOIN insights b ON a.video_id = b.video_id AND lower(a.subject) <> lower(b.subject) GROUP BY 1""")
def _(spark, sf):
    """Facts of the same source about other subjects, case aside."""
    i = insights(spark, sf).select("id", "video_id", "subject")
    a, b = i.alias("a"), i.alias("b")
    return a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.lower("a.subject") != F.lower("b.subject"))).groupBy(F.col("a.id").alias("id")).agg(F.count(F.lit(1)).alias("others"))


@register("v16_boosted_trees")
def _(spark, sf):
    """Scores out of fold by the second model, an ensemble of boosted trees (eight here)."""
    return scoring.leave_group_out_trees(scoring.document_features(table(spark, sf, "documents"), table(spark, sf, "labels")), folds=4, trees=8)


def _reader(stage: str, shown: dict) -> str:
    """A stand-in for a model: it picks clauses by number and words by place, and now and then answers amiss."""
    if stage == "evidence":
        ids = sorted(shown["candidates"])
        if not ids:
            return json.dumps({"source": None, "candidate_ids": []})
        return json.dumps({"source": "insight", "candidate_ids": ids[:2] if len(ids) % 3 else [ids[0], ids[0]]})
    words = " ".join(shown["evidence"]).split() if "evidence" in shown else []
    if stage == "direction":
        return json.dumps({"causal_direction": "actor_event_causes_effect" if len(words) % 4 else "association_only"})
    if stage == "normalization":
        return json.dumps({"actor_concept": None, "event_relation": "needs", "effect_concept": "tempo" if len(shown["effect"]) % 5 else "made up"})
    if stage == "condition":
        return json.dumps({"condition": None if len(words) % 2 else words[-1]})
    at = {"actor": 0, "event": 1, "effect": 2}[stage]
    return json.dumps({stage: " ".join(words[2 * at : 2 * at + 2])})


@register("m7_propositions")
def _(spark, sf):
    """Propositions from benchmark texts, from closed answers of an injected model, stage by stage."""
    b = table(spark, sf, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("id"), "text", S.clauses(F.col("text")).alias("c"))
    one = lambda x, i: F.struct(F.concat(F.lit("c"), F.lpad((i + 1).cast("string"), 3, "0")).alias("id"), F.lit("insight").alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    packets = b.select("id", F.create_map(F.lit("insight"), F.col("text")).alias("sources"), F.transform("c", one).alias("candidates"))
    return propositions.propositions(packets, _reader, ("tempo", "vision"), ("needs", "enables"))
