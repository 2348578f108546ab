"""The knowledge tables that the registered queries run on, derived from the Parquet tables.

``insights``: one fact per embedding, with the text of the document of the same id, five facts to a source document.
``videos``: one source document per document row. The same definitions stand in ``INSIGHTS`` and ``VIDEOS`` as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

ROLES = ("top", "jungle", "mid", "bottom", "support")
SOURCES = ("discord", "mobafire_guide", "aoe2_wiki", "aoe2_video", "aoe2_crossref", "aoe2_pdf")
RANKS = ("", "diamond", "Emerald", "master", "Grandmaster", "challenger", "unranked")
STATUSES = ("pending", "transcribed", "analyzed", "no_transcript", "error")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The value at an index from 0, repeating."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + ({index}) % {len(values)}]"


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, video_id, text, insight_type, subject, subject_type, game, role, source, rank, rating, source_score, confidence, embedding."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("game"), F.col("source").alias("site"))
    i = F.col("id")
    return v.join(d, "id").select(
        "id",
        F.floor(i / 5).cast("long").alias("video_id"),
        "text",
        F.concat(F.lit("type"), F.col("label") % 4).alias("insight_type"),
        F.col("site").alias("subject"),
        F.when(i % 3 == 0, F.lit("general")).when(i % 3 == 1, F.lit("entity")).alias("subject_type"),
        "game",
        pick(ROLES, i).alias("role"),
        pick(SOURCES, F.floor(i / 3)).alias("source"),
        pick(RANKS, F.floor(i / 2)).alias("rank"),
        (F.lit(8.0) + (i % 21) / F.lit(10.0)).alias("rating"),
        F.when(i % 7 == 0, F.lit(None).cast("double")).otherwise((i % 11) / F.lit(10.0)).alias("source_score"),
        F.when(i % 13 == 0, F.lit(None).cast("double")).otherwise((i % 9) / F.lit(8.0)).alias("confidence"),
        "embedding",
    )


INSIGHTS = f"""insights AS (
  SELECT e.vec_id AS id, (e.vec_id // 5)::BIGINT AS video_id, d.text, 'type' || (e.label % 4) AS insight_type, d.source AS subject,
         CASE e.vec_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'entity' END AS subject_type, d.lang AS game,
         {_pick_sql(ROLES, "e.vec_id")} AS role, {_pick_sql(SOURCES, "e.vec_id // 3")} AS source, {_pick_sql(RANKS, "e.vec_id // 2")} AS rank,
         8.0::DOUBLE + (e.vec_id % 21) / 10.0::DOUBLE AS rating,
         CASE WHEN e.vec_id % 7 = 0 THEN NULL ELSE (e.vec_id % 11) / 10.0::DOUBLE END AS source_score,
         CASE WHEN e.vec_id % 13 = 0 THEN NULL ELSE (e.vec_id % 9) / 8.0::DOUBLE END AS confidence, e.embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, title, game, subject, champion, role, source, status, description, transcription."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"),
        F.substring("text", 1, 40).alias("title"),
        F.col("lang").alias("game"),
        F.when(i % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("subject"),
        F.when(i % 6 == 0, F.lit(None).cast("string")).otherwise(F.upper("source")).alias("champion"),
        pick(ROLES, i).alias("role"),
        F.when(i % 9 == 0, F.lit(None).cast("string")).otherwise(pick(SOURCES, F.floor(i / 2))).alias("source"),
        pick(STATUSES, F.floor(i / 7)).alias("status"),
        F.col("text").alias("transcription"),
    )


VIDEOS = f"""videos AS (
  SELECT doc_id AS video_id, substr(text, 1, 40) AS title, lang AS game, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS subject,
         CASE WHEN doc_id % 6 = 0 THEN NULL ELSE upper(source) END AS champion, {_pick_sql(ROLES, "doc_id")} AS role,
         CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {_pick_sql(SOURCES, "doc_id // 2")} END AS source,
         {_pick_sql(STATUSES, "doc_id // 7")} AS status, text AS transcription
  FROM documents)"""

#: The tokens of a text as SQL: lower case, runs of a-z and 0-9.
TOKENS_SQL = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
