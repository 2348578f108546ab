"""Captions and lists of addresses, as columns of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def caption_text(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and text: the spoken lines of caption files, without headers, times, tags, blanks and repeats of the line before.

    Repeats are found inside the array of a file's lines, so no rows are exploded or shuffled.
    """
    lines = F.transform(F.split(column, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("WEBVTT") & ~x.contains("-->") & ~x.rlike("^(Kind|Language|NOTE)\\b") & ~x.rlike("^[0-9]+$"))
    kept = F.filter("_l", lambda x, i: (i == 0) | (F.get(F.col("_l"), i - 1) != x))
    return df.withColumn("_l", lines).select(key, F.array_join(kept, " ").alias("text"))


def url_lines(df: DataFrame, column: str) -> DataFrame:
    """url and forced (a class before ``:: ``, or null) of lines that are neither blank nor comments."""
    line = F.trim(column)
    rows = df.where((line != "") & ~line.startswith("#"))
    return rows.select(F.regexp_replace(line, "^[a-z]+:: ", "").alias("url"), F.lower(F.nullif(F.regexp_extract(line, "^([a-z]+):: ", 1), F.lit(""))).alias("forced"))


def first_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
