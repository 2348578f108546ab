"""The corpus pipeline: five stages, each over all that its predecessor kept, written as Parquet in between.

1. toxicity: documents that the lexicon model rejects go; it learns from the labels of the documents it is given.
2. simhash: near-duplicates (distinct five-word shingles of a Jaccard similarity of ``SIMILARITY`` or more)
   leave the document with the smallest id of each group.
3. decontamination: documents with a word inside a benchmark window go.
4. mixing: documents are taken as often as the mix asks, so some stand twice and some go.
5. tokens: what remains is encoded into files of byte planes and read back.

All stages but the last return the columns of documents. SQL can't express the first two, so there is no SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, simhash, token_planes
from tessera.llm.common import unused, written
from tessera.llm.toxicity import Toxicity

#: Near copies of a similarity of 0.8 lie some 10 bits apart, 3 more or less; unrelated texts around 32.
RADIUS = 18
SIMILARITY = 0.8
#: Bytes of a batch and words whose ids a worker keeps, for the last stage: the executors' heaps are full by then.
BATCH, CACHED = 2 << 20, 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return Toxicity.train(docs, labels).keep_clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, simhash.near_duplicates(docs, radius=RADIUS, similarity=SIMILARITY))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    times, copy = F.col(mixed.columns[-1]), unused(mixed.columns, "_copy")[0]
    return mixed.where(times > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(copy)).drop(copy)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_planes.read_token_planes(spark, token_planes.write_token_planes(docs, public_tokenizers.path("word_bpe_49k.json"), batch=BATCH, cached=CACHED))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
