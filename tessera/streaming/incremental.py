"""Incremental work on files that arrive: each is processed once, and a rerun goes on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame]) -> int:
    """Runs ``step`` over the Parquet files that have come to ``source`` since the last call; returns the rows written.

    The batch number is part of a batch's folder, so a batch that is repeated after a failure replaces itself.
    """
    written = [0]

    def put(batch: DataFrame, number: int) -> None:
        out = step(batch)
        path = f"{target}/batch={number}"
        out.write.mode("overwrite").parquet(path)
        written[0] += spark.read.parquet(path).count()

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return written[0]


def daily_counts(events: DataFrame, *, time: str = "ts", user: str = "user_id", late: str = "2 days") -> DataFrame:
    """Requests by day and user; on a stream, days close once the watermark has passed them, and later rows are dropped."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, "1 day").alias("day"), user).agg(F.count(F.lit(1)).alias("asked"))


def over_quota(counts: DataFrame, most: int) -> DataFrame:
    """Users that asked more than they may in a day."""
    return counts.where(F.col("asked") > most).select("*", (F.col("asked") - most).alias("refused"))
