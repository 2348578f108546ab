"""Changes to tables as plans: each returns the table as it is afterwards; writing it is the caller's one step.

Deltas are joined by key, so a change costs one shuffle of the keyed table, or none where the delta is small enough to be
broadcast by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key isn't there are added, each key once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def append_numbered(old: DataFrame, new: DataFrame, number: str, order: list[str]) -> DataFrame:
    """New rows are added with the next numbers, in order."""
    top = old.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    rows = new.withColumn("_r", F.row_number().over(W.orderBy(*order)))
    return old.unionByName(rows.crossJoin(F.broadcast(top)).withColumn(number, (F.col("_top") + F.col("_r")).cast("long")).drop("_r", "_top").select(*old.columns))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns change where a condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(old: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns take the delta's values where it has some."""
    d = delta.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(d, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of their key, or are added."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_owned(old: DataFrame, new: DataFrame, owner: list[str]) -> DataFrame:
    """All rows of an owner give way to the new ones, each once."""
    return old.join(new.select(*owner).distinct(), owner, "left_anti").unionByName(new.distinct())


def remove(documents: DataFrame, facts: DataFrame, key: str, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Documents under a condition go, and their facts with them."""
    gone = documents.where(condition).select(key)
    return documents.join(gone, key, "left_anti"), facts.join(gone, key, "left_anti")


def reset(documents: DataFrame, facts: DataFrame, key: str, condition: Column, status: str) -> tuple[DataFrame, DataFrame]:
    """Documents under a condition get a status again, and their facts go."""
    gone = documents.where(condition).select(key)
    return update_where(documents, condition, {"status": F.lit(status)}), facts.join(gone, key, "left_anti")


def sync_counts(tables: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """table, inserted, updated, untouched: what a synchronisation of each (old, new, keys) would do."""
    out = None
    for name, (old, new, keys) in tables.items():
        o, n = old.select(*keys).distinct().withColumn("_o", F.lit(1)), new.select(*keys).distinct().withColumn("_n", F.lit(1))
        c = o.join(n, keys, "full").agg(F.count_if(F.col("_o").isNull()).alias("inserted"), F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("updated"), F.count_if(F.col("_n").isNull()).alias("untouched"))
        c = c.select(F.lit(name).alias("table"), "*")
        out = c if out is None else out.unionByName(c)
    return out


def publish(df: DataFrame, path: str) -> str:
    """Writes a table with the digest of its content beside it; the same rows in any order give the same digest.

    The digest sums the rows' 64-bit hashes, as a whole number, so it needs no order and no collecting.
    """
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    stored = spark.read.parquet(path)
    digest = stored.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*stored.columns).cast("decimal(38,0)")).cast("string").alias("sum"))
    digest.write.parquet(f"{path}.manifest")
    return path


def verified(spark, path: str) -> bool:
    """Whether a published table still has the content of its digest."""
    stored, said = spark.read.parquet(path), spark.read.parquet(f"{path}.manifest").first()
    now = stored.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*stored.columns).cast("decimal(38,0)")).cast("string").alias("sum")).first()
    return tuple(now) == tuple(said)


def constraint_violations(df: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]], required: list[str]) -> DataFrame:
    """constraint and rows: keys that stand twice, numbers out of range, blanks where something is required."""
    twice = df.groupBy(*keys).count().where("count > 1").agg(F.lit("key").alias("constraint"), F.count(F.lit(1)).alias("rows"))
    checks = [(f"range:{c}", ~F.col(c).between(lo, hi)) for c, (lo, hi) in ranges.items()] + [(f"required:{c}", F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")) for c in required]
    one = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks])
    rest = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("constraint"), F.col(f"`{name}`").alias("rows")) for name, _ in checks])).alias("c")).select("c.*")
    return twice.unionByName(rest)
