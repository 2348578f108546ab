"""Files of rows, optional tables, and texts with fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import non_empty


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header or of a file with a JSON array, all as strings or as JSON has them."""
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if path.lower().endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    raise ValueError(f"neither CSV nor JSON: {path}")


def pick(df: DataFrame, *names: str, default: str | None = None) -> Column:
    """The first of some columns that a table has and that holds something."""
    there = [F.col(n).cast("string") for n in names if n in df.columns]
    found = non_empty(*there) if there else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(default))


def with_defaults(df: DataFrame | None, schema: dict[str, tuple[str, object]], spark: SparkSession) -> DataFrame:
    """A table with all columns of a schema (name: type, default): missing columns and nulls take the default, a missing table is empty."""
    if df is None:
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, (t, _) in schema.items()))
    return df.select(*[(F.coalesce(F.col(n).cast(t), F.lit(v).cast(t)) if n in df.columns else F.lit(v).cast(t)).alias(n) for n, (t, v) in schema.items()])


def first_text(base: DataFrame, key: str, sources: list[DataFrame]) -> DataFrame:
    """key, text, source: the text of the first source (key, text) that has one; null where none has."""
    out = base.select(key)
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.nullif(F.trim("text"), F.lit("")).alias(f"_t{i}")), key, "left")
    texts = [F.col(f"_t{i}") for i in range(len(sources))]
    which = reduce(lambda rest, i: F.when(texts[i].isNotNull(), F.lit(i)).otherwise(rest), reversed(range(len(sources))), F.lit(None).cast("int"))
    return out.select(key, F.coalesce(*texts).alias("text"), which.alias("source"))


def paged_text(pages: DataFrame, key: str) -> DataFrame:
    """key and text of documents from their pages (key, page, text): each page that holds text under its number."""
    some = pages.where(F.trim("text") != "")
    joined = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", F.trim(F.regexp_replace("text", r"[ \t]+", " ")).alias("t")))).alias("p"))
    return joined.select(key, F.array_join(F.transform("p", lambda x: F.concat(F.lit("## Page "), x["page"].cast("string"), F.lit("\n"), x["t"])), "\n\n").alias("text"))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page and text of PDF files; needs a PDF library, which this environment may lack."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf; pass extracted pages to paged_text instead") from e
    import io

    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(p, i + 1, page.extract_text() or "") for p, c in zip(pdf.path, pdf.content, strict=True) for i, page in enumerate(pypdf.PdfReader(io.BytesIO(c)).pages)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")
