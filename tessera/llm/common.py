"""What the operators share: the shared folder, written tables, files on any store, words in bulk."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as a Java and RE2 class; ``bytes.split()`` and Arrow's ASCII split use the same six bytes.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; where that is unset, one of our own
    in local mode, and an error on a cluster, whose executors would write to disks that nobody else reads.

    A path without a scheme lies in the cluster's default file system, as for Spark itself.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    at = sc._jvm.org.apache.hadoop.fs.Path(found)
    whole = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends, and its size is known to the planner."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that the operators have written to the shared folder; results that still read it can't be read any more."""
    remove(spark, f"{shared_dir(spark)}/tessera")


@contextmanager
def _setting(spark: SparkSession, name: str, value: int):
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int):
    """For the actions inside: at most so many rows in a batch for Python, where a row holds much."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def arrow_bytes(spark: SparkSession, size: int):
    """For the actions inside: a batch for Python ends with the row that brings it to so many bytes."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a DataFrame that ``written`` returned."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        remove(df.sparkSession, path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and the path of a URI; a bare path is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch whose ``column`` holds about ``most`` bytes, a single longer row alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the word numbers of all texts in a row, and where each text starts in that row.

    Words are runs of anything but ASCII white space, unchanged; null has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(ends[0], ends[-1] - ends[0])
    ends = ends - ends[0]
    there = np.asarray(pc.binary_length(flat)) > 0
    if not there.all():
        flat = flat.filter(pa.array(there))
        ends = np.concatenate([[0], np.cumsum(there)])[ends]
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), ends


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0]+1, ... of ``sizes`` runs in a row."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, sizes)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front where a column already has one, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(df: DataFrame, column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
