"""Helpers that the operators share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space of every word rule here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"

BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to send Python at most BATCH_ROWS rows at once: texts are long, and each batch is held in the JVM and the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own where a local session (tests) names none."""
    global _own
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or (sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        _own = found = _own or f"file://{tempfile.mkdtemp(prefix='termloom-')}"
    return found


_own: str | None = None


def on_disk(spark: SparkSession, path: str) -> tuple:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def passing(spark: SparkSession, path: str) -> str:
    """The path, its files to be deleted when the driver ends."""
    fs, p = on_disk(spark, path)
    fs.deleteOnExit(p)
    return path


def delete(spark: SparkSession, path: str) -> None:
    fs, p = on_disk(spark, path)
    fs.delete(p, True)


_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes meanwhile are deleted afterwards."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written in the shared folder: lost executors don't undo them.

    The table goes with drop_cut(), with scratch(), or when the driver ends.
    """
    spark = df.sparkSession
    path = passing(spark, f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    for paths in _made[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and nothing reads any more."""
    if path := getattr(df, "_cut_path", None):
        delete(df.sparkSession, path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
