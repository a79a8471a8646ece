"""Shared scratch folder, written small tables, and the check for over-long series."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import present

# A series of at most this many rows is sorted in one task (some hundred megabytes, and it can spill).
LONG_SERIES = 4_000_000

_roots: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    """The file system that holds `path`, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the shared folder named by spark.checkpoint.dir.

    Only a session that runs in one process may fall back to its temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/weatherloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's scratch folder, which goes when the application ends."""
    root = scratch_root(spark)
    if root not in _roots:
        fs, at = _file_system(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _roots.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths that nothing reads any more."""
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)


def paths_in(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in a store that need not be there yet."""
    fs, at = _file_system(spark, pattern)
    return [str(status.getPath().toString()) for status in fs.globStatus(at) or []]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which is there as a whole or not at all, in the place of one of the same name."""
    fs, at = _file_system(spark, path)
    _, own = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(own, at):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, compressed or not; None if it is empty."""
    fs, at = _file_system(spark, path)
    jvm, stream = spark._jvm, fs.open(at)
    try:
        factory = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory
        codec = factory(spark._jsc.hadoopConfiguration()).getCodec(at)
        text = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    finally:
        stream.close()


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write `df` to a fresh scratch path, or over the same name in `folder`, and read it back.

    This runs a job at once. The result survives lost executors, is computed once, and has a known
    size, so that Catalyst broadcasts it only when it really is small.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def long_series(readings: DataFrame, keys, series_rows: int, folder: str | None = None):
    """Series longer than `series_rows`, as (DataFrame of keys, their rows in total), or (None, 0).

    One scan of the key columns, combined before the shuffle. There are never more long series than
    rows / series_rows, which bounds the broadcast of the returned keys.
    """
    sizes = (
        present(readings, *keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > series_rows)
    )
    rows = sizes.agg(F.sum("n")).first()[0]
    if rows is None:
        return None, 0
    return written(sizes.select(*keys), "long-series", folder), rows
