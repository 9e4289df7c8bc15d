"""Paths on the file system Spark writes to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _open(spark, path)
    return files.exists(target)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct sub-folders; none when ``path`` is missing."""
    files, target = _open(spark, path)
    if not files.exists(target):
        return []
    return [s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()]


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct files; none when ``path`` is missing."""
    files, target = _open(spark, path)
    if not files.exists(target):
        return []
    return [s.getPath().getName() for s in files.listStatus(target) if s.isFile()]


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    files, target = _open(spark, path)
    stream = files.open(target)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole or not at all; an error where the path is taken."""
    files, target = _open(spark, path)
    _, partial = _open(spark, f"{path}.{uuid.uuid4().hex}.partial")
    stream = files.create(partial, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.exists(target) or not files.rename(partial, target):
        files.delete(partial, False)
        raise FileExistsError(path)


def read_table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A catalogue table; an empty frame when it does not exist. Other errors go through."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all its files."""
    files, target = _open(spark, path)
    files.delete(target, True)


def replace_files(df: DataFrame, path: str) -> None:
    """Replace the parquet table at ``path`` with the rows of ``df``, which must not read it."""
    df.write.mode("overwrite").parquet(path)


def replace_table(df: DataFrame, name: str) -> None:
    """Create or replace a catalogue table with the rows of ``df``."""
    df.write.mode("overwrite").saveAsTable(name)
