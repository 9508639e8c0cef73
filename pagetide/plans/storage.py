"""Tables and files in folders that all executors share: intermediate ones of iterative operators, and ones that appear whole or not at all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir, which all executors share. Where that is unset a temporary folder serves, but only in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/pagetide-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes df to a shared_dir() and reads it again, which cuts its lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def files(spark: SparkSession, path: str) -> list[str]:
    """The files and folders in a folder."""
    fs, at = file_system(spark, path)
    return [f.getPath().toString() for f in fs.listStatus(at)]


def removed(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file or folder to a name that nothing has yet, or raises FileExistsError."""
    of = spark._jvm.org.apache.hadoop.fs
    files = of.FileContext.getFileContext(of.Path(target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(of.Path(source), of.Path(target), spark.sparkContext._gateway.new_array(of.Options.Rename, 0))
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            raise FileExistsError(target) from None
        raise


@contextmanager
def published(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside path to write to, which takes the name of path once all is written; where that fails nothing is left. What path has already stays: it is an error."""
    if exists(spark, path):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        yield staged
        renamed(spark, staged, path)
    except BaseException:
        removed(spark, staged)
        raise
