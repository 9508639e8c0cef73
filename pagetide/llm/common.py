"""What the operators of this subpackage share."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from pagetide.plans import storage
from pagetide.plans.storage import shared_dir

#: Words are runs of anything but ASCII white space; bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content(text: str | Column) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: The folders written within the scratch() that is open in this thread or task, if any. Work in other threads has its own.
_OPEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and what is used twice is computed once.

    Unlike checkpoint(), this doesn't compute the last stage twice. The files stay until the folder is emptied, as checkpoints
    do, unless a scratch() is open.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    if (own := _OPEN.get()) is not None:
        own.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        storage.removed(spark, path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, what this thread has written within it. For work whose result is itself written outside of it, or collected."""
    own: list[str] = []
    outer = _OPEN.set(own)
    try:
        yield
    finally:
        _OPEN.reset(outer)
        removed(spark, own)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., so that whatever names they had, none clashes with those of an operator."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def orderable(kind: DataType) -> bool:
    """Whether rows can be ordered by a column of that type, as all but maps and variants can."""
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def sort_key(df: DataFrame, column: str) -> Column:
    return F.col(column) if orderable(df.schema[column].dataType) else F.to_json(F.struct(column))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
