"""Rows beside the one before them, of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.plans.storage import written


def with_previous(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """rows with previous: the value of the row before, by order, in the same group; null for the first.

    Rows are dealt in ranges of (group, order), so that a group that holds a third of them is in many tasks; the last row of
    each range is carried to the next. order must tell the rows of a group apart. Null groups are one group, the first.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, group, order).withColumn("part", F.spark_partition_id()))
    last = dealt.groupBy("part").agg(F.max(F.struct(F.struct(group, order).alias("place"), F.struct(F.col(group).alias("g"), F.col(value).alias("v")).alias("row")))["row"].alias("row"))
    carried = last.select("part", F.lag("row").over(W.orderBy("part")).alias("carried"))  # a row for each range
    before = F.lag(F.struct(F.col(group).alias("g"), F.col(value).alias("v"))).over(W.partitionBy("part").orderBy(group, order))
    out = dealt.withColumn("before", before).join(carried, "part").withColumn("before", F.coalesce("before", "carried"))
    return out.withColumn("previous", F.when(F.col("before.g").eqNullSafe(F.col(group)), F.col("before.v"))).drop("part", "before", "carried")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place: their number from 1 on in that order, whatever their number. Ranges are numbered each in a task, and begin where those before them end; rows that tie are numbered in any order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    place = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return dealt.withColumn("place", place).join(before, "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")
