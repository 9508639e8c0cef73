"""Exact deduplication with skew-safe combining, in DataFrame operations only.

Copies are combined three times, each time by their full content: within a task (the partial aggregate), within a digest
and salt, and over all salts. A text that a third of all rows share reaches the second step as one row for each task and
salt, and the third as one row for each salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import content, numbered, orderable, sort_key, table, written

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept: a row for each row of docs, dropped ones too.

    Texts are equal when identical; null counts as empty. Of equal texts, that with the largest doc_id stays; ids that are
    null come before all others. Rows that repeat both doc_id and text give a row each and are kept or dropped together;
    group_size counts each of them. An empty table gives no rows. Other columns are not looked at.
    digest only spreads the rows: contents are compared in full, so one that collides gives the same groups.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), content(text_col).alias("content")).withColumn("digest", digest(F.col("content")))
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # A digest with one content is proven to stand for that content alone: from here on it replaces the text.
    digests = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    shared = written(digests.where("group_size > 1"))
    winners = shared.where("contents = 1").select("digest", "keep_id", "group_size")
    collided = shared.where("contents > 1").select("digest")
    members = rows.select("doc_id", "digest")
    if collided.isEmpty():
        out = members.join(winners, "digest", "left")
    else:
        apart = rows.join(collided, "digest", "left_semi")
        own = apart.groupBy("digest", "content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        settled = apart.join(own, ["digest", "content"])
        out = members.join(collided, "digest", "left_anti").join(winners, "digest", "left").unionByName(settled.drop("content"))
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        "digest",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row of docs for each text, with its columns: of rows with equal texts, that with the largest doc_id, and of these
    the largest by its other columns in their order (maps compare as JSON), null being least. So reruns agree.

    Null counts as an empty text, but a row that stays keeps its null. An empty table gives no rows. Rows travel with their
    columns through the three steps of combining, so nothing is joined back.
    """
    names, rows = docs.columns, numbered(docs)
    id_at, text_at = names.index(id_col), names.index(text_col)
    others = [c for i, c in enumerate(rows.columns) if i not in (id_at, text_at)]
    filled = F.col(f"c{text_at}").isNotNull().alias("filled")
    spread = rows.select(content(f"c{text_at}").alias("content"), F.struct(f"c{id_at}", *others, filled).alias("row"), F.pmod(F.xxhash64(f"c{id_at}"), F.lit(salts)).alias("salt"), F.struct(f"c{id_at}", *(sort_key(rows, c).alias(c) for c in others), filled).alias("key"))
    spread = spread.withColumn("digest", digest(F.col("content")))
    if all(orderable(rows.schema[c].dataType) for c in others):
        best = [F.max("row").alias("row")]
    else:
        best = [F.max_by("row", "key").alias("row"), F.max("key").alias("key")]
    salted = spread.groupBy("digest", "salt", "content").agg(*best)
    whole = salted.groupBy("digest", "content").agg(*best)
    text = F.when(F.col("row.filled"), F.col("content"))
    return whole.select(*(text.alias(c) if i == text_at else F.col(f"row.{c}") for i, c in enumerate(rows.columns))).toDF(*names)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
