"""Source divergence audit: how far the sources of a language differ in the terms they use.

Terms are counted by task, dealt in shards by language and term, and counted in each shard by DuckDB, which knows all of a
shard's terms whole: that gives the kept terms, and sums of counts that Spark adds up to each source's N and each language's
V. With these, a second round over shards of the kept terms gives each shard's partial sums of pairs and its best terms, in
SQL again; Spark merges sums and rankings.

Most terms are in few sources. So a pair's sum is the value of two absent terms times V, corrected by what each source's
own counts change (a histogram of counts does for that) and by the terms that both have, the only ones that are paired.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.common import content, partitions, table, written

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: What isn't of a term becomes a space, and A-Z lower case; bytes of other characters stay.
TERMS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256))
#: Terms that a task holds before it passes their counts on, bytes of text to a shard, and rows of an Arrow batch.
HELD, SHARD_BYTES, BATCH = 300_000, 32 << 20, 20_000

COUNTED = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERMS).split()


def task_counts(rows: DataFrame) -> DataFrame:
    """COUNTED of lang, source, text: what each task finds of a term, in one row or a few."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out():
            for (lang, source), (n, docs) in counts.items():
                found = list(n)
                for k in range(0, len(found), BATCH):
                    part = found[k : k + BATCH]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            counts.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = terms(text.as_py())
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(found)
                docs.update(set(found))
                held += len(n)
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    return rows.mapInArrow(of, COUNTED)


def in_duckdb(batches: Iterable[pa.RecordBatch], load: str, sql: str) -> Iterator[pa.RecordBatch]:
    """Rows of sql over the table loaded, which load makes of a shard's rows as they come. DuckDB works in memory, which the size of a shard bounds, and writes no files."""
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    try:
        db.register("shard", pa.RecordBatchReader.from_batches(first.schema, chain([first], batches)))
        db.execute(f"CREATE TABLE loaded AS {load}")
        db.unregister("shard")
        yield from db.sql(sql).to_arrow_reader(BATCH)
    finally:
        db.close()


def in_shards(rows: DataFrame, shards: int, load: str, sql: str, schema: str) -> DataFrame:
    """The rows of a query over each shard; all rows of a language's term are in the same one."""
    return rows.repartition(shards, "lang", "term").mapInArrow(lambda batches: in_duckdb(batches, load, sql), schema)


LOAD_COUNTS = "SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM shard GROUP BY ALL"
#: head: one of a term's rows, so that their number is the number of terms.
KEEP = f"""
SELECT lang, source, term, CAST(n AS BIGINT) AS n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS head
FROM loaded QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {LEAST_DOCS}
"""
#: The p of a term that occurs n times in a group of N occurrences in all, in a language of v kept terms; and f.
P = f"CAST(1 + ({SCALE}::HUGEINT * ({{n}} + 1)) // ({{total}} + v) AS BIGINT)"
VALUE = "(({p} - {q}) * ({p} - {q}) // {q})"
LOAD_SHARES = f"""
SELECT lang, source, term, n, {P.format(n="n", total="total")} AS p, {P.format(n="0", total="total")} AS p0,
       {P.format(n="sum(n) OVER (PARTITION BY lang, term)", total="lang_total")} AS q FROM shard
"""
BOTH = " - ".join([VALUE.format(p="a.p", q="b.p"), VALUE.format(p="a.p", q="b.p0"), VALUE.format(p="a.p0", q="b.p")]) + " + " + VALUE.format(p="a.p0", q="b.p0")
SHARED, COUNTS, BEST = "shared", "counts", "term"
#: Of a shard: what the terms that two sources share add to the pair's sum; how many terms a source has so many times; a source's best terms.
PARTS = f"""
SELECT '{SHARED}' AS part, a.lang, a.source, b.source AS item, CAST(0 AS BIGINT) AS n, CAST(sum({BOTH}) AS DECIMAL(38, 0)) AS value
  FROM loaded a JOIN loaded b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
UNION ALL SELECT '{COUNTS}', lang, source, '', n, CAST(count(*) AS DECIMAL(38, 0)) FROM loaded GROUP BY ALL
UNION ALL SELECT '{BEST}', lang, source, term, 0, CAST(f AS DECIMAL(38, 0)) FROM (SELECT lang, source, term, {VALUE.format(p="p", q="q")} AS f FROM loaded WHERE p > q)
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) <= {TOP}
"""


def share(n: str, total: str) -> Column:
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(19, 0))) div cast({total} + v as decimal(19, 0))")


def value(p: str, q: str) -> Column:
    return F.expr(f"cast((({p} - {q}) * ({p} - {q})) div {q} as decimal(19, 0))")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language, the others by how far they are (part pair), and the terms that it has more than the language (part term, to rank TOP).

    Null texts, languages and sources count as empty ones. Each row is a document, repeated rows too. A source without terms
    still has its pairs; where a language keeps no term all its pairs have 0. A language with one source has no pairs. Ties
    rank by item in UTF-8. An empty table gives no rows. Other columns aren't read. All arithmetic is in whole numbers.
    """
    text = content(text_col)
    rows = docs.select(content(F.col(lang_col).cast("string")).alias("lang"), content(F.col(source_col).cast("string")).alias("source"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(docs.sparkSession), -(-size // shard_bytes))
    kept = written(in_shards(task_counts(rows), shards, LOAD_COUNTS, KEEP, f"{KEPT}, head boolean"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("head").alias("v"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "v"))))

    found = written(in_shards(kept.drop("head").join(groups, ["lang", "source"]), shards, LOAD_SHARES, PARTS, "part string, lang string, source string, item string, n long, value decimal(38, 0)"))
    best = found.where(F.col("part") == BEST).select("lang", "source", "part", "item", "value")
    return ranked(best).where(F.col("rank") <= TOP).unionByName(ranked(pair_sums(found, groups)))


def pair_sums(found: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value of each source and each other one of its language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other_total"))
    each = groups.select("lang", "source", "total", "v").join(other, "lang").where("source <> item")
    none = F.when(F.col("v") > 0, value("p0", "q0") * F.col("v").cast("decimal(18, 0)")).otherwise(0).cast("decimal(38, 0)")
    flat = each.withColumns({"p0": F.when(F.col("v") > 0, share("0", "total")), "q0": F.when(F.col("v") > 0, share("0", "other_total"))}).select("lang", "source", "item", none.alias("value"))

    counts = found.where(F.col("part") == COUNTS).groupBy("lang", "source", "n").agg(F.sum("value").cast("decimal(18, 0)").alias("terms"))
    own = counts.join(groups.select("lang", "source", "total", "v"), ["lang", "source"]).withColumns({"p": share("n", "total"), "p0": share("0", "total")})
    beside = own.join(other, "lang").where("source <> item").withColumn("q0", share("0", "other_total"))
    total = lambda c: F.sum(F.col("terms") * c).cast("decimal(38, 0)")
    moved = beside.groupBy("lang", "source", "item").agg(total(value("p", "q0") - value("p0", "q0")).alias("to"), total(value("q0", "p") - value("q0", "p0")).alias("back"))
    columns = ["lang", "source", "item", "value"]
    there = moved.select("lang", "source", "item", F.col("to").alias("value"))
    back = moved.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    every = flat.unionByName(there).unionByName(back).unionByName(found.where(F.col("part") == SHARED).select(*columns))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
found AS (SELECT row, lang, source, unnest(list_transform(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
counted AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL),
grps AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM grps g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT *, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (lang_n + 1)) // (sum(lang_n) OVER g + count(*) OVER g) AS BIGINT) AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranks WHERE part = 'pair' OR rank <= 200
"""
