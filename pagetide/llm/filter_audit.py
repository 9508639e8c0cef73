"""Filter interaction audit: what each of five filters removes in each order in which they can be applied.

Documents are reduced to cells: how many of a part fail just this set of filters, by label. A part's cells, at most 128, are
then read along a walk over all orders in which each order follows from the one before by swapping two neighbours, so that
only those two steps are looked up anew; Shapley sums add up along the walk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.common import table

FILTERS = "ABCDE"
#: What fails the filters of a text alone: under WORDS words, under DISTINCT of 100 of them distinct, over CAPITALS of 100 characters A-Z, any of MARKS.
WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
UPPER = bytes(range(65, 91))
COPY = 16


def failures(text: str | None) -> tuple[int, bytes]:
    """The bits of the filters A to D that a text fails, and its SHA-256. Null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, UPPER))
    few, alike = len(words) < WORDS, 100 * len(set(words)) < DISTINCT * len(words)
    loud, marked = 100 * capitals > CAPITALS * len(text or ""), len(raw.translate(None, MARKS)) < len(raw)
    return few | alike << 1 | loud << 2 | marked << 3, hashlib.sha256(raw).digest()


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, own (bits of A to D), digest: a row for each row of docs, without its text."""

    def of(batches):
        for b in batches:
            own, digests = [], []
            for t in b.column(2):
                bits, digest = failures(t.as_py())
                own.append(bits)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "own", "digest"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, own int, digest binary")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, own, good, toxic, firsts, copies: documents of a part that fail the same of A to D, by whether they also fail E.

    Equal texts are combined before they are dealt out, so that a text that a third of all rows share makes a few rows for
    each part. No text is dealt out.
    """
    told = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("quality") == 1).alias("q"), F.max(F.col("toxic") == 1).alias("t"))
    rows = judged(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "own", "digest").agg(F.count(F.lit(1)).alias("n"))
    no = F.lit(False)
    known = rows.join(told, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "part", "own", "digest", "n", F.coalesce("q", no).alias("good"), F.coalesce("t", no).alias("toxic"))
    named = F.col("doc_id").isNotNull()
    kinds = known.groupBy("digest", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("unnamed"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(W.partitionBy("digest"))  # of a row for each kind of the text's documents
    firsts = F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    counted = kinds.withColumn("firsts", firsts)
    return counted.groupBy("part", "own", "good", "toxic").agg(F.sum("firsts").alias("firsts"), F.sum(F.col("n") - F.col("firsts")).alias("copies"))


def orders(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of 0..n-1 and, of each but the first, the place whose item was swapped with the next: the largest item that can move does, and larger ones turn round."""
    order, left = list(range(n)), [True] * n
    yield order, None
    while True:
        place = {x: i for i, x in enumerate(order)}
        for x in reversed(range(n)):
            i = place[x]
            j = i - 1 if left[x] else i + 1
            if 0 <= j < n and order[j] < x:
                break
        else:
            return
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            left[y] = not left[y]
        yield order, min(i, j)


class Cells:
    """Documents of a part by the set of filters that they fail."""

    def __init__(self, listed: list[dict]):
        self.n, self.good, self.toxic = ([0] * 2 ** len(FILTERS) for _ in range(3))
        for c in listed:
            for mask, n in ((c["own"], c["firsts"]), (c["own"] | COPY, c["copies"])):
                self.n[mask] += n
                self.good[mask] += n * c["good"]
                self.toxic[mask] += n * c["toxic"]

    def step(self, bit: int, before: int) -> tuple[int, ...]:
        """kept, removed, redundant, unique_fails, good_lost, toxic_lost of a filter that comes after those of before."""
        masks = range(len(self.n))
        here = [m for m in masks if m & bit and not m & before]
        removed = sum(self.n[m] for m in here)
        kept = sum(self.n[m] for m in masks if not m & (before | bit))
        redundant = sum(self.n[m] for m in masks if m & bit and m & before)
        return kept, removed, redundant, self.n[bit], sum(self.good[m] for m in here), sum(self.toxic[m] for m in here)


def walk(of: Cells) -> Iterator[tuple]:
    """filter_order, step, the figures of Cells.step() and the filter's Shapley sum, for each step of each order."""
    n = len(FILTERS)
    steps: list[tuple[int, ...]] = [()] * n
    shares, seen = [0] * n, []
    for order, swapped in orders(n):
        for k in range(n) if swapped is None else (swapped, swapped + 1):
            steps[k] = of.step(1 << order[k], sum(1 << x for x in order[:k]))
        for x, figures in zip(order, steps, strict=True):
            shares[x] += figures[1]
        seen.append((tuple(order), tuple(steps)))
    for order, figures in seen:
        name = "".join(FILTERS[x] for x in order)
        for k, x in enumerate(order):
            yield name, k + 1, *figures[k], shares[x]


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and FIGURES: 600 rows for each part, whatever its documents.

    Null texts count as empty, null parts as the part of empty name. Of equal texts, all fail E but those with the least
    doc_id; a null doc_id is neither smaller than another nor larger, so its document doesn't fail E and makes none fail.
    Repeated rows count each; rows with the same doc_id and text fail E together or not at all. Where labels name a doc_id
    several times, one that says good or toxic is enough; labels without a document don't count. An empty table has no
    parts and gives no rows. Other columns aren't read.
    """
    listed = cells(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("own", "good", "toxic", "firsts", "copies")).alias("cells"))

    def of(batches):
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names, steps, *figures = zip(*walk(Cells(found)), strict=True)
                columns = [pa.array([part] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(steps, pa.int32()), *(pa.array(f, pa.int64()) for f in figures)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *FIGURES])

    return listed.mapInArrow(of, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
told AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
docs AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
  + 4 * CAST(100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 5 * length(body) AS INT)
  + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY body), false) AS INT) AS mask
  FROM words LEFT JOIN told USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, taken, before, bit, step) AS (
  SELECT '', 0, 0, 0, 0
  UNION ALL SELECT filter_order || letter, taken | l.bit, taken, l.bit, step + 1 FROM orders JOIN letters l ON taken & l.bit = 0),
steps AS (SELECT o.filter_order, p.step, p.before, p.bit FROM orders o JOIN orders p ON o.step = 5 AND p.step > 0 AND starts_with(o.filter_order, p.filter_order)),
figures AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps CROSS JOIN cells GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM figures
"""
