"""Mixing sources to target weights by cube-method balanced sampling.

Within a source each document has the same expected number of copies. Whole copies are taken outright; the fractional rest
is an inclusion probability, and the cube method moves these through the null space of the balancing constraints (number of
documents and of words) until at most two documents of each source are undecided, the landing problem.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.common import WORD, content, numbered, partitions, sort_key, table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 20
#: Documents that one flight handles on average.
FLIGHT = 50_000
#: Repeated rows that are written out at a time.
STEP = 10_000


def sizes(text: str | Column) -> Column:
    return F.regexp_count(content(text), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target of source, source_size: share of all sizes by weight, held to cap times a source's own size.

    Sources take the weights in turn in the order of their code points, null last. What a cap leaves over goes to the others
    by weight, until none is above. Only totals come to the driver; they settle what a unit of weight is worth.
    """
    order = written(sources.repartitionByRange(partitions(sources.sparkSession), F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition, which is all that meets in one task
    offsets = order.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("offset")
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod(place, F.lit(len(weights))).cast("int")]
    ranked = written(order.join(offsets, "part").withColumn("weight", weight).select("source", "source_size", "weight"))
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    most, unit = F.col("source_size") * F.lit(float(cap)), 0.0
    while True:
        capped = F.col("weight") * F.lit(unit) > most if unit else F.lit(False)
        held, free = ranked.agg(F.sum(F.when(capped, most)), F.sum(F.when(~capped, F.col("weight")))).first()
        now = max(0.0, total - (held or 0.0)) / free if free else unit
        if now <= unit:
            break
        unit = now
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(unit), most).alias("target"))


def flight(probability: list[float], size: list[float], draw: list[float], carry: tuple[list, list, list, list] | None = None, tags: list | None = None):
    """Moves probabilities at random until at most two lie strictly between 0 and 1; sums of probability and of probability times size stay as they are.

    Yields (tag, taken) as units are decided and returns the undecided as lists of tag, probability, size, draw. Three units
    move at a time, along the vector that neither sum sees. Sizes are those per unit of the probability a unit began with,
    which all units of a flight share.
    """
    ids, p, s, d = carry or ([], [], [], [])
    ids, p, s, d = list(ids), list(p), list(s), list(d)
    tags = tags if tags is not None else list(range(len(probability)))
    for t, x, y, z in zip(tags, probability, size, draw, strict=True):
        if x <= 1e-9 or x >= 1 - 1e-9:
            yield t, x > 0.5
            continue
        ids.append(t)
        p.append(x)
        s.append(y)
        d.append(z)
        while len(ids) > 2:
            u = (s[2] - s[1], s[0] - s[2], s[1] - s[0])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - q) / v if v > 0 else -q / v for q, v in zip(p, u, strict=True) if v)
            down = min(q / v if v > 0 else (q - 1) / v for q, v in zip(p, u, strict=True) if v)
            step = up if d[2] * (up + down) < down else -down
            kept = [[], [], [], []]
            for q in zip(ids, (a + step * b for a, b in zip(p, u, strict=True)), s, d, strict=True):
                if q[1] <= 1e-9 or q[1] >= 1 - 1e-9:
                    yield q[0], q[1] > 0.5
                else:
                    for column, value in zip(kept, q, strict=True):
                        column.append(value)
            ids, p, s, d = kept
    return ids, p, s, d


def landing(p: list[float], s: list[float]) -> list[bool]:
    """Of the few outcomes left, the one whose sum of sizes is nearest to what the probabilities promise."""
    want = sum(a * b for a, b in zip(p, s, strict=True))
    options = [[bool(k >> i & 1) for i in range(len(p))] for k in range(2 ** len(p))]
    return min(options, key=lambda o: (abs(sum(b for b, x in zip(s, o, strict=True) if x) - want), o))


def sampled(rows: DataFrame, last: bool) -> DataFrame:
    """unit, grp, p, size, draw, taken of unit, grp, p, size, draw in the order of grp and falling size, so that what is left to land is small: taken is null for what stays undecided, and never if last."""

    def of(batches):
        kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        names = ["unit", "grp", "p", "size", "draw", "taken"]
        group, state = None, ([], [], [], [])
        out: list[tuple] = []

        def close():
            ids, p, s, d = state
            chosen = landing(p, s) if last else [None] * len(ids)
            out.extend((u, group, a, b, c, x) for u, a, b, c, x in zip(ids, p, s, d, chosen, strict=True))

        for b in batches:
            unit, grp, p, size, draw = (c.to_pylist() for c in b.columns)
            k = 0
            while k < len(unit):
                if grp[k] != group:
                    close()
                    group, state = grp[k], ([], [], [], [])
                j = k
                while j < len(unit) and grp[j] == group:
                    j += 1
                moves = flight(p[k:j], size[k:j], draw[k:j], state, unit[k:j])
                while True:
                    try:
                        t, taken = next(moves)
                        out.append((t, group, 0.0, 0.0, 0.0, taken))
                    except StopIteration as end:
                        state = end.value
                        break
                k = j
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(of, "unit string, grp string, p double, size double, draw double, taken boolean")


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float, seed: int) -> DataFrame:
    """unit, doc_id, source, digest, size, source_size, target, rows, whole, more: for each distinct (doc_id, source, text), how
    many rows have it, how often each of them is taken at least, and how many of them are taken once more."""
    spark = docs.sparkSession
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), sizes(text_col).alias("size"), F.sha2(content(text_col), 256).alias("digest"))
    rows = written(each.groupBy("doc_id", "source", "digest").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    aims = written(targets(sums, weights, share, cap))
    count = rows.count()
    flights = max(1, -(-count // FLIGHT))
    spread = F.xxhash64("doc_id", "digest", F.lit(seed))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = rows.join(aims.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    promised = F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")) * F.col("rows")  # copies beyond the whole ones, of all rows alike
    planned = written(
        joined.withColumn("ratio", F.when(F.col("size") > 0, ratio).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("ratio") + 1e-9))
        .withColumn("sure", F.floor(promised + 1e-9))
        .withColumn("p", F.greatest(F.lit(0.0), promised - F.col("sure")))
        .withColumn("unit", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.hex(F.coalesce("source", F.lit("\x00")))))
        .withColumn("draw", F.shiftrightunsigned(spread, 11) / F.lit(2.0**53))
        .drop("ratio")
    )
    chance = planned.where("p > 1e-9").select("unit", F.hex(F.coalesce("source", F.lit("\x00"))).alias("grp"), "p", F.col("size").cast("double").alias("size"), "draw")
    parts = chance.withColumn("grp", F.concat_ws("|", "grp", F.pmod(F.xxhash64("unit", F.lit(seed + 1)), F.lit(flights)).cast("string")))
    n = partitions(spark)
    first = written(sampled(parts.repartition(n, "grp").sortWithinPartitions("grp", F.desc("size"), "draw", "unit"), last=False))
    left = first.where("taken is null").withColumn("grp", F.substring_index("grp", "|", 1))
    second = sampled(left.drop("taken").repartition(n, "grp").sortWithinPartitions("grp", F.desc("size"), "draw", "unit"), last=True)
    decided = first.where("taken is not null").select("unit", "taken").unionByName(second.select("unit", "taken"))
    more = (F.col("sure") + F.coalesce(F.col("taken").cast("int"), F.lit(0))).cast("long")
    return planned.join(decided, "unit", "left").withColumn("more", more).drop("taken", "sure", "p", "draw")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, digest, size, source_size, target, copies, taken: for each row of docs, how many times it is taken, and so how many words.

    Reruns agree: chance comes from a hash of doc_id, text and seed. A null source is a source of its own, the last; a null
    text has size 0, and what has size 0 is taken 0 times. Rows that repeat doc_id, source and text give a row each, with
    their own size; as they can't be told apart, it is fixed how many of them are taken how often. An empty table gives no
    rows. Other columns aren't read. Each source's words come within about two documents of its target, where its documents
    are whole.
    """
    out = plan(docs, id_col, text_col, source_col, weights, share, cap, seed)
    # In two steps, so that no row holds a long list where many rows repeat.
    step = F.lit(STEP)
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / step))))
    out = out.withColumn("place", F.explode(F.sequence(F.col("part") * step + 1, F.least("rows", (F.col("part") + 1) * step))))
    copies = (F.col("whole") + (F.col("place") <= F.col("more")).cast("int")).cast("long")
    return out.select("doc_id", "source", "digest", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as mix() takes them, with their columns. Of rows that repeat doc_id, source and text, those that
    come first by their other columns are taken more often; only these are numbered, group by group."""
    names, rows = docs.columns, numbered(docs)
    own = [f"c{names.index(c)}" for c in (id_col, text_col, source_col)]
    others = [c for c in rows.columns if c not in own]
    takes = plan(rows, *own, weights, share, cap, seed).where("whole + more > 0").select("unit", "rows", "whole", "more", F.col("doc_id").alias("id"), F.col("source").alias("of"), "digest")
    on = F.col(own[0]).cast("long").eqNullSafe(F.col("id")) & F.col(own[2]).eqNullSafe(F.col("of")) & (F.sha2(content(own[1]), 256) == F.col("digest"))
    alone = rows.join(takes.where("rows = 1"), on).withColumn("place", F.lit(1))
    again = rows.join(takes.where("rows > 1"), on).withColumn("place", F.row_number().over(W.partitionBy("unit").orderBy(*(sort_key(rows, c) for c in others), own[1])))
    copies = F.col("whole").cast("int") + (F.col("place") <= F.col("more")).cast("int")
    taken = alone.unionByName(again).withColumn("copies", copies).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*rows.columns).toDF(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
