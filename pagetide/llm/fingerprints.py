"""Document fingerprints: bottom-k sketches of shingle hashes, mergeable across parts."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import content, partitions, table
from pagetide.llm.hashing import HASHES, runs_of

SHINGLE = 5
K = 128
SPAN = 2.0**64


class Sketch:
    """The k smallest distinct hashes of a set of shingles, ascending; all of them if there are fewer than k."""

    __slots__ = ("hashes", "k")

    def __init__(self, hashes: np.ndarray, k: int = K):
        self.hashes, self.k = hashes, k

    @classmethod
    def of(cls, text: str | None, shingle: int = SHINGLE, k: int = K) -> Sketch:
        """Shingles are runs of that many words between white space; fewer words are one shingle, and no words none."""
        words = (text or "").split()
        return cls.of_hashes(HASHES.of([w.encode() for w in words]) if words else np.empty(0, np.uint64), shingle, k)

    @classmethod
    def of_hashes(cls, words: np.ndarray, shingle: int = SHINGLE, k: int = K) -> Sketch:
        if not len(words):
            return cls(np.empty(0, np.uint64), k)
        with np.errstate(over="ignore"):
            h = runs_of(words, min(shingle, len(words)))
        if len(h) > 4 * k:  # most hashes can't be among the k smallest
            few = np.unique(h[h < np.uint64(min(2.0 * k / len(h), 0.99) * SPAN)])
            if len(few) >= k:
                return cls(few[:k], k)
        return cls(np.unique(h)[:k], k)

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of the union, for instance of two parts of a text."""
        return Sketch(np.union1d(self.hashes, other.hashes)[: min(self.k, other.k)], min(self.k, other.k))

    def distinct(self) -> float:
        """Estimates the number of distinct shingles; exact below k."""
        n = len(self.hashes)
        return float(n) if n < self.k else (self.k - 1) / ((float(self.hashes[-1]) + 1) / SPAN)

    def resemblance(self, other: Sketch) -> float:
        """Estimates the likeness of two sets: shared among the k smallest of their union. Two empty sets are alike."""
        union = np.union1d(self.hashes, other.hashes)[: min(self.k, other.k)]
        if not len(union):
            return 1.0
        both = np.isin(union, self.hashes, assume_unique=True) & np.isin(union, other.hashes, assume_unique=True)
        return float(both.sum() / len(union))

    def containment(self, other: Sketch) -> float:
        """Estimates the part of this set that the other holds; 1 if this one is empty."""
        mine = self.distinct()
        return 1.0 if not mine else min(1.0, self.resemblance(other) * self.merge(other).distinct() / mine)

    def text(self) -> str:
        """As base64 of little-endian 64-bit integers."""
        return base64.b64encode(self.hashes.astype("<u8").tobytes()).decode()

    @classmethod
    def parse(cls, text: str, k: int = K) -> Sketch:
        return cls(np.frombuffer(base64.b64decode(text), "<u8"), k)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated): a row for each row of docs. Null counts as empty, whose fingerprint is ''. doc_id is only carried."""

    def of(batches):
        for b in batches:
            sketches = [Sketch.of(t.as_py(), shingle, k) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.text() for x in sketches], pa.string()), pa.array([x.distinct() for x in sketches], pa.float64())], ["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, fingerprint string, n_shingles double")


def range_of(keys: np.ndarray, marks: np.ndarray, first_keys: np.ndarray, first_marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (key, mark) the range it lies in, of ranges that begin at these ascending pairs, and whether it is the range's first pair."""
    at = np.searchsorted(first_keys, keys, "right") - 1
    low = np.searchsorted(first_keys, keys, "left")
    for key in np.unique(keys[low <= at]):  # where ranges begin within a key, marks tell; elsewhere the last range before does
        own = keys == key
        i, j = int(np.searchsorted(first_keys, key, "left")), int(np.searchsorted(first_keys, key, "right"))
        at[own] = i - 1 + np.searchsorted(first_marks[i:j], marks[own], "right")
    at = np.maximum(at, 0)
    return at, (first_keys[at] == keys) & (first_marks[at] == marks)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, doc_id, text, guest: documents in ranges of doc_id, each with the first of the next range as a guest at its end.

    Ranges are of doc_id and a hash of the text, so that an id that many rows have, or lack, is split as well. There are as many
    as shuffle partitions at most, and so many pairs of numbers are all that comes to the driver. Texts move once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("mark", F.xxhash64(content("text")))
    parted = rows.select("key", "mark").repartitionByRange(partitions(spark), "key", "mark").withColumn("part", F.spark_partition_id())
    firsts = sorted((r[0].key, r[0].mark) for r in parted.groupBy("part").agg(F.min(F.struct("key", "mark"))).select(F.col("min(struct(key, mark))")).toLocalIterator())
    if not firsts:
        return rows.select(F.lit(0).alias("bucket"), "doc_id", "text", F.lit(False).alias("guest"))
    first_keys, first_marks = np.array([k for k, _ in firsts]), np.array([m for _, m in firsts])

    @F.pandas_udf("long")
    def place(key: pd.Series, mark: pd.Series) -> pd.Series:
        at, first = range_of(key.to_numpy(), mark.to_numpy(), first_keys, first_marks)
        return pd.Series(2 * at + first)

    placed = rows.withColumn("place", place("key", "mark")).withColumn("bucket", (F.col("place") / 2).cast("int")).withColumn("first", F.col("place") % 2 == 1)
    own = placed.select("bucket", "doc_id", "text", F.lit(False).alias("guest"), "key", "mark")
    # One of the rows that begin a range, and not all that may repeat it.
    begin = placed.where("first").groupBy("bucket", "key", "mark").agg(F.min(F.struct("text", "doc_id")).alias("x"))
    host = F.pmod(F.col("bucket") - 1, F.lit(len(firsts))).cast("int")
    guests = begin.select(host.alias("bucket"), "x.doc_id", "x.text", F.lit(True).alias("guest"), "key", "mark")
    dealt = own.unionByName(guests).repartitionById(len(firsts), F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "guest", "key", "mark", "text").select("bucket", "doc_id", "text", "guest")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, held_in_edited: a row for each row of docs.

    A text's edit replaces its last quarter (in whole code points) by as many first code points of the next document's, or
    all of them. n_shingles estimates the text's distinct shingles, held_in_edited the part of them that its edit holds. The next document has the next doc_id, and after the last comes the first; a sole document is its own next.
    Null and empty texts have no code points and no shingles; two texts without shingles are alike (1), one without and one
    with are not (0). Documents without an id come first; documents of equal ids follow each other by a
    hash of the text, then by the text, null first. An empty table gives no rows. Other columns aren't read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "held_in_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def pair(doc_id, text, sketch, next_text, next_sketch):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + next_text[:cut]
        other = Sketch.of(edited, shingle, k) if cut else sketch
        held = sketch.containment(other) if cut else 1.0
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch.text(), other.text(), sketch.resemblance(other), sketch.resemblance(next_sketch), sketch.distinct(), held

    def of(batches):
        before = None
        out = []
        for b in batches:
            for bucket, doc_id, text, guest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                text = text.as_py() or ""
                sketch = Sketch.of(text, shingle, k)
                if before and before[0] == bucket and not before[4]:
                    out.append(pair(*before[1:4], text, sketch))
                before = (bucket, doc_id, text, sketch, guest)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return with_next(docs, id_col, text_col).mapInArrow(of, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, held_in_edited double")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
