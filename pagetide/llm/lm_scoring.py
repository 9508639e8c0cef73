"""Language-model scoring by a weighted backoff automaton.

The model is an n-gram model with linear interpolation: with c(h w) the times that w followed h in the training texts,
P(w | h) = a c(h w) / c(h) + (1 - a) P(w | h'), where h' is h without its first word; for a context that doesn't occur it is
P(w | h'). P(w) is the base distribution, which gives all unknown words together the share of half an occurrence. As each word
of a text is followed by another or by the end, c(h) is also the times that h occurs.

As an automaton: contexts that occur in training are states; an n-gram that occurs is an arc from its context's state to that
of its last words, and weighs log10 P; a state's failure arc leads to the context without its first word and weighs log10(1 - a).

The n-grams of a large corpus fit no worker. So texts are dealt in blocks; a block names its distinct n-grams, with their
counts in its own training texts, to the buckets of their hashes; a bucket adds up what all blocks say of an n-gram and tells
each what it asked for; and a block builds the automaton of the n-grams that its texts can meet, which is all of the model
that they can tell from the whole, and walks its texts through it. An n-gram comes at most once from a block, however common
it is, so no bucket is much larger than others.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import content, partitions, table
from pagetide.llm.hashing import HASHES, MULT, mixed

FOLDS, FOLD = 5, 1
ORDER = 2
#: What the times that a word followed a context weigh against the next shorter context.
HIGHER = 1 / 3
#: Tokens to a block and n-grams to a bucket, about: a worker holds one of them.
BLOCK_TOKENS, BUCKET_NGRAMS = 1_000_000, 2_000_000
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Hashes of the begin and end of a text: no word has a space.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" begin", b" end"))
EMPTY = -1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each, and as eight more those of 255 or more."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


class Block:
    """The texts of a block by local numbers of their words and n-grams."""

    def __init__(self, texts: Iterable[str | None], order: int = ORDER):
        sequences = [np.concatenate(([BEGIN], HASHES.of(words(t)), [END])).astype(np.uint64) for t in texts]
        self.lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        flat = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
        #: By order less one: distinct n-grams' hashes, the number of the n-gram at each place, and of distinct ones the numbers of what they begin and end with.
        distinct, at = np.unique(flat, return_inverse=True)
        self.words, self.at, self.keys, self.heads, self.tails = len(distinct), [at], [mixed(distinct)], [None], [None]
        self.begin = int(np.searchsorted(distinct, BEGIN))
        rolled, left = distinct, np.repeat(self.lengths, self.lengths) - (np.arange(len(flat)) - np.repeat(self.starts[:-1], self.lengths))
        for k in range(1, order):
            whole = left[: len(flat) - k] > k  # within a text
            prefix, last = self.at[-1][: len(flat) - k][whole], at[k:][whole]
            code, inverse = np.unique(prefix * self.words + last, return_inverse=True)
            place = np.full(len(flat), EMPTY)
            place[np.flatnonzero(whole)] = inverse
            head, word = code // max(1, self.words), code % max(1, self.words)
            with np.errstate(over="ignore"):
                rolled = rolled[head] * MULT + distinct[word]
            tail = np.full(len(code), EMPTY)
            tail[inverse] = self.at[-1][1 : len(flat) - k + 1][whole]
            self.at.append(place)
            self.keys.append(mixed(rolled + np.uint64(k)))
            self.heads.append(head)
            self.tails.append(tail)

    def counts(self, training: np.ndarray) -> np.ndarray:
        """Of each distinct n-gram of all orders, the times that it is in texts that are for training."""
        own = np.repeat(training, self.lengths)
        return np.concatenate([np.bincount(at[own & (at != EMPTY)], minlength=len(keys)) for at, keys in zip(self.at, self.keys, strict=True)])


class Automaton:
    """The model as far as a block's texts can tell.

    States are the n-grams of all orders but the last, and the empty one. The arcs of an n-gram's state are the n-grams that
    begin with it, so a word's arc is known by the n-gram that it ends; its weight is NONE if that doesn't occur in training.
    All states but the empty one have a failure arc of the same weight.
    """

    #: No weight of an arc, as those are logarithms of probabilities.
    NONE = 1.0

    def __init__(self, block: Block, counts: np.ndarray, total: int, distinct: int, higher: float = HIGHER):
        sizes = [len(k) for k in block.keys]
        first = np.concatenate(([0], np.cumsum(sizes)))
        n = np.split(counts.astype(np.float64), first[1:-1])
        whole = total + 0.5 * (distinct + 1)
        p = [(n[0] + 0.5) / whole]
        for k in range(1, len(sizes)):
            p.append(higher * n[k] / np.maximum(1, n[k - 1][block.heads[k]]) + (1 - higher) * p[-1][block.tails[k]])
        self.unknown, self.failure, self.top = float(np.log10(0.5 / whole)), float(np.log10(1 - higher)), len(sizes) - 1
        self.base, self.known = np.log10(p[0]), n[0] > 0
        self.weight = np.where(counts > 0, np.log10(np.concatenate(p)), self.NONE).tolist()
        #: By order less one, the arc that the word at each place takes from a state of so many words.
        self.arcs = [first[k] + np.concatenate((np.full(k, EMPTY), at))[: len(block.at[0])] for k, at in enumerate(block.at)]
        self.start = int(self.top > 0 and n[0][block.begin] > 0) if len(n[0]) else 0

    def score(self, first: int, end: int) -> float:
        """log10 of the probability of the words at these places, the last being an end: one pass from state to state, by failure arcs where a state has no arc for the word."""
        weight, unknown, failure, top = self.weight, self.unknown, self.failure, self.top
        state, total = self.start, 0.0
        for arcs in zip(*(a[first:end].tolist() for a in self.arcs), strict=True):
            while (w := weight[arcs[state]]) > 0:
                if not state:
                    total += unknown
                    break
                total += failure
                state -= 1
            else:
                total += w
                if state < top:
                    state += 1
        return total


def dealt_keys(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams' hashes, their order by bucket and hash, the buckets in that order that have any, and where each one begins, with the end."""
    keys = np.concatenate(block.keys)
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    own, starts = np.unique(bucket[order], return_index=True)
    return keys, order, own, np.append(starts, len(order))


def asked(dealt: DataFrame, buckets: int, order: int) -> DataFrame:
    """block, bucket, keys, counts: the distinct n-grams of a block that are dealt to a bucket, and the times that its training texts have them."""

    def of(rows: pa.Table) -> pa.Table:
        block = Block(rows.column("text").to_pylist(), order)
        counts = block.counts(~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
        keys, at, own, starts = dealt_keys(block, buckets)
        parts = [at[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True)]
        columns = [pa.array([rows.column("block")[0].as_py()] * len(own), pa.int64()), pa.array(own, pa.int64()), pa.array([keys[x].tobytes() for x in parts], pa.binary()), pa.array([packed(counts[x]) for x in parts], pa.binary())]
        return pa.Table.from_arrays(columns, ["block", "bucket", "keys", "counts"])

    return dealt.groupBy("block").applyInArrow(of, "block long, bucket long, keys binary, counts binary")


def answered(requests: DataFrame) -> DataFrame:
    """block, bucket, counts: the times that all training texts have the n-grams that a block has asked a bucket for, in the same order."""

    def of(rows: pa.Table) -> pa.Table:
        each = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("keys")]
        ends = np.cumsum([len(x) for x in each])
        own = np.concatenate([unpacked(c.as_py(), len(x)) for c, x in zip(rows.column("counts"), each, strict=True)])
        _, at = np.unique(np.concatenate(each), return_inverse=True)
        sums = np.zeros(at.max() + 1, np.int64)
        np.add.at(sums, at, own)
        whole = [packed(x) for x in np.split(sums[at], ends[:-1])]
        return pa.Table.from_arrays([rows.column("block"), rows.column("bucket"), pa.array(whole, pa.binary())], ["block", "bucket", "counts"])

    return requests.groupBy("bucket").applyInArrow(of, "block long, bucket long, counts binary")


def word_counts(rows: DataFrame) -> DataFrame:
    """key, n: distinct tokens of the training texts by their hash, and as null the tokens of all texts."""

    def of(batches):
        held, tokens, ends = [], 0, 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

        size = 0
        for b in batches:
            for text, apart in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = words(text.as_py())
                tokens += len(found) + 1
                if not apart:
                    ends += 1
                    size += len(found)
                    held.append(HASHES.of(found))
                    if size > BLOCK_TOKENS:
                        yield out()
                        size = 0
        if size:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([int(END.view(np.int64)), None], pa.int64()), pa.array([ends, tokens], pa.int64())], ["key", "n"])

    return rows.select("text", "held_out").mapInArrow(of, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, higher: float = HIGHER, block_tokens: int = BLOCK_TOKENS, bucket_ngrams: int = BUCKET_NGRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs.

    Texts whose crc32(doc_id) mod FOLDS isn't FOLD are for training; a null doc_id counts as the empty text there, so it
    takes part. Null and empty texts are one token, their end. Repeated rows count each. Without training texts all tokens
    are unknown and the base distribution has one class. An empty table gives no rows. Other columns aren't read.

    N-grams are told apart by 64 bits of hash: among 10^9 distinct ones, a pair is taken for one with a chance of about 3 %.
    """
    spark = docs.sparkSession
    apart = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == FOLD
    rows = docs.select(F.col(id_col).alias("doc_id"), content(text_col).alias("text"), apart.alias("held_out"))
    whole = F.col("key").isNull()
    found = word_counts(rows).where("n > 0").agg(F.count("key").alias("distinct"), F.sum(F.when(whole, 0).otherwise(F.col("n"))).alias("total"), F.sum(F.when(whole, F.col("n"))).alias("tokens")).first()
    distinct, total, tokens = found["distinct"], found["total"] or 0, found["tokens"] or 0
    blocks = max(partitions(spark), -(-tokens // block_tokens))
    buckets = max(partitions(spark), -(-tokens * order // bucket_ngrams))
    # By task too, so that rows that repeat a third of the table lie in as many blocks as tasks have read them.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def of(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            raise RuntimeError("a block has answers without texts")
        block = Block(own.column("text").to_pylist(), order)
        keys, at, mine, starts = dealt_keys(block, buckets)
        counts, place = np.full(len(keys), -1, np.int64), {b: k for k, b in enumerate(mine.tolist())}
        for b, answer in zip(told.column("bucket").to_pylist(), told.column("counts"), strict=True):
            part = at[starts[place[b]] : starts[place[b] + 1]]
            counts[part] = unpacked(answer.as_py(), len(part))
        if (counts < 0).any():
            raise RuntimeError("a block has n-grams without answers")
        automaton = Automaton(block, counts, total, distinct, higher)
        base, known, scores = [], [], []
        for i, j in zip((block.starts[:-1] + 1).tolist(), block.starts[1:].tolist(), strict=True):  # without its begin
            text = block.at[0][i:j]
            base.append(float(automaton.base[text].sum()))
            known.append(int(automaton.known[text].sum()))
            scores.append(automaton.score(i, j))
        n = pa.array(block.lengths - 1, pa.int64())
        columns = [own.column("doc_id"), own.column("held_out"), n, pa.array(known, pa.int64()), pa.array([total] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = answered(asked(dealt, buckets, order))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(of, schema)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
