"""Substring deduplication: passages of 35 words or more that recur anywhere are confirmed, compiled to automata, and located.

1. Every window of 35 words has an anchor, the one of its phrases of 8 words with the smallest hash. Equal windows have the
   same anchor, so only windows whose anchor recurs (about one place in 15 is an anchor) can recur.
2. Windows whose anchor recurs are counted by a hash of 96 bits over the whole corpus: those counted twice or more are
   confirmed. One text that holds a confirmed window gives its words, so that a confirmed passage is known once, not where
   it occurs.
3. Confirmed passages are dealt by anchor to shards, each of which compiles Aho-Corasick automata over numbers of words. The
   stretches of all texts about the places of recurring anchors, which are all that the passages can lie in, are streamed
   through the shard of their anchor. What the automata locate there, word by word, is removed.

A text of several copies recurs as a whole, which its digest tells; it takes part for the sake of other texts only.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import partitions, table, written
from pagetide.llm.hashing import MULT, MULT_2, runs_of, word_hashes

WINDOW = 35
PHRASE = 8
#: Words of the windows that one automaton holds at most: two nodes of some 50 bytes each, less what windows share.
AUTOMATON_WORDS = 400_000
#: Texts that a task works on at once, and their bytes, unless one has more.
BATCH = 500
BYTES = 4_000_000
#: Windows of one anchor that a piece holds at most; it shares all but one word of a window with the next.
PART = 1_000
LOW = np.uint64(0xFFFFFFFF)
#: Stretches whose spans a task remembers.
KNOWN = 20_000
#: Stretches of one key that go to one shard; those of a more frequent key are split, each part with the key's passages.
HOT = 500


def places(grams: np.ndarray, n: int) -> np.ndarray:
    """Where the smallest of each n consecutive hashes lies, by their upper halves; of equal ones, the first."""
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= n:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < n:
        least = np.minimum(least[: width - n], least[n - width :])
    return (least & LOW).astype(np.int64)


class Texts:
    """The words of a batch of texts, one after another, and the windows that lie in one text: where each starts, its text, where its anchor begins, and the anchor's hash."""

    def __init__(self, texts: pa.Array, window: int, phrase: int):
        trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
        lists = pc.ascii_split_whitespace(trimmed)  # at the same six characters as bytes.split(); of an empty text, one empty word
        self.window, self.joined = window, pc.binary_join(lists, " ")
        self.counts = np.where(pc.binary_length(trimmed).to_numpy() > 0, pc.list_value_length(lists).to_numpy(), 0).astype(np.int64)
        words = lists.flatten()
        if not self.counts.all():
            words = words.filter(pc.greater(pc.binary_length(words), 0))
        self.hashes = word_hashes(words)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.bytes = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)])
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.starts = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :]) if len(text) >= window else np.empty(0, np.int64)
        self.text = text[self.starts]
        grams = runs_of(self.hashes, phrase) if len(self.starts) else self.hashes[:0]
        self.at = places(grams, window - phrase + 1)[self.starts] if len(grams) else self.starts
        self.key = grams[self.at]

    def keys(self) -> pa.ListArray:
        """For each text, the anchor of each place where one lies."""
        new = np.flatnonzero(np.diff(self.at, prepend=-1))
        ends = np.cumsum(np.bincount(self.text[new], minlength=len(self.counts)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(self.key[new].view(np.int64)))

    def first(self, multiplier: np.uint64 = MULT) -> np.ndarray:
        """A hash of each window."""
        return runs_of(self.hashes, self.window, multiplier)[self.starts] if len(self.starts) else self.hashes[:0]

    def pieces(self, chosen: np.ndarray):
        """Of each run of chosen windows with one anchor, wherever it lies: the anchor, the text, the first window's start in it, and the run's words. Long runs come in parts."""
        starts, text, key = self.starts[chosen], self.text[chosen], self.key[chosen]
        new = np.concatenate([[True], (np.diff(starts) > 1) | (np.diff(text) != 0) | (key[1:] != key[:-1])])[: len(starts)]
        begin = np.maximum.accumulate(np.where(new, starts, 0))
        cut = np.flatnonzero((starts - begin) % PART == 0)
        first, last, text = starts[cut], starts[np.append(cut, len(starts))[1:] - 1], text[cut]
        offsets = np.frombuffer(self.joined.buffers()[1], np.int32)[self.joined.offset :].astype(np.int64)
        data = memoryview(self.joined.buffers()[2] or b"")
        shift = offsets[text] - self.bytes[self.bounds[text]]
        ends = self.bytes[last + self.window] + shift - 1
        words = (data[i:j].tobytes() for i, j in zip((self.bytes[first] + shift).tolist(), ends.tolist(), strict=True))
        return key[cut].view(np.int64), text, first - self.bounds[text], words


def small(batches, column: int, rows: int = BATCH):
    """The batches in pieces of a few rows, and bytes of a column, so that what is made of one stays small."""
    for b in batches:
        begin = have = 0
        for k, size in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if k > begin and (k - begin == rows or have + size > BYTES):
                yield b.slice(begin, k - begin)
                begin, have = k, 0
            have += size
        if begin < b.num_rows:
            yield b.slice(begin)


def first_pass(docs: DataFrame, window: int, phrase: int, with_text: bool) -> DataFrame:
    """row, doc_id, digest, n_words, kept_sha256 (of all words), keys (the anchor of each place where one lies), all_text (null unless with_text)."""

    def of(batches):
        row = TaskContext.get().partitionId() << 40
        for b in small(batches, 1):
            w = Texts(b.column(1), window, phrase)
            digest = pa.array([hashlib.sha256(x or b"").digest() for x in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())
            kept = pa.array([hashlib.sha256(x).hexdigest() for x in w.joined.cast(pa.binary()).to_pylist()], pa.string())
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column(0), digest, pa.array(w.counts), kept, w.keys(), w.joined if with_text else pa.nulls(b.num_rows, pa.string())], NAMES)

    NAMES = ["row", "doc_id", "digest", "n_words", "kept_sha256", "keys", "all_text"]
    return docs.mapInArrow(of, "row long, doc_id long, digest binary, n_words long, kept_sha256 string, keys array<long>, all_text string")


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def opened(batch: pa.RecordBatch, window: int, phrase: int) -> tuple[Texts, np.ndarray]:
    """The texts of row, text, keys, ..., and which windows have one of the keys: whether a key recurs is the same for all texts."""
    w = Texts(batch.column(1), window, phrase)
    return w, among(w.key, np.unique(batch.column(2).flatten().to_numpy().view(np.uint64)))


def windows_of(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """row, copies, key, first, second: the key and two hashes of each window that has one of its text's keys. texts: row, text, keys, copies."""

    def of(batches):
        for b in small(batches, 1):
            w, asked = opened(b, window, phrase)
            text = w.text[asked]
            row, copies = (b.column(k).to_numpy()[text] for k in (0, 3))
            first, second = (w.first(m)[asked] for m in (MULT, MULT_2))
            short = (second >> np.uint64(32)).astype(np.uint32).view(np.int32)
            arrays = [row, copies, w.key[asked].view(np.int64), first.view(np.int64), short]
            for i in range(0, len(row), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in arrays], ["row", "copies", "key", "first", "second"])

    return texts.mapInArrow(of, "row long, copies long, key long, first long, second int")


def once(w: Texts, asked: np.ndarray, windows: pa.Array) -> np.ndarray:
    """Of the windows asked for, those whose first hash is among the ones given for their text; of equal ones in a text, the first."""
    hashes, out = w.first(), np.zeros(len(asked), bool)
    ends = np.searchsorted(w.text, np.arange(len(w.counts) + 1))
    for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if i < j:
            have = i + np.flatnonzero(asked[i:j] & among(hashes[i:j], np.asarray(windows[k].values).view(np.uint64)))
            out[have[np.unique(hashes[have], return_index=True)[1]]] = True
    return out


def pieces_of(texts: DataFrame, window: int, phrase: int, confirmed: bool) -> DataFrame:
    """key, row, start, piece: the words of consecutive windows with one anchor. texts: row, text, keys and, if confirmed, the first hashes of those windows that are, which alone are given then, each once for a text."""

    def of(batches):
        for b in small(batches, 1):
            w, asked = opened(b, window, phrase)
            if confirmed:
                asked = once(w, asked, b.column(3))
            key, text, start, words = w.pieces(asked)
            row = b.column(0).to_numpy()[text]
            for i in range(0, len(key), 10_000):
                part = slice(i, i + 10_000)
                piece = pa.array(list(islice(words, 10_000)), pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(row[part]), pa.array(start[part].astype(np.int32)), piece], ["key", "row", "start", "piece"])

    return texts.mapInArrow(of, "key long, row long, start int, piece string")


def digits(n: int) -> str:
    """A word's number as two symbols, each of its own range: an automaton looks through a node's edges one by one, and so meets few."""
    return chr(n & 127) + chr(128 + (n >> 7))


class Symbols(dict):
    """Symbols of words, numbered from 1 on; what isn't known is 0, which no window holds."""

    def __missing__(self, word: bytes) -> str:
        return digits(0)

    def of(self, words: list[bytes]) -> str:
        return "".join(map(self.__getitem__, words))


class Automata:
    """A shard's confirmed windows in as many automata as they need, over symbols of their words."""

    def __init__(self, window: int, limit: int = AUTOMATON_WORDS):
        self.window, self.most = window, max(1, limit // window)
        self.symbols = Symbols()
        self.compiled: list[ahocorasick.Automaton] = []
        self.open = None

    def add(self, piece: bytes) -> None:
        """Takes up all windows of a passage."""
        words = piece.split()
        for w in words:
            if w not in self.symbols:
                self.symbols[w] = digits(len(self.symbols) + 1)
        symbols = self.symbols.of(words)
        for i in range(0, 2 * (len(words) - self.window + 1), 2):
            if self.open is None:
                self.open = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_STRING)
            self.open.add_word(symbols[i : i + 2 * self.window], 1)
            if len(self.open) >= self.most:
                self.close()

    def close(self) -> None:
        if self.open is not None:
            self.open.make_automaton()
            self.compiled.append(self.open)
            self.open = None

    def locate(self, stretch: bytes) -> list[tuple[int, int]]:
        """Where windows of the shard cover words of the stretch: [begin, end) of each run, ascending."""
        self.close()
        symbols = self.symbols.of(stretch.split())
        ends = [end // 2 + 1 for a in self.compiled for end, _ in a.iter(symbols)]
        if len(self.compiled) > 1:
            ends = sorted(set(ends))
        out: list[tuple[int, int]] = []
        for end in ends:
            if out and end - self.window <= out[-1][1]:
                out[-1] = out[-1][0], end
            else:
                out.append((end - self.window, end))
        return out


def located(dealt: DataFrame, window: int, limit: int = AUTOMATON_WORDS) -> DataFrame:
    """row, begin, end: where confirmed passages cover words. dealt: shard, stretch (whether it is one, or a passage), row, start, piece; sorted so that a shard's passages come before its stretches."""

    def of(batches):
        shard, automata = None, None
        known: dict[bytes, list[tuple[int, int]]] = {}  # near copies have many stretches in common
        for b in small(batches, 4, 5_000):
            out = []
            for at, stretch, row, start, words in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if at != shard:
                    shard, automata = at, Automata(window, limit)
                    known.clear()
                if stretch:
                    if (spans := known.get(words)) is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        spans = known[words] = automata.locate(words)
                    out += [(row, start + i, start + j) for i, j in spans]
                else:
                    automata.add(words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["row", "begin", "end"])

    return dealt.mapInArrow(of, "row long, begin int, end int")


def removed_words(texts: DataFrame, with_text: bool) -> DataFrame:
    """digest, n_removed, kept_sha256, kept_text (null unless with_text). texts: digest, text, spans [begin, end) that go."""

    def of(batches):
        for b in small(batches, 1):
            gone, sha, kept = [], [], []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                begin, end = (np.asarray(spans.values.field(k)) for k in (0, 1))
                np.add.at(change, begin, 1)
                np.add.at(change, end, -1)
                mask = np.cumsum(change[:-1]) > 0
                left = b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m])
                gone.append(int(mask.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["digest", "n_removed", "kept_sha256", "kept_text"])

    return texts.mapInArrow(of, "digest binary, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, with_text: bool = False, hot: int = HOT, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text): a row for each row of docs.

    A word goes if a window of that many consecutive words covers it whose words also start anywhere else, in the same text
    too. Windows are judged on the input. Words are runs of anything but ASCII white space. Null and empty texts have no
    words; texts shorter than a window keep all. Repeated rows are copies like any others: each gives a row, and all their
    windows recur. doc_id may be null or repeat; it is only carried. An empty table gives no rows. Other columns aren't read.
    """
    if not 1 <= phrase <= window:
        raise ValueError("phrase must lie between 1 and window")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = written(first_pass(rows, window, phrase, with_text))
    own = first.where(F.size("keys") > 0).groupBy("digest").agg(F.min(F.struct("row", "doc_id")).alias("own"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    distinct = written(own.select("digest", F.least("copies", F.lit(2)).alias("copies"), "own.row", F.col("own.doc_id").alias("own_id"), "keys"))
    at = distinct.select("row", "copies", F.explode("keys").alias("key"))
    # Written, so that both sides of the join are dealt out for it alone and a common key's rows can be split.
    alone = F.min("copies") == 1  # else only texts that recur as a whole have it
    recurring = written(at.groupBy("key").agg(F.sum("copies").alias("n"), alone.alias("alone"), F.count(F.lit(1)).alias("places")).where("n > 1 AND alone").select("key", F.ceil(F.col("places") / F.lit(hot)).cast("int").alias("parts")))
    hits = at.join(recurring.select("key"), "key").groupBy("row").agg(F.collect_set("key").alias("keys"))
    asked = distinct.select("row", "digest", "own_id", "copies").join(hits, "row")
    # Of the copies of a text, the first is read again. Where rows repeat it comes twice, which changes nothing: such a text recurs, and its verdicts are alike.
    own_text = rows.withColumn("own_digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    texts = written(own_text.join(asked, (F.col("own_digest") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("row", "text", "keys", "copies", "digest"))
    singles = texts.where("copies = 1")
    # 96 bits: of 10^12 windows, no two that differ are likely to share them.
    counted = windows_of(texts.select("row", "text", "keys", "copies"), window, phrase).groupBy("first", "second").agg(F.sum("copies").alias("n"), alone.alias("alone"), F.min("row").alias("row"), F.first("key").alias("key"))
    confirmed = written(counted.where("n > 1 AND alone").select("row", "key", "first"))
    sources = texts.select("row", "text", "keys").join(confirmed.groupBy("row").agg(F.collect_list("first").alias("windows")), "row")
    passages = pieces_of(sources.select("row", "text", "keys", "windows"), window, phrase, confirmed=True)
    stretches = pieces_of(singles.select("row", "text", "keys"), window, phrase, confirmed=False)
    # A frequent key's stretches are split, and each part meets all passages; where passages are many they are split too, and each part meets all stretches.
    most = max(1, automaton_words // window)
    heavy = confirmed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("subs"))
    split = written(recurring.where("parts > 1").join(heavy, "key", "full").select("key", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("subs", F.lit(1)).alias("subs")))
    parts, subs = F.lit(1), F.lit(1)
    if not split.isEmpty():
        parts, subs = F.coalesce("parts", parts), F.coalesce("subs", subs)
        passages, stretches = passages.join(split, "key", "left"), stretches.join(split, "key", "left")
    passages = passages.withColumn("sub", F.pmod(F.xxhash64("piece"), subs).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    stretches = stretches.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), subs - 1)))
    n = partitions(rows.sparkSession)
    shards = max(n, -(-2 * confirmed.count() * window // automaton_words))  # so that one automaton holds most shards
    both = passages.withColumn("stretch", F.lit(False)).unionByName(stretches.withColumn("stretch", F.lit(True)))
    dealt = both.select(F.pmod(F.xxhash64("key", "part", "sub"), F.lit(shards)).alias("shard"), "stretch", "row", "start", "piece").repartition(n, "shard").sortWithinPartitions("shard", "stretch")
    spans = located(dealt, window, automaton_words).groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    less = removed_words(singles.select("row", "digest", "text").join(spans, "row").select("digest", "text", "spans"), with_text).withColumn("copied", F.lit(False))
    copied = distinct.where("copies > 1").select("digest", F.lit(True).alias("copied"))
    # One table of verdicts, so that a text of many copies meets them in one join, which can be split.
    verdicts = written(less.unionByName(copied, allowMissingColumns=True))
    out = first.select("doc_id", "digest", "n_words", F.col("kept_sha256").alias("all_sha256"), "all_text").join(verdicts, "digest", "left")
    gone = F.coalesce("copied", F.lit(False))
    columns = [
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(gone, "").otherwise(F.coalesce("kept_text", "all_text")).alias("kept_text"))
    return out.select(*columns)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS k FROM w, unnest(range(1, len(ws) - 33)) t(i)),
r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM s JOIN r USING (k), unnest(range(0, 35)) u(j)),
e AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = e.doc_id AND c.p = e.p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
