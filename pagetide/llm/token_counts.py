"""Token counts without ids: pieces are counted once for each distinct pre-token, then joined to each document's pre-token frequencies.

1. Each task counts its pre-tokens; their sums over the corpus are the distinct pre-tokens.
2. Each distinct pre-token goes through the tokenizer once.
3. Pre-tokens that make up more than one part in HEAD of the corpus, of which there can't be more than HEAD, are broadcast
   and added up where the documents are read. The others, which are too rare to be skewed or too long, are joined.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import table, written

VOCABULARY = "word_bpe_49k.json"
HEAD = 1_000_000
LIMIT = 2048
#: Distinct pre-tokens that a task holds before it passes their counts on, and characters of the texts they are from.
HELD, SEEN = 200_000, 1 << 27
#: Characters of a pre-token that may be broadcast; so HEAD bounds the bytes too.
LONGEST = 64

#: Texts in Latin-1 without odd control characters are cut here, as the tokenizer's normalizer and pattern cut them; any
#: other text by the tokenizer's own normalizer and pre-tokenizer, which takes longer.
PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e\xa1-\xff]*").fullmatch
PRETOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t\n\v\f\r a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+").findall


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # its threads don't survive a fork
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def special(path: str) -> re.Pattern | None:
    """What finds the special strings, the longest first."""
    strings = sorted((x.content for x in tokenizer(path).get_added_tokens_decoder().values()), key=lambda x: (-len(x), x))
    return re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None


def units(text: str, path: str) -> list[str]:
    """The text's pre-tokens. A special string within a text is the token it names, as the library has it, and one of them."""
    strings = special(path)
    if strings and strings.search(text):
        return [u for k, part in enumerate(strings.split(text)) for u in ([part] if k % 2 else units(part, path))]
    if PLAIN(text):
        return PRETOKENS(text.lower())
    t = tokenizer(path)
    clean = t.normalizer.normalize_str(text)
    return [clean[i:j] for _, (i, j) in t.pre_tokenizer.pre_tokenize_str(clean)]


def pieces_of(batch: list[str], path: str) -> list[int]:
    return [len(x) for x in tokenizer(path).encode_batch(batch, add_special_tokens=False)]


def distinct_units(rows: DataFrame, path: str) -> DataFrame:
    def of(batches):
        counts: Counter = Counter()

        def out():
            items = list(counts.items())
            counts.clear()
            for k in range(0, len(items), 20_000):
                u, n = zip(*items[k : k + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(n, pa.int64())], ["unit", "n"])

        seen = 0
        for b in batches:
            for t in b.column(1):
                text = t.as_py() or ""
                counts.update(units(text, path))
                seen += len(text)
                if len(counts) > HELD or seen > SEEN:
                    yield from out()
                    seen = 0
        yield from out()

    return rows.mapInArrow(of, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def with_pieces(distinct: DataFrame, path: str) -> DataFrame:
    def of(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pieces_of(part.column(0).to_pylist(), path), pa.int32())], ["unit", "n", "pieces"])

    return distinct.mapInArrow(of, "unit string, n long, pieces int")


#: The head that this worker holds, by the name of its run.
HEADS: dict[str, dict[str, int]] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each row of docs.

    Counts are those of the tokenizers library without begin, end or added special tokens, truncation or padding. Null
    counts as empty: no bytes, no tokens. doc_id may be null or repeat; repeated rows give a row each. An empty table gives
    no rows. Other columns aren't read. path: the tokenizer's file, which each executor must have.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = written(with_pieces(distinct_units(rows, path), path))
    total = counted.agg(F.sum("n")).first()[0] or 0
    common = (F.col("n") * F.lit(head) > F.lit(total)) & (F.length("unit") <= LONGEST)  # so no more than head
    sent = spark.sparkContext.broadcast(counted.where(common).select("unit", "pieces").toArrow())

    run = uuid.uuid4().hex

    def of(batches):
        if run not in HEADS:
            HEADS.clear()
            t = sent.value
            HEADS[run] = dict(zip(t.column("unit").to_pylist(), t.column("pieces").to_pylist(), strict=True))
        pieces, row = HEADS[run].get, TaskContext.get().partitionId() << 40
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                rare, times, ids, sizes, lengths = [], [], [], [], [0]
                for t in part.column(1):
                    text, own = t.as_py() or "", 0
                    rare.append(f"\n{row}")  # the document itself: no pre-token has white space
                    times.append(0)
                    first = len(times) - 1
                    for u, n in Counter(units(text, path)).items():
                        if (p := pieces(u)) is None:
                            rare.append(u)
                            times.append(n)
                        else:
                            own += n * p
                    times[first] = own
                    ids.append(row)
                    sizes.append(len(text.encode()))
                    lengths.append(len(times))
                    row += 1
                lists = [pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(x, t)) for x, t in ((rare, pa.string()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), part.column(0), pa.array(sizes, pa.int64()), *lists], ["row", "doc_id", "n_bytes", "units", "times"])

    # Written, since a row's number is its place in a task: a task that runs again may see its rows in another order.
    each = written(rows.mapInArrow(of, "row long, doc_id long, n_bytes long, units array<string>, times array<long>"))
    flat = each.select("row", "doc_id", "n_bytes", F.posexplode(F.arrays_zip("units", "times")).alias("pos", "x"))
    first = F.col("pos") == 0
    flat = flat.select("row", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n_bytes")).alias("n_bytes"), F.col("x.units").alias("unit"), F.col("x.times").alias("times"))
    rare = counted.where(~common).select("unit", "pieces").hint("shuffle_hash")
    tokens = F.sum(F.col("times") * F.coalesce("pieces", F.lit(1)))
    summed = flat.join(rare, "unit", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
