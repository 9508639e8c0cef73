"""Byte-level BPE encoding and decoding from a file of ranks.

Encoding is a two-tier lookup: a minimal perfect hash resolves pre-tokens that are a piece of the vocabulary as a whole;
the rest is merged by a heap over linked bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a Python worker remembers, and their bytes, at most twice: when so many are new, those not met since
#: the last time go. Longer ones than LONGEST aren't remembered.
REMEMBERED, REMEMBERED_BYTES, LONGEST = 200_000, 8_000_000, 200


class PerfectHash:
    """A minimal perfect hash of byte strings (hash and displace): n slots for n keys, and a seed for each bucket of about two, which is found sooner than for larger ones.

    get() also compares the key, since a string that isn't a key falls on some slot too.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.buckets = n, max(1, (n + 1) // 2)
        self.slots: list[bytes | None] = [None] * n
        self.values = [0] * n
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.seeds = [0] * self.buckets
        free = np.ones(n, bool)
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if not own:
                continue
            if len(own) == 1:  # the last ones name a free slot outright
                break
            seed = 1
            while True:
                places = {self.place(hashes[i], seed) for i in own}
                if len(places) == len(own) and all(free[p] for p in places):
                    break
                seed += 1
            self.seeds[b] = seed
            for i in own:
                self.fill(self.place(hashes[i], seed), keys[i], i, free)
        left = iter(np.flatnonzero(free).tolist())
        for b, own in enumerate(members):
            if len(own) == 1:
                p = next(left)
                self.seeds[b] = -p - 1
                self.slots[p], self.values[p] = keys[own[0]], own[0]

    def place(self, h: int, seed: int) -> int:
        return -seed - 1 if seed < 0 else ((h >> 20) ^ (seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 % 0xFFFFFFFFFFFFFFC5 % self.size

    def fill(self, p: int, key: bytes, i: int, free: np.ndarray) -> None:
        self.slots[p], self.values[p], free[p] = key, i, False

    def get(self, key: bytes) -> int:
        """The key's number in the list given, or -1."""
        if not self.size:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        p = self.place(h, self.seeds[h % self.buckets])
        return self.values[p] if self.slots[p] == key else -1


class Codec:
    """Encodes and decodes by the ranks of one file. Pieces of lower rank merge first; of equal pairs, the leftmost."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.pieces)
        self.bytes_of = {i: p for p, i in ranks.items()}
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known = Known(self)

    def pretoken(self, piece: bytes) -> bytes:
        """A pre-token's ids as little-endian unsigned 32-bit integers."""
        if (k := self.hash.get(piece)) >= 0:
            return self.ids[k].to_bytes(4, "little")
        return np.array(self.merge(piece), "<u4").tobytes()

    def merge(self, piece: bytes) -> list[int]:
        """Merges over a linked list of parts; the heap holds pairs by rank and place, and drops those whose parts have changed."""
        n, ranks = len(piece), self.ranks
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = after[i] if ends[i] else n
            if j >= n or ends[j] != end:  # a part is gone or has grown
                continue
            ends[i], ends[j] = end, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : ends[k]])) is not None:
                    heappush(heap, (r, i, ends[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Known(dict):
    """Ids of the pre-tokens met lately in this worker, in two generations, so that frequent ones stay."""

    def __init__(self, codec: Codec):
        self.codec, self.older, self.held = codec, {}, 0

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self.codec.pretoken(piece.encode())
        if len(self) >= REMEMBERED or self.held >= REMEMBERED_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        if (ids := self.older.get(piece)) is None:
            ids = self.codec.pretoken(piece.encode())
        self[piece] = ids
        self.held += len(piece) + len(ids)
        return ids


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, unsigned 32 bit): a row for each row of docs, in their order.

    A null text counts as empty and gives no ids. doc_id is only carried: it may be null or repeat. An empty table gives no
    rows. Other columns aren't read. Special tokens have no meaning here: their strings are ordinary text.
    path: the file of ranks, which each executor must have (it comes with the tokenizers' package).
    """
    return encoded(docs, id_col, text_col, path, pattern, "doc_id long, n_tokens long, ids array<int>", lambda doc, ids: (doc, len(ids) // 4, np.frombuffer(ids, "<i4")))


def encoded(docs, id_col, text_col, path, pattern, schema, row) -> DataFrame:
    path = path or public_tokenizers.path(VOCABULARY)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    names, types = zip(*((n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))), strict=True)

    def of(batches):
        c = codec(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                out = [row(doc, c.encode(t.as_py() or "")) for doc, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return own.mapInArrow(of, schema)


def decode(ids: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, decoded (binary; ids may end within a character) of doc_id, ids. Null ids decode to no bytes; an unknown id is an error."""
    path = path or public_tokenizers.path(VOCABULARY)

    def of(batches):
        c = codec(path, pattern)
        for b in batches:
            out = [c.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(of, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text where it lies and keeps digests only. Edge cases as in encode()."""
    own_path = path or public_tokenizers.path(VOCABULARY)

    def digests(doc, ids):
        decoded = codec(own_path, pattern).decode(ids)
        return doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return encoded(docs, id_col, text_col, own_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
