import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pagetide.llm import bpe, token_counts
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
ODD = "aBÉßµ²½'’ \t\ńéİΣς١x1.,!?中 \x85\x1c \r\n-—😀"


def odd_texts(n=400, seed=2):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choices(ODD, k=rnd.randrange(60))) + rnd.choice(["", "<|endoftext|>", "a<|startoftext|>b", "it's we'll"]) for _ in range(n)]
    return [*texts, "", "a" * 20_000, " " * 3000, "the cat sat on the mat " * 500]


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    for n in (0, 1, 2, 5, 1000):
        keys = [b"k%d" % i for i in range(n)]
        h = bpe.PerfectHash(keys)
        assert [h.get(k) for k in keys] == list(range(n)) and h.size == n == len(h.slots)
        assert all(h.get(b"x%d" % i) == -1 for i in range(200))


def test_codec(reference):
    codec = bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    for text in odd_texts():
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_every_kind_of_character(reference):
    codec = bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    points = [c for c in range(0, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    assert all(np.frombuffer(codec.encode(t), "<u4").tolist() == reference.encode_ordinary(t) for t in (f"a{chr(c)}1{chr(c)} " for c in points))


def test_memory_of_pretokens(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    for text in odd_texts(50):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_memory_is_bounded_by_bytes(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 2000)
    codec = bpe.Codec(bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("abcdefgh", k=150)) for _ in range(100)] + ["z" * 5000]
    for text in texts:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    held = [*codec.known.items(), *codec.known.older.items()]
    assert "z" * 5000 not in dict(held) and sum(len(k) + len(v) for k, v in held) <= 2 * (2000 + 150 * 5)


def test_round_trip(spark, reference):
    rows = [*enumerate(odd_texts(60)), (None, None), (7, "x"), (7, "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect())
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    decoded = bpe.decode(bpe.encode(docs).drop("n_tokens"))
    assert sorted(bytes(r.decoded) for r in decoded.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("head", [1_000_000, 40, 1])
def test_token_counts(spark, head):
    from tokenizers import Tokenizer

    rows = [*enumerate(odd_texts()), (None, None), (7, "x y"), (7, "x y")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"unit": F.lit(1), "n": F.lit(1)}).repartition(5)
    out = token_counts.token_counts(docs, limit=100, head=head)
    enc = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY)).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = sorted((str(i), len((t or "").encode()), len(e.ids), len(e.ids) > 100) for (i, t), e in zip(rows, enc, strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_units_are_pretokens():
    """Beyond Latin-1 too, and about special strings; pieces of the units sum to the library's."""
    path = public_tokenizers.path(token_counts.VOCABULARY)
    t = token_counts.tokenizer(path)
    assert token_counts.units("東京、大阪 東京<|endoftext|>สวัสดี123!?", path) == ["東京", "、", "大阪", "東京", "<|endoftext|>", *token_counts.units("สวัสดี123!?", path)]
    assert len(set(token_counts.units("我们，你们。" * 1000, path))) == 4
    points = [c for c in range(0, 0x30000, 11) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}e{chr(c)} {chr(c)}{chr(c + 1) if c + 1 < 0xD800 else ''}Σ" for c in points] + odd_texts()
    whole = token_counts.pieces_of(texts, path)
    parts = [token_counts.units(x, path) for x in texts]
    known = sorted({u for p in parts for u in p})
    pieces = dict(zip(known, token_counts.pieces_of(known, path), strict=True))
    assert [sum(pieces[u] for u in p) for p in parts] == whole and t is token_counts.tokenizer(path)


def test_long_pretokens_are_joined(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "LONGEST", 2)
    monkeypatch.setattr(token_counts, "SEEN", 10)
    rows = [(i, "abcdefghi xy z " + "q" * i) for i in range(30)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(rows, DOCS)).collect()}
    path = public_tokenizers.path(token_counts.VOCABULARY)
    assert [got[i] for i, _ in rows] == token_counts.pieces_of([t for _, t in rows], path)
