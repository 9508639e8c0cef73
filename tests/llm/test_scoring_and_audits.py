import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pagetide.llm import divergence, filter_audit, lm_scoring
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string"
LETTERS = str.maketrans("0123456789", "abcdefghij")
LABELS = "doc_id long, quality int, toxic int"


def random_text(rnd, n, vocabulary=60):
    return " ".join("Wx"[k % 2] + str(k).translate(LETTERS) + "." * (k % 7 == 0) for k in (int(vocabulary * rnd.random() ** 2) for _ in range(n)))


def given(rnd, n=90):
    """Rows with copies, nulls, empty, long and odd texts, ties, repeated rows and null ids."""
    odd = [None, "", " \t\n", "word", "A" * 300, "Ünï ÉCLAIR 漢字漢字 $5 | x", "a\x00b\x1fc\x85d e", "x " * 3000, random_text(rnd, 30_000, 5000), "$", "q" * 200_000]
    texts = [random_text(rnd, rnd.randrange(90)) for _ in range(n)]
    rows = [(i, rnd.choice(texts[:20]) if i % 3 else texts[i], rnd.choice(["en", "de", "", None]), rnd.choice(["s1", "s2", "é", None, ""])) for i in range(n)]
    rows += [(1000 + i, t, "en", "s1") for i, t in enumerate(odd)] + [(None, texts[0], "en", "s1"), (None, None, None, None), (5, texts[3], "en", "s2"), (5, texts[3], "en", "s2"), (2000, "only here", "xx", "alone"), (2001, "...", "yy", "a"), (2002, None, "yy", "b")]
    return rows


def clashing(docs):
    return docs.withColumns({c: F.lit(1) for c in ("n", "block", "bucket", "part", "item", "value", "total", "term", "own", "good", "digest", "held_out")})


def brute_scores(rows, order, higher):
    words = [[b" b", *lm_scoring.words(t), b" e"] for _, t, *_ in rows]
    apart = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, *_ in rows]
    counts, tokens = Counter(), Counter()
    for s, held in zip(words, apart, strict=True):
        if not held:
            tokens.update(s[1:])
            counts.update(tuple(s[i : i + k]) for k in range(1, order + 1) for i in range(len(s) - k + 1))
    n, v = sum(tokens.values()), len(tokens)

    def p(context, w):
        if not context:
            return (tokens[w] + 0.5) / (n + 0.5 * (v + 1))
        lower = p(context[1:], w)
        return higher * counts[(*context, w)] / counts[context] + (1 - higher) * lower if counts[context] else lower

    for (i, *_), s, held in zip(rows, words, apart, strict=True):
        yield i, held, len(s) - 1, sum(w in tokens for w in s[1:]), n, sum(math.log10(p((), w)) for w in s[1:]), sum(math.log10(p(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))


@pytest.mark.parametrize(("order", "block_tokens"), [(1, 10**6), (2, 500), (3, 5000), (4, 10**6)])
def test_scores_equal_brute_force(spark, order, block_tokens):
    rows = given(random.Random(order))
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    got = lm_scoring.scored(docs, order=order, block_tokens=block_tokens, bucket_ngrams=2000).collect()
    key = lambda r: (r[0] is None, r[0], r[2], r[6])
    want = sorted(brute_scores(rows, order, lm_scoring.HIGHER), key=key)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_probabilities_add_up():
    """After any words, over all words, the end and the unknown word."""
    rnd = random.Random(7)
    texts = [random_text(rnd, 40, 9) for _ in range(20)]
    vocabulary = sorted({w.lower() for t in texts for w in t.split()})
    for order in (1, 2, 3):
        befores = [" ".join(c) for n in range(order + 1) for c in itertools.product(vocabulary, repeat=n)]
        asked = [(c, w) for c in befores for w in (*vocabulary, "unseen", "")]
        block = lm_scoring.Block([*texts, *(f"{c} {w}" for c, w in asked)], order)
        training = np.array([True] * len(texts) + [False] * len(asked))
        counts = block.counts(training)
        own = counts[: block.words].copy()
        own[block.begin] = 0
        a = lm_scoring.Automaton(block, counts, int(own.sum()), int((own > 0).sum()))
        sums = Counter()
        for (c, w), i, j in zip(asked, block.starts[len(texts) : -1] + 1, block.starts[len(texts) + 1 :], strict=True):
            last = j - 1 if w == "" else j - 2  # the place of w, or of the end
            sums[c] += 10 ** (a.score(i, last + 1) - a.score(i, last))
        assert len(sums) == len(befores) and list(sums.values()) == pytest.approx([1] * len(sums))


def test_held_out_texts_are_likelier_than_by_words_alone(spark, sf):
    got = lm_scoring.op11_lm_scoring(spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.max("score")).first()
    assert got[0] > got[1] and got[2] < 0


def test_scoring_without_texts(spark):
    none = spark.createDataFrame([], DOCS)
    assert lm_scoring.scored(none).count() == 0
    apart = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm_scoring.scored(spark.createDataFrame([(apart, "a b", None, None)], DOCS)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0, 0)


def test_packed_counts():
    n = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert lm_scoring.unpacked(lm_scoring.packed(n), len(n)).tolist() == n.tolist()


def in_sql(sql, **tables):
    db = duckdb.connect()
    for name, (columns, rows) in tables.items():
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows) if rows else None
    r = db.sql(sql)
    return r.columns, r.fetchall()


def same(got, sql, **tables):
    columns, want = in_sql(sql, **tables)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)
    return want


SQL_DOCS = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR"


@pytest.mark.parametrize("shard_bytes", [1000, 1 << 25])
def test_divergence_equals_sql(spark, shard_bytes):
    rows = [r for r in given(random.Random(11)) if "\x00" not in (r[1] or "")]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    want = same(divergence.divergence(docs, shard_bytes=shard_bytes), divergence.OP12_SQL, documents=(SQL_DOCS, rows))
    assert {r[2] for r in want} == {"pair", "term"} and ("yy", "a", "pair", "b", 0, 1) in want and not [r for r in want if r[0] == "xx"]
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_terms():
    assert [t.decode() for t in divergence.terms("Ab-cD3e\x00é\x7fÉ漢 @Z[z`{a")] == ["ab", "cd", "e", "é", "É漢", "z", "z", "a"]
    assert divergence.terms(None) == divergence.terms(" 1 ") == []


def test_best_terms_end_at_the_top(spark):
    """Over 200 terms of a source, with ties, in many shards."""
    rows = [(i, " ".join(f"{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 676)}" for k in range(i % 2, 700, 2)), "en", f"s{i % 2}") for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    want = same(divergence.divergence(docs, shard_bytes=500), divergence.OP12_SQL, documents=(SQL_DOCS, rows))
    assert sum(r[2] == "term" for r in want) == 400


def test_filter_audit_equals_sql(spark):
    rnd = random.Random(13)
    rows = [r for r in given(rnd) if "\x00" not in (r[1] or "")]
    labels = [(rnd.randrange(100), rnd.randrange(2), rnd.randrange(2)) for _ in range(60)] + [(None, 1, 1), (1001, None, 1), (77777, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    audit = filter_audit.filter_audit(docs, spark.createDataFrame(labels, LABELS))
    want = same(audit, filter_audit.OP13_SQL, documents=(SQL_DOCS, rows), labels=("doc_id BIGINT, quality INT, toxic INT", labels))
    assert len(want) == 600 * len({r[3] or "" for r in rows})
    assert filter_audit.filter_audit(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    assert filter_audit.filter_audit(docs, spark.createDataFrame([], LABELS)).agg(F.sum("good_lost")).first()[0] == 0


def test_orders_follow_by_swaps_of_neighbours():
    for n in (1, 2, 3, 5):
        seen, before = [], None
        for order, swapped in filter_audit.orders(n):
            if before:
                before[swapped], before[swapped + 1] = before[swapped + 1], before[swapped]
                assert order == before
            before = list(order)
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == math.factorial(n)


def test_walk_looks_up_two_steps_for_each_swap(monkeypatch):
    looked = []
    step = filter_audit.Cells.step
    monkeypatch.setattr(filter_audit.Cells, "step", lambda self, *a: looked.append(a) or step(self, *a))
    assert len(list(filter_audit.walk(filter_audit.Cells([])))) == 600
    assert len(looked) == 5 + 119 * 2
