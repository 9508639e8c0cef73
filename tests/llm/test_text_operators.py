import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pagetide.llm import fingerprints, hashing, quality, substring_dedup
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def random_text(rnd, n, vocabulary=300):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def test_runs_of():
    h = np.random.default_rng(0).integers(0, 2**64, 200, dtype=np.uint64)
    for n in (1, 2, 5, 8, 35, 200):
        with np.errstate(over="ignore"):
            out = hashing.runs_of(h, n)
            alone = [hashing.runs_of(h[i : i + n], n)[0] for i in range(200 - n + 1)]
        assert out.tolist() == alone


def test_sketches():
    rnd = random.Random(1)
    for n in (0, 3, 30, 100, 3000):
        a, b = random_text(rnd, n), random_text(rnd, n)
        both = a + " " + b
        x, y, z = (fingerprints.Sketch.of(t) for t in (a, b, both))
        assert abs(x.resemblance(z) - likeness(shingles(a), shingles(both))) < 0.17
        assert abs(z.distinct() - len(shingles(both))) <= 0.3 * len(shingles(both))
        assert x.containment(z) > 0.8 or n < 5
        assert x.merge(y).hashes.tolist() == y.merge(x).hashes.tolist() and x.merge(x).text() == x.text()
        assert fingerprints.Sketch.parse(x.text()).hashes.tolist() == x.hashes.tolist()


def test_merged_parts_are_the_whole():
    rnd = random.Random(2)
    words = random_text(rnd, 4000, 10**6).split()
    parts = [fingerprints.Sketch.of(" ".join(words[i : i + 504])) for i in range(0, 4000, 500)]  # parts share four words
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    assert whole.text() == fingerprints.Sketch.of(" ".join(words)).text()


@pytest.mark.parametrize("shuffle", ["1", "4", "40"])
def test_edited_fingerprints(spark, shuffle):
    rnd = random.Random(3)
    rows = [(i * 7 % 61, random_text(rnd, rnd.randrange(80))) for i in range(61)] + [(100, None), (101, ""), (102, "é" * 5000), (103, " "), (104, "x")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        docs = spark.createDataFrame(rows, DOCS).withColumns({"bucket": F.lit(1), "key": F.lit(2), "guest": F.lit(3)}).repartition(3)
        got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
        assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
        alone = fingerprints.edited_fingerprints(docs.where("doc_id = 102")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert alone.near_next == 1 and alone.n_chars == 5000
    order = sorted(rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.Sketch.of(t).text() and r.edited_fingerprint == fingerprints.Sketch.of(edited).text()
        mine = shingles(t)
        assert r.n_shingles == len(mine) and abs(r.held_in_edited - (len(mine & shingles(edited)) / len(mine) if mine else 1)) < 1e-9
        assert abs(r.near_edited - likeness(shingles(t), shingles(edited))) < 1e-9 and abs(r.near_next - likeness(shingles(t), shingles(after))) < 1e-9


def test_fingerprints_of_ties(spark):
    rows = [(None, "b c"), (None, None), (5, "q"), (5, "q"), (5, "")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("5", 0), ("5", 1), ("5", 1), ("None", 0), ("None", 3)]
    plain = fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    assert len({r.fingerprint for r in plain}) == 3 and {r.n_shingles for r in plain} == {0.0, 1.0}


def test_ranges_split_an_id():
    keys, marks = np.array([1, 1, 1, 5, 5]), np.array([-9, 0, 7, -3, 3])
    at, first = fingerprints.range_of(np.array([0, 1, 1, 1, 1, 3, 5, 5, 6]), np.array([0, -10, -9, -1, 9, 0, -3, 2, 0]), keys, marks)
    assert at.tolist() == [0, 0, 0, 0, 2, 2, 3, 3, 4] and first.tolist() == [False, False, True, False, False, False, True, False, False]


def test_hot_ids_and_long_texts(spark):
    """A third of all rows without an id, and a third with one: their neighbours follow by hash and text, over many ranges."""
    rnd = random.Random(9)
    rows = [(None, random_text(rnd, rnd.randrange(60))) for _ in range(60)] + [(7, random_text(rnd, rnd.randrange(60))) for _ in range(60)] + [(i, random_text(rnd, 900, 10**5)) for i in range(8, 20)] + [(7, "same")] * 5
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        docs = spark.createDataFrame(rows, DOCS).repartition(4)
        got = sorted(tuple(r) for r in fingerprints.edited_fingerprints(docs).select("n_chars", "edited_sha256", "fingerprint").collect())
        marks = {r.text: r.m for r in docs.select("text", F.xxhash64("text").alias("m")).distinct().collect()}
        plan = fingerprints.with_next(docs, "doc_id", "text")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "CASE" not in plan and len(plan) < 40_000
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], marks[r[1]], r[1]))
    want = []
    for (_, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        want.append((len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest(), fingerprints.Sketch.of(t).text()))
    assert got == sorted(want)


def brute_removal(rows, window):
    seen = Counter()
    words = [(t or "").encode().split() for _, t in rows]
    for w in words:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        mask = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                mask[k : k + window] = [True] * window
        kept = b" ".join(x for x, m in zip(w, mask, strict=True) if not m)
        out.append((str(i), len(w), sum(mask), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "phrase"), [(35, 8), (6, 3), (4, 4), (3, 1), (1, 1)])
def test_substring_dedup(spark, window, phrase):
    rnd = random.Random(window)
    shared = [random_text(rnd, n) for n in (window - 1, window, window + 1, 3 * window, 200)]
    rows = [(i, " ".join(filter(None, [random_text(rnd, rnd.randrange(40)), rnd.choice(shared), random_text(rnd, rnd.randrange(40)), rnd.choice(["", *shared])]))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a " * 500), (103, "x y " * 50 + "z"), (104, random_text(rnd, 5000, 10**6)), (5, rows[5][1]), (None, rows[6][1]), (7, rows[7][1]), (7, rows[7][1]), (105, "É\x85\xa0 \t\n b"), (106, random_text(rnd, window)), (107, " \n")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "digest": F.lit(2), "copies": F.lit(3)}).repartition(5)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, window=window, phrase=phrase).collect()]
    assert sorted(got) == brute_removal(rows, window)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_kept_text(spark):
    rows = [(1, "one " + "p q r s " * 10 + "end"), (2, "p q r s " * 10), (3, "alone")]
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), with_text=True).collect()}
    assert got[1][0] == "one end" and got[2] == ("", 40) and got[3] == ("alone", 0)


def test_automata_in_shards():
    rnd = random.Random(4)
    texts = [[b"%d" % rnd.randrange(1, 4) for _ in range(rnd.randrange(60))] for _ in range(20)]
    passages = [t[i : i + n] for t in texts for i, n in ((0, 4), (3, 6)) if len(t) >= i + n]
    known = {tuple(p[i : i + 4]) for p in passages for i in range(len(p) - 3)}
    for limit in (1, 10, 10**6):
        automata = substring_dedup.Automata(4, limit)
        for p in passages:
            automata.add(b" ".join(p))
        for t in texts:
            hit = {k for i in range(len(t) - 3) if tuple(t[i : i + 4]) in known for k in range(i, i + 4)}
            spans = automata.locate(b" ".join(t))
            assert {k for i, j in spans for k in range(i, j)} == hit and spans == sorted(spans)
        assert (len(automata.compiled) == 1) == (limit == 10**6)


@pytest.mark.parametrize(("hot", "words"), [(1, 10**6), (2, 20), (10**6, 1)])
def test_substring_dedup_of_frequent_keys(spark, hot, words):
    """With keys split by their texts, by their passages, and by both."""
    rnd = random.Random(hot)
    line = random_text(rnd, 9)
    rows = [(i, " ".join([random_text(rnd, 5, 3), line, random_text(rnd, 5, 3), line])) for i in range(120)]
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), window=10, phrase=3, hot=hot, automaton_words=words).collect()]
    assert sorted(got) == brute_removal(rows, 10)


def test_pieces_of_a_repetitive_text(spark):
    """A window that recurs within a text is one passage, and neighbouring windows of one anchor are one stretch, in parts if long."""
    text = " ".join(["the"] * 3000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    texts = substring_dedup.first_pass(docs, 35, 8, False).select("row", F.lit(text).alias("text"), "keys", F.lit(1).cast("long").alias("copies"))
    stretches = substring_dedup.pieces_of(texts.select("row", "text", "keys"), 35, 8, confirmed=False).collect()
    sizes = [(r.start, len(r.piece.split())) for r in stretches]
    assert {k for start, n in sizes for k in range(start, start + n - 34)} == set(range(2966)) and sum(n for _, n in sizes) < 3200
    known = substring_dedup.windows_of(texts, 35, 8).agg(F.collect_set("first").alias("windows"))
    passages = substring_dedup.pieces_of(texts.select("row", "text", "keys").crossJoin(known), 35, 8, confirmed=True).collect()
    assert [r.piece for r in passages] == [" ".join(["the"] * 35)]


@pytest.mark.parametrize(("window", "phrase"), [(35, 8), (6, 3), (4, 4), (3, 1), (1, 1)])
def test_windows_of_many_texts(window, phrase):
    """The texts of a batch don't run into each other, and equal windows have one anchor."""
    rnd = random.Random(window)
    texts = ["", None, " \n", "a", *(random_text(rnd, n) for n in (window - 1, window, window + 1, 200)), "a " * 90, "É\x85\xa0\x1c \t\x0b\x0c\r b " * 40, " ".join(["z" * n for n in range(1, 140)] * 2), "same text " * 20, None]
    texts += [texts[7], f"x {texts[7]}"]
    b = pa.RecordBatch.from_arrays([pa.array(["first", *texts])], ["text"]).slice(1)
    w = substring_dedup.Texts(b.column(0), window, phrase)
    words = [(t or "").encode().split() for t in texts]
    flat = [x for t in words for x in t]
    assert w.counts.tolist() == [len(t) for t in words] and w.joined.to_pylist() == [b" ".join(t).decode() for t in words]
    assert len({*zip(flat, w.hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(w.hashes.tolist()))
    want = [(k, i) for k, t in enumerate(words) for i in range(len(t) - window + 1)]
    assert [*zip(w.text.tolist(), (w.starts - w.bounds[w.text]).tolist(), strict=True)] == want
    anchors = {}
    for (k, i), key, at in zip(want, w.key.tolist(), (w.at - w.starts).tolist(), strict=True):
        assert anchors.setdefault(tuple(words[k][i : i + window]), (key, at)) == (key, at) and 0 <= at <= window - phrase
    for part in (3, 1000):
        substring_dedup.PART, before = part, substring_dedup.PART
        try:
            key, text, start, pieces = w.pieces(np.arange(len(want)) % 7 > 0)
            got = [(k, i + j, tuple(p[j : j + window]), x) for x, k, i, p in zip(key.view(np.uint64).tolist(), text.tolist(), start.tolist(), (p.split() for p in pieces), strict=True) for j in range(len(p) - window + 1)]
        finally:
            substring_dedup.PART = before
        assert got == [(k, i, tuple(words[k][i : i + window]), x) for n, ((k, i), x) in enumerate(zip(want, w.key.tolist(), strict=True)) if n % 7]


def test_batches_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BYTES", 10)
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in (0, 4, 6, 1, 30, 0, 0, 0, 0, 9, 2)])], ["text"])
    assert [x.num_rows for x in substring_dedup.small([b, b.slice(0, 0)], 0, 4)] == [3, 1, 1, 4, 1, 1]


def test_occurrences_come_from_the_automata(spark, monkeypatch):
    rows = [(i, "p q r s " * 10 + str(i)) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {40}
    monkeypatch.setattr(substring_dedup, "located", lambda dealt, *_: dealt.selectExpr("row", "start as begin", "start as end").limit(0))
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {0}


def test_bradley_terry_learns_order():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(2000, len(quality.NAMES)))
    good = x[:, 0] - 2 * x[:, 3] + rnd.normal(scale=0.3, size=2000) > -1
    model = quality.fit(x, good)
    score = ((x - model["mean"]) / model["scale"]) @ model["weights"]
    assert ((score > model["threshold"]) == good).mean() > 0.93
    assert abs((score <= model["threshold"]).sum() - (~good).sum()) <= 1


def test_features():
    assert quality.features(None) == quality.features("") == quality.features(" \n") == [0.0] * len(quality.NAMES)
    assert all(0 <= v <= 1 for t in ("a", "A!! B!!", "x " * 1000, "1" * 10**6, "é ß ☃") for v in quality.features(t))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.classify(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == docs.count() and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    one = lambda x: sorted((r.doc_id, r.score) for r in x.collect())
    again = quality.classify(docs.repartition(7), labels.repartition(3))
    assert one(out) == one(again)
    few = quality.classify(docs, labels, rows=100).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in few]) > 0.85


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)], [(1, None), (None, 1)], [(1, 1), (1, 0), (2, 1), (2, 1)]])
def test_classifier_without_much_to_learn(spark, labels):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x"), (2, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("s"), "quality": F.lit(0)})
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.classify(docs, table)
    assert out.count() == 5 and all(0 <= r.score <= 1 for r in out.collect())
    kept = quality.good_documents(docs, table)
    assert kept.columns == docs.columns and kept.count() == out.where("predicted = 1").count()
    assert quality.classify(docs.limit(0), table).count() == 0


def test_scores_do_not_depend_on_other_columns(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "n_chars": F.lit(0)}), labels).collect()}
    assert a == b


def test_a_labelled_id_trains_once_however_often_it_is_there(spark, monkeypatch):
    """What comes to the driver is bounded by labelled ids, not by the rows that repeat them."""
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, good: seen.append((len(x), int(good.sum()))) or fit(x, good))
    docs = spark.createDataFrame([(3, f"text {i}") for i in range(300)] + [(i, f"some words {i}") for i in range(40)] + [(None, "x")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, quality int")
    a = quality.train(docs.repartition(5), labels)
    b = quality.train(docs.repartition(2), labels)
    ids = docs.select("doc_id").distinct().where("doc_id IS NOT NULL").where(~quality.held_out()).count()
    assert seen[0] == seen[1] and seen[0][0] == ids and a["weights"].tolist() == b["weights"].tolist()


def test_all_labelled_rows_train(spark):
    """More rows than the driver takes are fitted where they lie, to what it would have found in all of them; each counts."""
    texts = [(i, f"Some words {'!' * (i % 7)} {'UP ' * (i % 5)}{i * 7919 % 1000} and more {'x' * (i % 11)}") for i in range(600)]
    docs = spark.createDataFrame(texts, DOCS)
    labels = spark.createDataFrame([(i, int(i % 7 < 3 or i % 13 == 0)) for i, _ in texts], "doc_id long, quality int")
    whole, parted = quality.train(docs, labels), quality.train(docs.repartition(5), labels, rows=20)
    for name in ("weights", "mean", "scale", "threshold"):
        assert np.allclose(whole[name], parted[name], rtol=0, atol=1e-12), name
    # The loss over all pairs has no slope there, up to the bins' width.
    x, good = np.array([quality.features(t) for i, t in texts]), np.array([i % 7 < 3 or i % 13 == 0 for i, _ in texts])
    model = quality.fit(x, good)
    z = (x - model["mean"]) / model["scale"]
    d = (z[good][:, None] - z[~good]).reshape(-1, z.shape[1])
    slope = -(d / (1 + np.exp(d @ model["weights"]))[:, None]).mean(axis=0) + 1e-3 * model["weights"]
    assert np.abs(slope).max() < 1e-3
