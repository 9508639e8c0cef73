import hashlib
import random

import numpy as np
import pytest
from pagetide.llm import exact_dedup, simhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (6, "x" * 200_000), (None, None), (7, "A")]


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.lit("same"), lambda t: F.length(t).cast("string")])
def test_exact_groups(spark, digest):
    """Also with digests that collide: contents alone decide."""
    out = exact_dedup.exact_groups(spark.createDataFrame(ROWS, DOCS), digest=digest)
    assert got(out) == brute_groups(ROWS)


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(docs).count() == exact_dedup.exact_dedup(docs).count() == 0


CLASH = ("__id", "__digest", "__again", "c0", "c1", "digest", "content", "salt", "row", "key", "unit", "rows", "fp", "root", "own", "of")


def test_exact_dedup_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit(k) for k, c in enumerate(CLASH)}).withColumn("map", F.create_map(F.lit("a"), F.col("doc_id")))
    for d in (docs, docs.drop("map")):
        out = exact_dedup.exact_dedup(d)
        assert out.schema.simpleString() == d.schema.simpleString()
        assert sorted((r.doc_id, (r.text or "")[:1], r.fp) for r in out.collect()) == [(2, "a", CLASH.index("fp")), (4, "", CLASH.index("fp")), (5, "b", CLASH.index("fp")), (6, "x", CLASH.index("fp")), (7, "A", CLASH.index("fp"))]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.lit("same")])
def test_exact_dedup_chooses_by_all_columns(spark, digest):
    """Equal texts under one id: the largest by the other columns stays, whatever order the rows come in."""
    rows = [(1, "same", "a", None), (1, "same", "b", 2), (1, "same", "b", None), (0, "same", "z", 9), (None, "same", "z", 9), (3, None, "a", 1), (3, "", "a", 1), (None, "w", None, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, n long")
        out = exact_dedup.exact_dedup(docs, digest=digest)
        assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "same", "b", 2), (3, "", "a", 1), (None, "w", None, None)], key=str)


def test_exact_random(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("abcde") * rnd.randrange(1, 4)) for i in range(3000)]
    assert got(exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS))) == brute_groups(rows)


def slow_fingerprint(text):
    import re

    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    texts = [None, "", " \t", "One", "one TWO", "a b c", "a b c d", "É é\x85x y z\xa0w", "a b c " * 10_000, "x" * 100_000]
    assert all(simhash.fingerprint(t) == slow_fingerprint(t) for t in texts)


def test_fingerprint_is_the_engines_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("ä b c"))).first()[0]
    assert simhash.fingerprint("ä B C") == row % 2**64


@pytest.mark.parametrize("size", [2, 40, 64, 65, 300])
def test_bit_sliced_links(size):
    rnd = np.random.default_rng(size)
    base = rnd.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rnd.integers(0, 63, (size, 2)))])[: size + 2])
    for sizes in ([len(fps)], [1, len(fps) - 1], [len(fps) // 2, len(fps) - len(fps) // 2]):
        up = list(range(len(fps)))

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        start = 0
        for n in sizes:
            for i in range(start, start + n):
                for j in range(i + 1, start + n):
                    if int(fps[i] ^ fps[j]).bit_count() <= 2:
                        up[max(root(i), root(j))] = min(root(i), root(j))
            start += n
        mine = list(range(len(fps)))
        for a, b in simhash.linked(fps, np.array(sizes), 2):
            assert int(fps[a] ^ fps[b]).bit_count() <= 2
            a, b = root(a, mine), root(b, mine)
            mine[max(a, b)] = min(a, b)
        assert [root(i, mine) for i in range(len(fps))] == [root(i) for i in range(len(fps))]


def brute_components(rows, radius=2):
    fps = [simhash.fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(root(i), []).append(d)
    return sorted((d, min(x for x in members[root(i)] if x is not None)) for i, (d, _) in enumerate(rows) if d is not None)


@pytest.mark.parametrize("max_block", [20_000, 2])
@pytest.mark.parametrize("radius", [0, 2, 4])
def test_near_groups(spark, max_block, radius):
    """With max_block 2 nearly all blocks go the way of blocks that are too large."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = [(None, "a b"), (100, None), (101, ""), (101, "")]
    for i in range(25):
        text = rnd.choices(words, k=60)
        for k in range(4):
            edit = list(text)
            for _ in range(k):
                edit[rnd.randrange(60)] = "new"
            rows.append((4 * i + k, " ".join(edit)))
    out = simhash.near_groups(spark.createDataFrame(rows, DOCS), radius=radius, max_block=max_block)
    assert sorted((r.doc_id, r.component_id) for r in out.collect() if r.doc_id is not None) == brute_components(rows, radius)


@pytest.mark.parametrize("radius", [None, 2])
def test_near_dedup(spark, radius):
    rows = [(5, "a b c"), (3, "a b c"), (4, "something else entirely"), (None, "a b c"), (9, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(k) for k, c in enumerate((*CLASH, "component_id", "doc"))})
    out = simhash.near_dedup(docs, radius=radius)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["3", "4", "9"]
    assert simhash.near_dedup(docs.limit(0), radius=radius).count() == 0
    with pytest.raises(ValueError):
        simhash.near_groups(docs, radius=3)


@pytest.mark.parametrize("radius", [None, 2])
def test_near_dedup_of_repeated_ids(spark, radius):
    """An id may stand for several texts; each group keeps one row, and what resembles nothing stays."""
    rows = [(1, "w", "a"), (2, "w", "a"), (2, "v", "a"), (1, "w", "b"), (None, "u", "a"), (None, "u", "b"), (None, "t", "a"), (7, "", "a"), (8, None, "a")]
    out = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), radius=radius)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "w", "b"), (2, "v", "a"), (None, "u", "b"), (None, "t", "a"), (7, "", "a")], key=str)


def test_wide_fingerprints():
    """Two sets' prints never differ in more bits than the sets do, and folding changes nothing of that."""
    rnd = np.random.default_rng(5)
    for _ in range(300):
        pool = rnd.integers(0, 2**63, int(rnd.integers(2, 900)), dtype=np.uint64)
        a, b = (np.unique(pool[rnd.random(len(pool)) < x]) for x in (0.95, 0.9))
        words = min(len(simhash.wide(a)), len(simhash.wide(b)))
        differ = int(np.bitwise_count(simhash.folded(simhash.wide(a), words) ^ simhash.folded(simhash.wide(b), words)).sum())
        assert differ <= len(np.setxor1d(a, b))
        assert simhash.near(simhash.wide(a), simhash.wide(b), len(a), len(b)) >= simhash.similar(a, b)


@pytest.mark.parametrize("rows", [1, 50, 4096])
@pytest.mark.parametrize("size", [2, 63, 64, 65, 300])
def test_near_in_blocks(size, rows):
    """Bit-sliced comparison of wide prints against one by one, over several widths and blocks."""
    rnd = np.random.default_rng(size)
    base = rnd.integers(0, 2**63, 150, dtype=np.uint64)
    sets = []
    for _ in range(size):
        own = base[rnd.random(150) < 0.97]
        sets.append(np.unique(np.concatenate([own, rnd.integers(0, 2**63, int(rnd.integers(0, 40)), dtype=np.uint64)])))
    prints, sizes, roots = [simhash.wide(x) for x in sets], np.array([len(x) for x in sets]), rnd.integers(0, 3, size)
    for blocks in ([0], [0, size // 2], sorted({0, 1, 3, 4, size // 3, size - 1})):
        start = np.array([max(b for b in blocks if b <= i) for i in range(size)])
        got_ = {tuple(sorted(x)) for x in simhash.near_in_blocks(prints, sizes, roots, start, rows).T.tolist()}
        want = {(i, j) for i in range(size) for j in range(i + 1, size) if start[i] == start[j] and roots[i] != roots[j] and simhash.sizes_fit(sizes[i], sizes[j]) and simhash.near(prints[i], prints[j], sizes[i], sizes[j])}
        assert got_ == want


def test_words_are_abandoned():
    """A word without a live lane isn't compared any further, whatever others do."""
    fps = np.concatenate([np.zeros(64, np.uint64), np.full(64, simhash.ALL)])
    block = simhash.planes(fps, np.arange(0, 128, 64), (np.arange(128) % 64).astype(np.uint64))
    query = np.zeros((64, 1), np.uint64)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            seen.append(len(key))
            return np.asarray(super().__getitem__(key))

    class Planes:
        def __len__(self):
            return 64

        def __getitem__(self, b):
            return block[b].view(Watched)

    place, near, _ = simhash.within(Planes(), query, np.array([0, 1]), np.array([0, 0]), np.full(2, simhash.ALL), 2)
    assert place.tolist() == [0] and near.tolist() == [2**64 - 1]
    assert seen == [2] * simhash.CHUNK + [1] * (64 - simhash.CHUNK)


def brute_similar(rows):
    sets, up = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {d: min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i, (d, _) in enumerate(rows)}


def test_pairs_planted_at_a_similarity(spark):
    """Ends replaced, so that the similarity is known: 0.8 to 0.95 are near copies, and 0.79 isn't one."""
    rnd = random.Random(11)
    rows, near = [], {}
    for k in range(240):
        share = (0.79, 0.8, 0.85, 0.9, 0.95)[k % 5]
        text = [f"{k}x{rnd.randrange(10**6)}" for _ in range(183 + 4)]
        # n shingles each, c of them common: c / (2 n - c)
        lost = next(m for m in range(1, 183) if (183 - m) / (183 + m) < share) - 1 if share != 0.79 else 21
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[: len(text) - lost] + [f"{k}new{i}" for i in range(lost)]))]
        near[2 * k + 1] = 2 * k if share >= 0.8 else 2 * k + 1
    want = brute_similar(rows)
    assert {d: want[d] for d in near} == near
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()} == want
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == sorted(set(want.values()))


def test_similar_chains_and_short_texts(spark):
    """Chains of edits, of which neighbours alone are similar; texts of a few words; and words in which many texts agree."""
    rnd = random.Random(4)
    rows = [(1, ""), (2, None), (3, "a b"), (4, "A  b"), (5, "a c"), (6, "a b c d e"), (7, "a b c d f")]
    for k in range(12):
        text = [f"w{rnd.randrange(9)}" for _ in range(60)] + ["common"] * 20
        for i in range(20):
            text[3 * i] = f"new{k}"
            rows.append((100 * k + 10 + i, " ".join(text)))
    got_ = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got_ == brute_similar(rows)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert roots == {i: 0 for i in range(61)} | {1000: 1000, 1001: 1000}


def test_trees_of_blocks_in_pieces():
    """Whatever the pieces and batches, a block's members are one tree; singles are left out."""
    import pyarrow as pa

    rnd = random.Random(4)
    rows = sorted((block, place, rnd.randrange(2**40)) for block, n in ((3, 1), (5, 50), (6, 2), (7, 33), (9, 1), (11, 17)) for place in range(n))
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([10] * len(rows), pa.int64())]
    whole = pa.RecordBatch.from_arrays(columns, ["block", "place", "fp", "n"])
    for most in (2, 16, 33, 1000):
        for step in (1, 7, 200):
            batches = [whole.slice(k, step) for k in range(0, len(rows), step)]
            got = [(int(b), int(f), int(u), bool(x)) for out in simhash.trees(batches, 3, most) for b, f, u, x in zip(*out, strict=True)]
            by = {}
            for b, f, u, x in got:
                by.setdefault(b, []).append((f, u, x))
            assert {b: len(x) for b, x in by.items()} == {5: 50, 6: 2, 7: 33, 11: 17}
            for links in by.values():
                assert sum(not x for *_, x in links) == 1  # the root
                root = {f: f for f, _, _ in links}

                def top(v, root=root):
                    while root[v] != v:
                        v = root[v]
                    return v

                for f, u, x in links:
                    if x:
                        root[top(f)] = top(u)
                assert len({top(f) for f in root}) == 1


def test_tiles_bring_all_pairs_together(spark):
    rows = [(1, i) for i in range(100)] + [(2, 1000 + i) for i in range(7)] + [(3, 5)]
    asked = spark.createDataFrame(rows, "block long, fp long").withColumn("n", F.lit(1))
    dealt = {}
    for r in simhash.tiled(asked, 10).collect():
        dealt.setdefault(r.block, set()).add(r.fp)
    met = {frozenset((a, b)) for own in dealt.values() for a in own for b in own}
    for block in (1, 2, 3):
        own = [f for b, f in rows if b == block]
        assert all(frozenset((a, b)) in met for a in own for b in own)
    assert dealt[2] == set(range(1000, 1007)) and max(map(len, dealt.values())) < 60 and len(dealt) == 55 + 2


def test_near_groups_of_large_blocks(spark, monkeypatch):
    """Near copies among texts that share a long passage, hence bands: the same groups however small the tiles and pieces."""
    rnd = random.Random(5)
    common = [f"c{k}" for k in range(60)]
    texts = []
    for k in range(40):
        own = [f"o{k}_{j}" for j in range(rnd.choice([3, 10, 14, 20]))]
        texts += [" ".join(common + own), " ".join([*common, *own, "end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, simhash.similar_groups(docs).collect()), key=str)
    monkeypatch.setattr(simhash, "TILE", 4)
    monkeypatch.setattr(simhash, "PIECE", 5)
    got = sorted(map(tuple, simhash.similar_groups(docs.repartition(3)).collect()), key=str)
    assert got == want
