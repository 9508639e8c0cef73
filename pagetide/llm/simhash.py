"""Near-duplicates by SimHash: fingerprints, bit-sliced comparison within blocks, and connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import content, numbered, table, written
from pagetide.llm.exact_dedup import exact_dedup
from pagetide.llm.hashing import HASHES, mixed, runs_of

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Blocks with more fingerprints than this aren't compared pair by pair; balls() settles them.
MAX_BLOCK = 20_000
#: What near copies are without a radius: a Jaccard similarity of 4/5 or more of their sets of five-word shingles.
WORDS = 5
SIMILAR = (4, 5)
#: Two texts are compared if all minima of a band are equal. At 4/5 a pair is missed with a chance of (1 - 0.8 ** 5) ** 32, or 3 in a million.
BANDS, MINIMA = 32, 5
#: So many members of a block are compared with one before them at first, and in so many orders.
FAN, ORDERS = 16, 4
#: Bits of the wide fingerprints.
NARROWEST, WIDEST = 256, 65536
_SEEDS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * MINIMA), np.uint64, endpoint=False)
ONE = np.uint64(1)
ALL = np.uint64(2**64 - 1)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it. bytes.lower() and bytes.split() know ASCII only, as the definition does."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def own_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, text: a row is told by its id and its text's digest."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(content(text_col), 256)).alias("digest"), F.col(text_col).alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest, fp (the fingerprint's bits as a long). A null text counts as empty and gives 0."""

    def of(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "digest", "fp"])

    return own_rows(docs, id_col, text_col).mapInArrow(of, "doc_id long, digest binary, fp long")


def planes(fps: np.ndarray, starts: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """64 rows of words: row b has bit b of each fingerprint, in the fingerprint's lane of its word. starts: where each word's fingerprints begin."""
    return np.stack([np.bitwise_or.reduceat(((fps >> np.uint64(b)) & ONE) << lanes, starts) for b in range(64)])


#: Planes that are added up before words without a live lane are given up.
CHUNK = 8


def within(block: np.ndarray, query: np.ndarray, word: np.ndarray, asked: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Which lanes' fingerprints differ from a query's in radius bits or fewer.

    block: bit planes of words of 64 lanes; query: for each plane and query, all ones where the query has the bit. word and
    asked say which word is compared with which query, alive which of its lanes. The carry-save counters have a plane for
    each binary digit of the count; what they can't hold is out of the radius for good. A word is abandoned for a query as
    soon as all its lanes are out. Returns the comparisons that are left, by their place, their lanes within the radius, and
    the counters' planes.
    """
    digits = max(1, radius.bit_length())
    place = np.arange(len(word))
    count = [np.zeros(len(word), np.uint64) for _ in range(digits)]
    for first in range(0, len(block), CHUNK):
        for b in range(first, min(first + CHUNK, len(block))):
            carry = (block[b][word] ^ query[b][asked]) & alive
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            alive = alive & ~carry
        live = alive != 0
        if (n := int(np.count_nonzero(live))) < 0.7 * len(live):
            place, word, asked, alive, count = place[live], word[live], asked[live], alive[live], [c[live] for c in count]
            if not n:
                break
    over = np.zeros(len(alive), np.uint64)
    equal = np.full(len(alive), ALL)
    for d in reversed(range(digits)):  # count > radius, from the highest digit on
        if radius >> d & 1:
            equal = equal & count[d]
        else:
            over, equal = over | (equal & count[d]), equal & ~count[d]
    near = alive & ~over
    left = near != 0
    return place[left], near[left], [c[left] for c in count]


def lanes_of(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of lanes, the place of the word and the lane of each bit that is set."""
    return np.nonzero(np.unpackbits(near[:, None].view(np.uint8), axis=1, bitorder="little"))


class Forest:
    """Union-find over the fingerprints of one task's blocks; only the links of a spanning forest leave the task."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def later(queries: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query (an index below n) with each word of 64 lanes that has a later index: the query's place, the word, its later lanes."""
    words = -(-n // 64)
    asked, word = np.nonzero(np.arange(words)[None, :] >= (queries // 64)[:, None])
    alive = np.full(len(word), ALL)
    if n % 64:
        alive[word == words - 1] = (ONE << np.uint64(n % 64)) - ONE
    own = word == queries[asked] // 64
    alive[own] &= (ALL << (queries[asked[own]] % 64).astype(np.uint64)) << ONE
    return asked, word, alive


def linked(fps: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that span the links within each block; the blocks lie in fps one after another."""
    forest, begin = Forest(len(fps)), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    small = (sizes > 1) & (sizes <= 64)
    if small.any():  # a word holds a block; all blocks take their s-th fingerprint as the query at once
        own, size = begin[small], sizes[small]
        take = np.repeat(own - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        lane = (np.arange(size.sum()) - np.repeat(starts, size)).astype(np.uint64)
        block = planes(fps[take], starts, lane)
        for s in range(int(size.max()) - 1):
            has = np.flatnonzero(size > s + 1)
            query = ((block[:, has] >> np.uint64(s)) & ONE) * ALL
            full = np.where(size[has] == 64, ALL, (ONE << size[has].astype(np.uint64)) - ONE)
            place, near, _ = within(block, query, has, np.arange(len(has)), full & (ALL << np.uint64(s + 1)), radius)
            at, lanes = lanes_of(near)
            base = own[has[place[at]]]
            for first, other in zip((base + s).tolist(), (base + lanes).tolist(), strict=True):
                forest.join(first, other)
    for first, n in zip(begin[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):  # many words to a block, many queries at a time
        own = fps[first : first + n]
        starts, lane = np.arange(0, n, 64), (np.arange(n) % 64).astype(np.uint64)
        block = planes(own, starts, lane)
        step = max(1, 200_000 // len(starts))
        for q in range(0, n, step):
            ask = own[q : q + step]
            query = ((ask >> np.arange(64, dtype=np.uint64)[:, None]) & ONE) * ALL
            asked, word, alive = later(np.arange(q, q + len(ask)), n)
            place, near, _ = within(block, query, word, asked, alive, radius)
            at, lanes = lanes_of(near)
            for i, j in zip((q + asked[place[at]]).tolist(), (64 * word[place[at]] + lanes).tolist(), strict=True):
                forest.join(first + i, first + j)
    return forest.links


def block_links(blocks: DataFrame, radius: int, max_block: int) -> DataFrame:
    """a, b, hot: links that span each block (block, fp), or with hot set each fingerprint of a block that is too large."""

    def of(batches):
        left_b = left_f = np.empty(0, np.int64)
        hot = None  # the block that grew too large; its rows pass through

        def settle(keys, fps):
            cut = np.flatnonzero(np.diff(keys)) + 1
            sizes = np.diff(np.concatenate([[0], cut, [len(keys)]])) if len(keys) else np.empty(0, np.int64)
            many = np.repeat(sizes > max_block, sizes)
            own, u = sizes[sizes <= max_block], fps[~many].view(np.uint64)
            pairs = np.array(linked(u, own, radius), np.int64).reshape(-1, 2) if len(u) else np.empty((0, 2), np.int64)
            f = fps[~many]
            return emit(f[pairs[:, 0]], f[pairs[:, 1]], False), emit(fps[many], fps[many], True)

        def emit(a, b, flag):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), flag))], ["a", "b", "hot"])

        for batch in batches:
            keys, fps = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if hot is not None:
                n = int(np.searchsorted(keys != hot, True))
                if n:
                    yield emit(fps[:n], fps[:n], True)
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                hot = None
            keys, fps = np.concatenate([left_b, keys]), np.concatenate([left_f, fps])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys == keys[-1], True))
            yield from settle(keys[:last], fps[:last])
            left_b, left_f = keys[last:], fps[last:]
            if len(left_b) > max_block:
                yield emit(left_f, left_f, True)
                hot, left_b, left_f = left_b[0], left_b[:0], left_f[:0]
        yield from settle(left_b, left_f)

    return blocks.mapInArrow(of, "a long, b long, hot boolean")


def balls(fps: DataFrame, radius: int) -> DataFrame:
    """a, b: links that connect all fingerprints (fp) within the radius, in space and time that grow as their number.

    Two fingerprints lie within an even radius if and only if the balls of half that radius around them meet, and any two
    of those that meet in one point lie within it. So each point links all it is met by to the smallest of these.
    """
    masks = [0]
    for n in range(1, radius // 2 + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(64), n)]
    masks = np.array(masks, np.uint64).view(np.int64).tolist()
    points = fps.select("fp", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    met = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # a ball's points bound the list
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for all nodes that have a link (a, b). Alternates large-star and small-star until nothing changes."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's five-word shingles, as sorted hashes; a text of fewer words is one shingle. Words are those of fingerprint()."""
    words = (text or "").encode().lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    with np.errstate(over="ignore"):
        return np.unique(runs_of(HASHES.of(words), WORDS))


def set_print(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of min-wise hashes; keys of different bands differ."""
    least = np.full(BANDS * MINIMA, ALL)
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[k : k + 2048, None] ^ _SEEDS[0]) * (_SEEDS[1] | ONE)).min(axis=0))
    with np.errstate(over="ignore"):
        return mixed((mixed(least) * _SEEDS[0]).reshape(BANDS, MINIMA).sum(axis=1))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches SIMILAR, exactly."""
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common * SIMILAR[1] >= (len(a) + len(b) - common) * SIMILAR[0]


def sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(n, m) * SIMILAR[1] >= np.maximum(n, m) * SIMILAR[0]


def apart(n, m):
    """How many shingles two sets of n and m may have that the other lacks, if they are similar."""
    return (n + m) * (SIMILAR[1] - SIMILAR[0]) // (SIMILAR[1] + SIMILAR[0])


def width(n: int) -> int:
    """Bits of the wide fingerprint of n shingles: a power of 2, twice n at least."""
    return min(WIDEST, max(NARROWEST, 1 << (2 * max(1, n) - 1).bit_length()))


def wide(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of width() bits: bit b is the parity of the shingles whose hash falls on b.

    Two sets' fingerprints never differ in more bits than there are shingles that only one of them has, so a radius of
    apart() loses no similar pair; SimHash's majorities promise no such thing. Half the width is that of the halves' xor.
    """
    bits = np.bincount((hashes & np.uint64(width(len(hashes)) - 1)).astype(np.int64), minlength=width(len(hashes)))
    return np.packbits((bits & 1).astype(np.uint8), bitorder="little").view("<u8")


def folded(fp: np.ndarray, words: int) -> np.ndarray:
    while len(fp) > words:
        fp = fp[: len(fp) // 2] ^ fp[len(fp) // 2 :]
    return fp


def near(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """Whether two wide fingerprints, of n and m shingles, allow the sets to be similar."""
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()) <= apart(n, m)


def near_in_blocks(prints: list[np.ndarray], sizes: np.ndarray, roots: np.ndarray, start: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Index pairs whose wide fingerprints are near, whose sizes allow similarity, and whose roots differ, of each block (start: where a row's block begins).

    Within a block, bit planes of all prints of a width, and of the next one folded to it, are compared with each print of
    the width: sizes that differ by more can't be similar. Blocks are taken up together, about so many rows of 1024 bits at a
    time, each with words of its own.
    """
    out = [np.empty((2, 0), np.int64)]
    widths = np.array([len(p) for p in prints])
    for w in np.unique(widths):
        own = (widths == w) | (widths == 2 * w)
        lanes = np.flatnonzero(own)
        lanes = lanes[np.lexsort((sizes[lanes], widths[lanes], start[lanes]))]  # by block, with those that ask first
        begins = np.flatnonzero(np.diff(start[lanes], prepend=-1))
        ends = np.append(begins[1:], len(lanes))
        many = (ends - begins > 1) & (widths[lanes[begins]] == w)
        begins, ends = begins[many], ends[many]
        k = 0
        while k < len(begins):
            j = max(k + 1, int(np.searchsorted(np.cumsum(ends[k:] - begins[k:]), max(1, 16 * rows // int(w)))) + k)
            out.append(_near(prints, sizes, roots, [lanes[a:b] for a, b in zip(begins[k:j], ends[k:j], strict=True)], int(w), widths))
            k = j
    return np.concatenate(out, axis=1)


def _near(prints, sizes, roots, blocks: list[np.ndarray], w: int, widths: np.ndarray) -> np.ndarray:
    rows = np.concatenate(blocks)
    count = np.array([len(x) for x in blocks])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    words = -(-count // 64)
    first_word = np.concatenate([[0], np.cumsum(words)[:-1]])
    block_of = np.repeat(np.arange(len(blocks)), count)
    inside = np.arange(len(rows)) - first[block_of]
    lane, word_of = (inside % 64).astype(np.uint64), first_word[block_of] + inside // 64
    row_at = np.full(int(words.sum()) * 64, -1)
    row_at[64 * word_of + lane.astype(np.int64)] = np.arange(len(rows))
    bits = np.unpackbits(np.stack([folded(prints[i], w) for i in rows]).view(np.uint8), axis=1, bitorder="little").T
    starts = np.flatnonzero(lane == 0)
    block = np.concatenate([np.bitwise_or.reduceat(bits[b : b + 64].astype(np.uint64) << lane, starts, axis=1) for b in range(0, len(bits), 64)])
    full = np.bitwise_or.reduceat(ONE << lane, starts)
    n, ids, sides = sizes[rows], roots[rows], widths[rows]
    least = np.minimum.reduceat(n, starts)
    out = []
    ask = np.flatnonzero(sides == w)
    reach = first_word[block_of[ask]] + words[block_of[ask]] - word_of[ask]  # words from a row's own to its block's last
    step = 200_000
    cut = np.searchsorted(np.cumsum(reach), np.arange(step, int(reach.sum()) + step, step))
    for part in np.split(np.arange(len(ask)), np.unique(cut[cut < len(ask)])):
        if not len(part):
            continue
        asked = np.repeat(ask[part], reach[part])
        word = word_of[asked] + np.arange(len(asked)) - np.repeat(np.cumsum(reach[part]) - reach[part], reach[part])
        alive = full[word].copy()
        same = word == word_of[asked]
        alive[same] &= (ALL << lane[asked[same]]) << ONE
        fits = (alive != 0) & (least[word] * SIMILAR[0] <= n[asked] * SIMILAR[1])
        asked, word, alive = asked[fits], word[fits], alive[fits]
        if not len(asked):
            continue
        used, at = np.unique(asked, return_inverse=True)
        # A later row of these words may be larger, but not by more than sizes that fit allow.
        most = int(apart(n[used], n[used] * SIMILAR[1] // SIMILAR[0]).max())
        place, left, digits = within(block, _Spread(bits[:, used]), word, at, alive, most)
        hit, lane_hit = lanes_of(left)
        differ = sum(((c[hit] >> lane_hit.astype(np.uint64)) & ONE).astype(np.int64) << d for d, c in enumerate(digits))
        i, j = asked[place[hit]], row_at[64 * word[place[hit]] + lane_hit]
        good = (differ <= apart(n[i], n[j])) & sizes_fit(n[i], n[j]) & (ids[i] != ids[j])
        out.append(np.stack([rows[i[good]], rows[j[good]]]))
    return np.concatenate([np.empty((2, 0), np.int64), *out], axis=1)


class _Spread:
    """A plane of query bits as words of all ones or none, made when it is asked for."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __getitem__(self, plane: int) -> np.ndarray:
        return self.bits[plane] * ALL


def whole_blocks(batches, binary: int | None = None, most: int | None = None):
    """Columns as arrays, of whole blocks of rows sorted by the first column; and where each row's block begins and ends. binary: the column that holds bytes, if one does. most: a block of more rows comes in pieces of so many."""
    left = None
    for batch in _ended(batches):
        own = None if batch is None else [np.array(c.to_pylist(), object) if k == binary else np.asarray(c) for k, c in enumerate(batch.columns)]
        rows = own if left is None else left if own is None else [np.concatenate(x) for x in zip(left, own, strict=True)]
        if rows is None or not len(rows[0]):
            continue
        open_at = int(np.searchsorted(rows[0], rows[0][-1]))
        last = len(rows[0]) if batch is None else open_at + (0 if most is None else (len(rows[0]) - open_at) // most * most)
        left, rows = [c[last:] for c in rows], [c[:last] for c in rows]
        if last:
            cut = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [last]])
            if most is not None:
                cut = np.unique(np.concatenate([cut, *(np.arange(i, j, most) for i, j in zip(cut[:-1], cut[1:], strict=True) if j - i > most)]))
            yield rows, np.repeat(cut[:-1], np.diff(cut)), np.repeat(cut[1:], np.diff(cut))


def trees(batches, fan: int, most: int):
    """block, fp, up for rows (block, place, fp, n) sorted by block: in each block, the fingerprint that each row is compared with, as a tree of so many branches; null where sizes forbid similarity. Of a block of more than most rows, each piece's first row is compared with that of the piece before."""
    block_before = root_before = size_before = None
    for (block, _, fp, size), start, end in whole_blocks(batches, most=most):
        at = np.arange(len(block))
        up = np.where(at > start, start + (at - start - 1) // fan, at)
        over, over_size = fp[up], size[up]
        linked, many = at > start, end - start > 1
        first = 0
        while first < len(block):  # pieces: a block's second one goes on with the first
            if block[first] == block_before:
                over[first], over_size[first], linked[first], many[first] = root_before, size_before, True, True
            block_before, root_before, size_before = block[first], fp[first], size[first]
            first = int(end[first])
        fits = many & linked & sizes_fit(size, over_size)
        yield block[many], fp[many], over[many], fits[many]


def tiled(asked: DataFrame, tile: int) -> DataFrame:
    """asked (block, ...), with a block of more than so many rows as blocks of two tiles each, dealt by fingerprint: each two rows meet in one of them at least, and no task compares more."""
    sizes = asked.groupBy("block").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > tile).select("block", F.ceil(F.col("members") / tile).cast("int").alias("tiles"))
    rows = asked.join(sizes, "block", "left").withColumn("tile", F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))))
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    pair = F.xxhash64("block", F.least("tile", "other"), F.greatest("tile", "other"))
    return each.select(F.when(F.col("tiles").isNull(), F.col("block")).otherwise(pair).alias("block"), *(c for c in asked.columns if c != "block"))


def _ended(batches):
    yield from batches
    yield None


#: Members of a block that are compared in a task, and rows of a block that a tree is made of.
TILE, PIECE = 8192, 65_536


def similar_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, by comparing their shingles."""

    def sets(batches):
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(0)]
            fp = np.array([set_print(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["fp", "shingles"])

    def check(batches):
        for b in batches:
            rows = zip(b.column(2), b.column(3), strict=True)
            yield b.select(["a", "b"]).filter(pa.array([similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in r)) for r in rows], pa.bool_()))

    asked = written(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi").select(F.col("least").alias("of"), F.col("digest").alias("own")))
    rows = own_rows(docs, id_col, text_col)
    texts = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("own")), "left_semi").select("text")
    known = written(texts.mapInArrow(sets, "fp long, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles")))
    one, other = (known.select(F.col("fp").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose wide fingerprints are near."""

    def check(batches):
        for b in batches:
            n, m = b.column(2).to_pylist(), b.column(4).to_pylist()
            prints = ([np.frombuffer(x.as_buffer(), "<u8") for x in b.column(k)] for k in (3, 5))
            yield b.select(["a", "b"]).filter(pa.array([near(*x) for x in zip(*prints, n, m, strict=True)], pa.bool_()))

    one, other = (nodes.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "wide_a", "n_b", "wide_b").mapInArrow(check, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As near_groups(), but texts link if their sets of five-word shingles are similar (SIMILAR); fp is the hash of the set.

    Texts that share a band of min-wise hashes are a block. In each block, some pairs are compared that would connect it if
    all were similar, so that a large group of near copies takes as many comparisons as it has members. Then the wide
    fingerprints of what is still in different components are compared bit-sliced, all with all; only pairs within the
    radius leave the task, and their shingles are compared. The radius is one that no similar pair exceeds. A block of more
    than TILE members is compared in many tasks, by pairs of tiles, and no task holds more than two of them.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sketch(batches):
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(2)]
            fp = np.array([set_print(x) for x in found], np.uint64).view(np.int64)
            keys = np.concatenate([bands(x) for x in found] or [np.empty(0, np.uint64)]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(keys))
            prints = pa.array([wide(x).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp), pa.array([len(x) for x in found], pa.int64()), prints, keys], ["doc_id", "digest", "fp", "n", "wide", "bands"])

    def tree(batches):
        for block, fp, up, fits in trees(batches, FAN, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(fp), pa.array(up, pa.int64(), mask=~fits)], ["block", "fp", "up"])

    def rest(batches):
        for (_, fp, size, root, prints), start, _ in whole_blocks(batches, 4):
            pair = fp[near_in_blocks([np.frombuffer(x, "<u8") for x in prints], size, root, start)]
            pair = np.unique(np.sort(pair, axis=0), axis=1)
            for i in range(0, pair.shape[1], 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in pair], ["a", "b"])

    sketches = written(own_rows(docs, id_col, text_col).mapInArrow(sketch, "doc_id long, digest binary, fp long, n long, wide binary, bands array<long>"))
    nodes = written(sketches.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "n", "wide", "bands")).alias("x")).select("fp", F.col("x.doc_id").alias("least"), "x.digest", "x.n", "x.wide", "x.bands"))
    members = nodes.select("fp", "n", F.posexplode("bands").alias("band", "block")).select("block", F.xxhash64("fp", F.col("band") % ORDERS).alias("place"), "fp", "n")
    shared = written(members.repartition(n, "block").sortWithinPartitions("block", "place", "fp").mapInArrow(tree, "block long, fp long, up long"))
    first = shared.where("up IS NOT NULL").select(F.least("fp", "up").alias("a"), F.greatest("fp", "up").alias("b")).distinct()
    links = written(similar_pairs(docs, nodes, written(near_pairs(first, nodes)), id_col, text_col))
    roots = components(links)
    named = written(shared.select("block", "fp").join(roots, shared.fp == roots.node, "left").select("block", "fp", F.coalesce("root", "fp").alias("root")))
    open_blocks = named.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("block")
    asked = named.join(open_blocks, "block").join(nodes.select("fp", "n", "wide"), "fp").select("block", "fp", "n", "root", "wide")
    second = written(tiled(asked, TILE).repartition(n, "block").sortWithinPartitions("block", "fp").mapInArrow(rest, "a long, b long").distinct())
    if not second.isEmpty():
        links = written(similar_pairs(docs, nodes, second, id_col, text_col)).unionByName(links)
    return named_by(sketches.select("doc_id", "digest", "fp"), nodes.select("fp", "least"), links)


def named_by(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, digest, fp, root, component_id: what names the component, and the smallest doc_id that links between fingerprints reach."""
    roots = components(links)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(named.join(written(least), "root").select("fp", "root", "component_id"))
    return prints.join(found, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None, max_block: int = MAX_BLOCK) -> DataFrame:
    """doc_id, digest, fp, root, component_id: fingerprints link at radius or fewer differing bits; component_id is the smallest doc_id that links reach.

    Without a radius, texts link by the similarity of their five-word shingles: see similar_groups().

    Equal fingerprints are one node, so copies are never paired. Fingerprints within the radius agree on two or more of
    radius + 2 parts, so nodes are compared within blocks that share two parts; whatever the block's size, no link is lost.
    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat give a row each. A null doc_id comes
    before all others only where its whole component has no id. An empty table gives no rows. Other columns aren't looked at.
    radius: 0, 2 or 4 (balls() needs it even).
    """
    if radius is None:
        return similar_groups(docs, id_col, text_col)
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4")
    prints = written(fingerprints(docs, id_col, text_col))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = radius + 2
    edge = [round(64 * i / parts) for i in range(parts + 1)]

    def bits(i):
        width = edge[i + 1] - edge[i]
        return F.shiftrightunsigned("fp", edge[i]).bitwiseAND(F.lit((1 << width) - 1))

    keys = [F.struct(F.lit(k).alias("k"), F.shiftleft(bits(i), edge[j + 1] - edge[j]).bitwiseOR(bits(j)).alias("bits")) for k, (i, j) in enumerate(combinations(range(parts), 2))]
    blocks = nodes.select("fp", F.explode(F.array(*keys)).alias("at")).select(F.xxhash64("at.k", "at.bits").alias("block"), "fp")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(block_links(blocks.repartition(n, "block").sortWithinPartitions("block", "fp"), radius, max_block))
    links = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    if not hot.isEmpty():
        links = links.unionByName(balls(hot, radius))
    return named_by(prints, nodes, links)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """One row of docs for each group, with its columns: that of the smallest doc_id, rows without an id coming last.

    Rows that repeat a doc_id are told apart by their texts, of which the smaller digest stays; of rows that repeat both,
    the one that exact_dedup() keeps. An empty table gives no rows.
    """
    names, rows = docs.columns, numbered(docs)
    own = [f"c{names.index(c)}" for c in (id_col, text_col)]
    alike = near_groups(rows, *own, radius).groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    stays = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "rows")).alias("x")).select(F.col("x.doc_id").alias("of"), F.col("x.digest").alias("own"), "x.rows")
    stays = written(stays)
    on = F.col(own[0]).cast("long").eqNullSafe(F.col("of")) & (F.unhex(F.sha2(content(own[1]), 256)) == F.col("own"))
    alone = rows.join(stays.where("rows = 1"), on, "left_semi")
    again = rows.join(stays.where("rows > 1"), on, "left_semi")
    return alone.unionByName(exact_dedup(again, *own)).toDF(*names)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), radius=RADIUS)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
