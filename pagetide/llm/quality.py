"""Quality classifier by Bradley-Terry pairwise ranking.

Features of the text alone are weighted so that of a pair of documents, one labelled good and one bad, the good one has the
higher score: logistic loss on the difference of their features, over all pairs of all labelled documents. The loss of a
pair depends on two scores alone, so documents are added up by the bin of their score, and bins make pairs in place of
documents. The threshold is a quantile of the training scores: the part of the training documents that is labelled bad.
Scores are shifted so that the threshold falls on CUT.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import content, scratch, table, written

CUT = 0.3
FOLDS = 5
#: Labelled documents whose features come to the driver, at most. More are added up, and their scores counted, where they lie.
TRAINING_ROWS = 20_000
#: Bins of a score, and their width. What lies further out is in the outermost.
BINS = 1024
WIDTH = 1 / 32
#: Features are added up as whole multiples of 1 / UNIT, so that no order matters: 64 bits hold the sums of a billion documents.
UNIT = 1 << 16

CLASSES = np.full(256, 4, np.uint8)  # kinds of bytes: letters, digits, white space, plain marks, others
CLASSES[list(range(65, 91))] = 0
CLASSES[list(range(97, 123)) + list(range(128, 256))] = 1
CLASSES[48:58] = 2
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[list(b".,;:'\"()-")] = 5
NAMES = ["upper", "digit", "mark", "plain mark", "other per word", "word length", "short words", "distinct words", "commonest word", "repeated neighbours", "distinct lines", "odd words", "ends without letter", "log length"]


def features(text: str | None) -> list[float]:
    """Figures of the whole text, each roughly within 0 and 1; all 0 for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=6)
    ink = max(1, size - int(kinds[3]))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        kinds[0] / ink,
        kinds[2] / ink,
        kinds[4] / ink,
        kinds[5] / ink,
        min(1.0, kinds[4] / n / 3),
        min(1.0, ink / n / 20),
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        len(counts) / n,
        (max(counts.values()) - 1) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in counts.items() if not w.strip(b".,;:'\"()-!?").decode().isalpha()) / n,
        sum(c for w, c in counts.items() if w[-1] < 128 and not w[-1:].isalnum() and w[-1] not in b".,;:") / n,
        math.log1p(n) / 12,
    ]


def tallies(x: np.ndarray, good: np.ndarray, weights: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the scores x @ weights + shift, those of good rows BINS further on, and for each the number of rows, the sums of their features and of their products."""
    k = np.clip(np.floor(((x * weights).sum(axis=1) + shift) / WIDTH), -BINS // 2, BINS // 2 - 1).astype(np.int64) + BINS // 2 + BINS * good
    whole = np.rint(x * UNIT).astype(np.int64)
    upper = np.triu_indices(x.shape[1])
    rows = np.column_stack([np.ones(len(x), np.int64), whole, whole[:, upper[0]] * whole[:, upper[1]]])
    bins, place = np.unique(k, return_inverse=True)
    sums = np.zeros((len(bins), rows.shape[1]), np.int64)
    np.add.at(sums, place, rows)
    return bins, sums


def newton(tally, size: int, penalty: float = 1e-3) -> dict | None:
    """weights, mean and scale, by Newton's method on the mean of log(1 + exp(-d w)) over all pairs and a small penalty; None with one label only. tally: tallies() of all rows for weights and a shift."""
    w, mean, scale = np.zeros(size), np.zeros(size), np.ones(size)
    upper = np.triu_indices(size)
    for step in range(30):
        bins, sums = tally(w / scale, -float(mean @ (w / scale)))
        n, first = sums[:, 0].astype(float), sums[:, 1 : size + 1] / UNIT
        second = np.zeros((len(bins), size, size))
        second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = sums[:, size + 1 :] / UNIT**2
        if not step:
            mean = first.sum(axis=0) / max(1.0, n.sum())
            scale = np.maximum(np.sqrt(np.maximum(np.diagonal(second.sum(axis=0)) / max(1.0, n.sum()) - mean**2, 0)), 1e-6)
        plus, minus = bins >= BINS, bins < BINS
        if not plus.any() or not minus.any():
            return None
        z = (first - n[:, None] * mean) / scale
        zz = (second - first[:, :, None] * mean - mean[:, None] * first[:, None, :] + n[:, None, None] * np.outer(mean, mean)) / np.outer(scale, scale)
        score = (z @ w) / n  # a bin's mean
        p = 1 / (1 + np.exp(np.clip(score[plus][:, None] - score[minus], -30, 30)))
        h, pairs = p * (1 - p), n[plus].sum() * n[minus].sum()
        cross = z[plus].T @ h @ z[minus]
        slope = ((p.T @ n[plus]) @ z[minus] - (p @ n[minus]) @ z[plus]) / pairs + penalty * w
        curve = (np.tensordot(h @ n[minus], zz[plus], 1) + np.tensordot(h.T @ n[plus], zz[minus], 1) - cross - cross.T) / pairs + penalty * np.eye(size)
        move = np.linalg.solve(curve, slope)
        w = w - move * min(1.0, 2 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-3:
            break
    return {"weights": w, "mean": mean, "scale": scale}


def one_label(good: int, bad: int, size: int) -> dict:
    return {"weights": np.zeros(size), "mean": np.zeros(size), "scale": np.ones(size), "threshold": 0.0 if good or not bad else 1e-9}


def model_scores(x: np.ndarray, model: dict) -> np.ndarray:
    return ((x - model["mean"]) / model["scale"] * model["weights"]).sum(axis=1)


def fit(x: np.ndarray, good: np.ndarray) -> dict:
    """weights, mean, scale and threshold. x: features by row; good: whether a row is labelled good. With one label only, all scores are alike."""
    k = int((~good).sum())
    model = newton(lambda w, shift: tallies(x, good, w, shift), x.shape[1])
    if model is None:
        return one_label(len(x) - k, k, x.shape[1])
    score = np.sort(model_scores(x, model))  # the threshold's quantile: halfway between the k-th and the next score
    return model | {"threshold": float((score[k - 1] + score[k]) / 2)}


def fit_where_they_lie(rows: DataFrame) -> dict:
    """fit() of rows (good, x) of any number. Sums of bins come to the driver, and counts of scores."""
    size = len(NAMES)
    width = 1 + size + size * (size + 1) // 2

    def tally(weights, shift):
        def of(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                bins, sums = tallies(np.array(b.column(1).to_pylist(), float), np.array(b.column(0).to_pylist(), bool), weights, shift)
                yield pa.RecordBatch.from_arrays([pa.array(bins), *map(pa.array, sums.T)], ["bin", *(f"s{i}" for i in range(width))])

        sums = rows.select("good", "x").mapInArrow(of, "bin long, " + ", ".join(f"s{i} long" for i in range(width)))
        got = sums.groupBy("bin").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).toArrow().sort_by("bin")
        return got.column("bin").to_numpy(), np.column_stack([got.column(f"s{i}").to_numpy() for i in range(width)])

    k = rows.where("NOT good").count()
    model = newton(tally, size)
    if model is None:
        return one_label(rows.where("good").count(), k, size)

    def of(batches):
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(model_scores(x, model))], ["score"])

    counts = written(rows.select("x").mapInArrow(of, "score double").groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    return model | {"threshold": (ranked(counts, k) + ranked(counts, k + 1)) / 2}


def ranked(counts: DataFrame, k: int, parts: int = 4096) -> float:
    """The k-th lowest score of counts (score, n), by ever narrower ranges: at last one that holds few different scores, or one."""
    low, high, below = *counts.agg(F.min("score"), F.max("score")).first(), 0
    while True:
        inside = counts.where((F.col("score") >= low) & (F.col("score") <= high))
        part = F.least(F.floor((F.col("score") - low) / ((high - low) or 1.0) * parts), F.lit(parts - 1)).alias("part")
        ranges = inside.groupBy(part).agg(F.sum("n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("part").collect()
        for r in ranges:
            if below + r["n"] >= k:
                break
            below += r["n"]
        low, high = r["low"], r["high"]
        if low == high:
            return low


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> dict:
    """Fits on all labelled documents outside the held-out fold: on the driver up to rows of them, else where they lie.

    That bound is also what makes their ids fit to broadcast. Labels other than 0 and 1 don't count; of several for a doc_id the lowest does, and of several texts the one with the least hash.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg((F.min(label_col) == 1).alias("good"))
    if own.count() > rows:
        with scratch(docs.sparkSession):
            return fit_where_they_lie(written(labelled_features(docs.where(~held_out(id_col)), own, id_col, text_col)))
    picked = docs.select(F.col(id_col).alias("__id"), content(text_col).alias("text")).join(F.broadcast(own), "__id")
    # A row for each doc_id, so that the bound on ids bounds what comes to the driver too.
    picked = picked.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "good")).alias("t")).select("__id", "t.text", "t.good")

    def of(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "good", "x"])

    kind = dict(picked.dtypes)["__id"]
    got = picked.mapInArrow(of, f"id {kind}, good boolean, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    order = np.lexsort([*x.T, np.array(got.column("id").to_pylist(), object).astype(str)]) if len(x) else []  # whatever order the rows came in
    return fit(x[order], np.array(got.column("good").to_pylist(), bool)[order])


def labelled_features(docs: DataFrame, own: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """good, x of each doc_id that own has, whatever their number: features are joined, not texts."""

    def of(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["__id", "h", "x"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(content(text_col)).alias("h"), content(text_col).alias("text"))
    found = texts.mapInArrow(of, f"__id {dict(texts.dtypes)['__id']}, h long, x array<double>")
    return found.join(own, "__id").groupBy("__id").agg(F.min(F.struct("h", "x", "good")).alias("t")).select("t.good", "t.x")


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cut: float = CUT) -> DataFrame:
    """doc_id, the columns of keep, score of each row. The score is over cut where the model's is over its threshold, and lies within 0 and 1."""
    shift = math.log(cut / (1 - cut))

    def of(batches):
        w, b0 = model["weights"] / model["scale"], model["threshold"] + float(model["mean"] @ (model["weights"] / model["scale"]))
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(0)], float).reshape(-1, len(NAMES))
            # Row by row: a matrix product's last bits depend on how many rows a batch has.
            s = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1) - b0 + shift + 1e-12, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], [*b.schema.names[1:], "score"])

    rows = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("doc_id"), *keep)
    return rows.mapInArrow(of, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs, predicted 1 where the score is cut or more.

    Null and empty texts are scored like others, as texts without words. A null doc_id takes no part in training and counts
    as the empty text for the fold; repeated rows give a row each. Without labels, or with one only, all scores are alike.
    Without documents there are no rows. Only the text makes the score; other columns aren't read.
    """
    model = train(docs, labels, id_col, text_col, label_col, rows)
    out = scores(docs, model, id_col, text_col, cut=cut)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS, cut: float = CUT) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns. Edge cases as in classify()."""
    model = train(docs, labels, id_col, text_col, label_col, rows)
    w, b0 = model["weights"] / model["scale"], model["threshold"] + float(model["mean"] @ (model["weights"] / model["scale"]))
    place = docs.columns.index(text_col)

    def of(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(place)], float).reshape(-1, len(NAMES))
            yield b.filter(pa.array((x * w).sum(axis=1) - b0 + 1e-12 >= 0))

    return docs.mapInArrow(of, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
