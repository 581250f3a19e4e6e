"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its hashed byte n-grams, the value of one being the square root of its
share of the text's n-grams (with SMOOTH added to their number, so that short texts don't
saturate).  Each is scaled by log((p + a) / |p|) - log((q + a) / |q|), p and q being the sums of
values in the toxic and the other class.  A logistic regression on the scaled features is
fitted with an L2 penalty; for scoring, weight and scale become one number a feature, so the
model is one array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, held_out, mapped, slices, stored
from .grams import normal, slot, windows

WIDTHS = (4, 5, 6)
BITS = 20
#: Bounds of training: rows a class (drawn by a hash of doc_id) and features kept (by strength of their ratio).
CLASS_ROWS = 4_000
FEATURES = 1 << 14
SMOOTH = 300
LEAST_TEXTS = 4


def features(texts: list[str | None], keep: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indexes and values of each text's features, only of those marked in ``keep`` if given."""
    parts = [normal(t) for t in texts]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    total = np.zeros(len(texts))
    for k, width in enumerate(WIDTHS):
        keys, starts, ends = windows(parts, width)
        total += ends - starts
        idx = slot(keys, k, BITS)
        if keep is not None:
            at = np.flatnonzero(keep[idx])
            idx, starts, ends = idx[at], np.searchsorted(at, starts), np.searchsorted(at, ends)
        for f, a, b in zip(found, starts.tolist(), ends.tolist()):
            f.append(idx[a:b])
    counted = [np.unique(np.concatenate(f), return_counts=True) for f in found]
    return [(i, np.sqrt(1000 * n / (t + SMOOTH))) for (i, n), t in zip(counted, total)]


class Classifier:
    """score = 1 / (1 + exp(-(bias + the weighted sum of a text's features)))"""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.used = weights, bias, weights != 0

    def scores(self, texts: list[str | None]) -> list[float]:
        z = [self.bias + float(self.weights[i].astype(np.float64) @ v) for i, v in features(texts, self.used)]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def constant(positive: bool) -> Classifier:
    return Classifier(np.zeros(1 << BITS, np.float32), 5.0 if positive else -5.0)


def log_ratios(p: np.ndarray, q: np.ndarray, total_p: float, total_q: float, usual: float) -> np.ndarray:
    """Log-count ratios of features with value sums p and q; ``usual`` is the value of one occurrence in a text of mean length."""
    size = 1 << BITS
    return np.log((p + usual) / (total_p + usual * size)) - np.log((q + usual) / (total_q + usual * size))


def descend(index: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, rounds: int = 150, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (times ratio) and bias of the penalised logistic regression; both classes weigh the same."""
    y = labels.astype(float)
    row, col = np.repeat(np.arange(len(index)), [len(i) for i in index]), np.concatenate(index)
    x = np.concatenate(values) * ratio[col]
    scale = np.sqrt(np.bincount(row, x * x, len(index)).mean()) or 1.0
    x = x / scale
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias, speed = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio) + 1)
    for _ in range(rounds):  # gradient steps scaled by the gradients so far
        z = np.bincount(row, x * w[col], len(index)) + bias
        err = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.append(np.bincount(col, x * err[row], len(ratio)) + penalty * w / len(index), err.sum())
        speed += grad * grad
        step = 0.3 * grad / (np.sqrt(speed) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w * ratio / scale, float(bias)


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1.

    Of each class up to about CLASS_ROWS rows are drawn, by a hash of doc_id.  A null text counts
    as empty, a null mark is none; a document with several marks is toxic if one of them says so.
    Without both classes every text gets a score near 0 (or, if all are toxic, near 1).  Sums are
    made by the executors, as whole numbers so that their order is of no account; the driver gets
    FEATURES ratios and the sample's values of those features.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return constant(1 in n)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, min(1.0, CLASS_ROWS / n[1])).otherwise(min(1.0, CLASS_ROWS / n[0]))
    chosen = marked.where(draw < share * (1 << 30))  # at most about 2 * CLASS_ROWS rows of two numbers
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "sample")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << BITS), np.int64)
        for batch in slices(batches):
            for (i, v), c in zip(features(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                total[1 - c, i] += np.rint(v * 1024).astype(np.int64)
                total[2, i] += 1
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *total[:, at])], names=["i", "p", "q", "seen"])

    counted = stored(mapped(sample.select("text", "toxic"), sums, "i long,p long,q long,seen long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("p", "q", "seen")]), "sums")
    whole = counted.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    facts = sample.agg(F.avg(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    if whole["p"] is None or not 0 < facts["pos"] < facts["n"]:
        return constant(bool(facts["pos"]))
    usual = (1000 / (facts["chars"] * len(WIDTHS) + SMOOTH)) ** 0.5
    size = F.lit(float(usual * (1 << BITS)))
    strength = F.abs(F.log((F.col("p") / 1024 + usual) / (whole["p"] / 1024 + size)) - F.log((F.col("q") / 1024 + usual) / (whole["q"] / 1024 + size)))
    top = counted.where(F.col("seen") >= LEAST_TEXTS).orderBy(F.desc(F.round(strength, 9)), "i").limit(FEATURES).toPandas().sort_values("i")
    if not len(top):
        return constant(False)
    used = top["i"].to_numpy(np.int64)
    ratio = log_ratios(top["p"].to_numpy() / 1024, top["q"].to_numpy() / 1024, whole["p"] / 1024, whole["q"] / 1024, usual)
    keep = np.zeros(1 << BITS, bool)
    keep[used] = True

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = features(batch.column(2).to_pylist(), keep)
            lists = [pa.array([f[k] for f in found], pa.list_(t)) for k, t in ((0, pa.int64()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "toxic", "i", "v"])

    rows = mapped(sample.select("doc_id", "toxic", "text"), kept, "doc_id long,toxic int,i array<long>,v array<double>").toArrow().sort_by("doc_id")
    index, values = ([np.asarray(x.values, t) for x in rows[c]] for c, t in (("i", np.int64), ("v", np.float64)))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used], bias = descend([np.searchsorted(used, i) for i in index], values, rows["toxic"].to_numpy(), ratio)
    return Classifier(weights, bias)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts get the bias's score, equal texts equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = np.array(shared.value.scores(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), "text"), run, "doc_id long,held_out boolean,score double,predicted int")
