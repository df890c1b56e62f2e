"""Ordinal quality classifier: cumulative-link regression over hashed text.

Grades (0 toxic, 1 poor, 2 good) share one weight per hashed token; ordered thresholds cut the line at
P(grade > j) = sigmoid(w.x - theta_j). The weights are fitted with an L1 penalty on a bounded sample of rated rows
(`sample`, a documented parameter: the rows of smallest id hash); every document of the table is scored in one pass
without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts, tidy

#: Runs of letters (ASCII or not), and runs of other printable signs: junk shows in the second kind.
TOKEN = re.compile(rb"[a-z\x80-\xff]+|[!-/:-@\[-`{-~]+")


def features(text: bytes | None, bits: int) -> np.ndarray:
    """Distinct hashed tokens of a text: words and runs of signs, lower-cased; capital words count as a third kind."""
    if not text:
        return np.zeros(0, np.int64)
    mask, crc = (1 << bits) - 1, zlib.crc32
    words = set(text.split())
    found = set(TOKEN.findall(b" ".join(words).lower()))
    kinds = {crc(x) & mask for x in found}
    if sum(x.isupper() and len(x) > 2 for x in words) * 5 > len(words):
        kinds.add(crc(b"\0capitals") & mask)
    return np.fromiter(kinds, np.int64, len(kinds))


@dataclass(frozen=True)
class Model:
    bits: int
    buckets: np.ndarray  # sorted, those with a weight
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > j) for each row and threshold."""
        z = np.zeros(len(rows))
        if len(self.buckets):
            for i, x in enumerate(rows):
                at = np.searchsorted(self.buckets, x)
                at[at == len(self.buckets)] = 0
                z[i] = self.weights[at[self.buckets[at] == x]].sum()
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -40, 40)))


def ordered(theta: np.ndarray) -> np.ndarray:
    """The nearest ascending values."""
    k = range(len(theta))
    return np.array([max(min(theta[i : j + 1].mean() for j in k if j >= m) for i in k if i <= m) for m in k])


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, bits: int, l1: float = 2e-4, least: int = 3, turns: int = 200, tolerance: float = 1e-9) -> Model:
    """Proximal gradient with Nesterov steps on the mean negative log-likelihood plus l1 times the sum of |weights|;
    intercepts are not penalised.

    The length of a step is found by backtracking, and a step counts only if the penalised loss does not rise; one that
    would restarts from the best point without momentum. Ends after `turns` steps, or where a step without momentum
    lowers the loss by less than `tolerance`. Buckets in fewer than `least` sampled rows get no weight. Without rows or
    with one grade only, the thresholds alone carry the (smoothed) shares of the grades.
    """
    n = len(rows)
    shares = np.array([(grades > j).sum() + 0.5 for j in range(levels - 1)]) / (n + 1)
    theta = -np.log(shares / (1 - shares))
    sizes = np.fromiter(map(len, rows), np.int64, n)
    flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), sizes)
    buckets, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    often = counts >= least
    keep = often[at] if len(flat) else np.zeros(0, bool)
    doc, at = doc[keep], (np.cumsum(often) - 1)[at[keep]] if len(flat) else at
    buckets = buckets[often]
    if not len(buckets) or len(np.unique(grades)) < 2:
        return Model(bits, buckets[:0], np.zeros(0), np.maximum.accumulate(theta))
    # scaled columns: rare tokens move as fast as frequent ones
    scale = 1 / np.sqrt(np.bincount(at, minlength=len(buckets)) / n)
    scale = np.minimum(scale, np.sqrt(n / least))
    m, each = len(buckets), np.arange(n)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both ends of each row's grade on the sigmoid, and its probability (not above 0 where thresholds cross)."""
        z = np.bincount(doc, (x[:m] * scale)[at], minlength=n)
        edges = np.concatenate(([-np.inf], x[m:], [np.inf]))
        s = 1 / (1 + np.exp(-np.clip(edges[None, :] - z[:, None], -700, 700)))
        s[:, 0], s[:, -1] = 0, 1
        lo, hi = s[each, grades], s[each, grades + 1]
        return lo, hi, hi - lo

    def smooth(x: np.ndarray) -> float:
        p = parts(x)[2]
        return float(-np.log(p).mean()) if (p > 0).all() else np.inf

    def gradient(x: np.ndarray) -> np.ndarray:
        lo, hi, p = parts(x)
        dlo, dhi = lo * (1 - lo), hi * (1 - hi)
        g = (dhi - dlo) / p / n  # d(-log p)/dz
        gt = [((grades == j + 1) * dlo / p - (grades == j) * dhi / p).sum() / n for j in range(levels - 1)]
        return np.concatenate((np.bincount(at, g[doc], minlength=m) * scale, gt))

    penalty = lambda x: float(l1 * (np.abs(x[:m]) * scale).sum())
    best = np.concatenate((np.zeros(m), ordered(theta)))
    ahead, t, step, value = best, 1.0, 4.0, smooth(best)
    for _ in range(turns):
        here = smooth(ahead)
        if not np.isfinite(here):  # momentum has left the domain
            ahead, t, here = best, 1.0, smooth(best)
        g, free = gradient(ahead), ahead is best
        while True:
            x = ahead - step * g
            x[:m] = np.sign(x[:m]) * np.maximum(np.abs(x[:m]) - step * l1 * scale, 0)
            x[m:] = ordered(x[m:])
            d = x - ahead
            if smooth(x) <= here + g @ d + d @ d / (2 * step) + 1e-13 or step < 1e-12:
                break
            step /= 2
        now = smooth(x) + penalty(x)
        if now > value:
            if free:
                break
            ahead, t = best, 1.0
            continue
        if free and value - now < tolerance:
            best = x
            break
        next_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, best, value, t, step = x + (t - 1) / next_t * (x - best), x, now, next_t, step * 1.25
    w, theta = best[:m], best[m:]
    used = w != 0
    return Model(bits, buckets[used], (w * scale)[used], theta)


def grade(labels: DataFrame) -> Column:
    """0 toxic, 1 poor, 2 good; null where the rating is null."""
    return F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when(F.col("quality") > 0, 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, bits: int = 20, levels: int = 3) -> Model:
    """Fits on at most `sample` rated documents. Rows with null id, text or rating take no part; of repeated ratings
    of a document the lowest counts."""
    rated = labels.select("doc_id", grade(labels).alias("grade")).where("doc_id is not null and grade is not null")
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(x, bits) for x in texts(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("grade"), pa.array([x.astype("<i4").tobytes() for x in rows], pa.binary())],
                names=["doc_id", "grade", "x"],
            )

    some = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(rated), "doc_id")
    # of several texts of an id the one of least features, so that the fit does not depend on the order of rows
    some = some.mapInArrow(run, "doc_id long, grade int, x binary").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("x").alias("x"))
    got = some.toArrow().sort_by("doc_id")
    rows = [np.frombuffer(x, "<i4").astype(np.int64) for x in got.column("x").to_pylist()]
    return fit(rows, np.array(got.column("grade").to_pylist(), np.int64), levels, bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, p_tail): p_tail is the probability of the best grade. Null and empty texts have no tokens
    and get what the thresholds alone say; a text of any length is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in pieces(whole, "_t", 2_000_000):
                tails = m.tails([features(x, m.bits) for x in texts(b, "_t")])
                yield pa.RecordBatch.from_arrays(
                    [b.column("_i"), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=[id_col, "expected_grade", "p_tail"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).mapInArrow(
        run, f"`{id_col}` {kind}, expected_grade double, p_tail double"
    )


def select(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose p_tail is at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in pieces(whole, "text", 2_000_000):
                tails = m.tails([features(x, m.bits) for x in texts(b, "text")])
                yield b.filter(pa.array(tails[:, -1] >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, **fitting) -> DataFrame:
    """(doc_id, expected_grade, p_tail, keep) for every document; empty tables give an empty table."""
    return score(docs, train(docs, labels, **fitting)).withColumn("keep", F.col("p_tail") >= least)
