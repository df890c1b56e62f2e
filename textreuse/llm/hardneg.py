"""Hard negatives by threshold joins over an inverted index whose postings are cut by norms.

Rows are dealt by a hash of their id to shards of about `SHARD` rows; anchors come in blocks of `BLOCK`, and a block
meets every shard of vectors of its length by an equi-join on the shard. In a shard the dimensions are taken in order of
falling energy, in slabs. For a threshold t the index of a row holds its leading slabs only: the rest of them is omitted
as soon as the norm of what follows, times the longest anchor, stays below t. Partial scores are accumulated slab by
slab; a pair is dropped when its partial score and the product of both remaining norms stay below the anchor's
threshold, and those that are left are completed. Thresholds start high and fall until the anchor's windows are full
or its floor is reached.

Every pass runs over a sixteenth of the shards first. What fills a window there bounds what can enter it elsewhere, so
the other shards start from that floor and return a few rows per window, whatever their number. No result depends on
the floors: all rows take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, tidy

SHARD, BLOCK, SLAB, PILOT = 4096, 1024, 8, 16
#: Squared norms from here on take no part: 100 times a score must fit a long.
LONGEST = 2**56
ROW = "array<struct<id: bigint, label: bigint, x: array<bigint>>>"


def quantised(vectors: DataFrame, vector: str = "embedding", factor: int = 256) -> Column:
    """floor(factor * x) of each component as array<bigint>; null where a component is null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda v: F.floor(v.cast("double") * factor).cast("long")))


def tails(x: np.ndarray) -> np.ndarray:
    """Norms of what follows the first 0, 1, .. slabs; the last column is 0."""
    squares = np.add.reduceat(x.astype(float) ** 2, np.arange(0, max(x.shape[1], 1), SLAB), axis=1) if x.shape[1] else np.zeros((len(x), 0))
    after = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([after, np.zeros((len(x), 1))], axis=1)) * (1 + 1e-9)


class Index:
    """Rows of a shard. `postings` counts the components that searches have looked at, of rows times dimensions a search."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels = ids, labels
        self.dims = np.argsort(-(x.astype(float) ** 2).sum(axis=0), kind="stable")
        self.x = x[:, self.dims]
        self.tails = tails(self.x)
        self.slabs = self.tails.shape[1] - 1
        self.longest = float(self.tails[:, 0].max(initial=0))
        self.postings = 0

    def search(self, a: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs that score at least the anchor's threshold. a: anchors, dimensions in order."""
        mine = tails(a)
        # exact in doubles below 2**53, which BLAS multiplies faster than integers
        kind = float if mine[:, 0].max(initial=0) * self.longest < 2**53 else np.int64
        t, longest = least.min(initial=np.inf), mine.max(axis=0, initial=0)
        depth = (self.tails[:, :-1] * longest[:-1] >= t).cumprod(axis=1).sum(axis=1)  # slabs that are indexed
        if self.slabs == 0 or not np.isfinite(t):
            depth[:] = self.slabs
        order = np.argsort(-depth, kind="stable")
        depth, b, end = depth[order], self.x[order].astype(kind), self.tails[order]
        a = a.astype(kind)
        score = np.zeros((len(a), len(b)), kind)
        some, stop = np.arange(0, len(a), max(1, len(a) // 32)), self.slabs
        for k in range(self.slabs):
            n, at = int(np.searchsorted(-depth, -k, "left")), slice(k * SLAB, (k + 1) * SLAB)  # rows with depth > k
            score[:, :n] += a[:, at] @ b[:n, at].T
            self.postings += n * (b[:1, at].shape[1])
            if 2 * (k + 1) >= self.slabs:
                alive = score[some, :n] + mine[some, k + 1, None] * end[None, :n, k + 1] >= least[some, None]
                if alive.mean() < 0.05 if n else True:
                    stop = k + 1
                    break
        reach = np.minimum(depth, stop)
        rest = end[np.arange(len(b)), reach]
        i, j = np.nonzero(score + mine[:, reach] * rest[None, :] >= least[:, None])
        found = score[i, j]
        for k in np.unique(reach):
            if k < self.slabs:
                of, at = np.flatnonzero(reach[j] == k), slice(int(k) * SLAB, None)
                for s in range(0, len(of), 1 << 16):
                    part = of[s : s + (1 << 16)]
                    found[part] += (a[i[part], at] * b[j[part], at]).sum(axis=1)
        found = found.astype(np.int64)
        good = found >= least[i]
        return i[good], order[j[good]], found[good]


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    high: np.ndarray  # anchors x windows: the highest score that a window takes; a window without scores has high < low
    low: np.ndarray


def fill(index: Index, anchors: Anchors, same: bool, want: int, turns: int = 4) -> tuple[np.ndarray, ...]:
    """(anchor, window, row, score): of each window the best `want` rows, higher scores first, then smaller ids.

    same: rows of the anchor's label, or those of others. An anchor's threshold falls from its highest bound in `turns`
    steps to its floor, the lowest score that a window takes; an anchor whose windows are all full is done.
    """
    x = anchors.x[:, index.dims]
    open_ = anchors.high >= anchors.low
    # a double beside the integer, so that rounding drops nothing
    floor = np.nextafter(np.where(open_, anchors.low, np.inf).min(axis=1, initial=np.inf), -np.inf)
    top = np.minimum(np.nextafter(np.where(open_, anchors.high, -np.inf).max(axis=1, initial=-np.inf), np.inf), np.ceil(tails(x)[:, 0] * index.longest))
    active, out = np.flatnonzero(floor <= top), []
    for turn in range(1, turns + 1):
        if not len(active):
            break
        deep = np.maximum(floor[active], -top[active])  # no score is below that bound
        deep = np.minimum(deep, top[active])
        least = np.where(turn == turns, floor[active], np.ceil(top[active] - (top[active] - deep) * turn / turns * 0.75))
        i, j, s = index.search(x[active], least)
        i = active[i]
        fit = ((index.labels[j] == anchors.labels[i]) == same) & (index.ids[j] != anchors.ids[i])
        i, j, s = i[fit], j[fit], s[fit]
        order = np.lexsort((index.ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        full = np.ones(len(anchors.ids), bool)
        kept = []
        for w in range(anchors.high.shape[1]):
            at = np.flatnonzero((s <= anchors.high[i, w]) & (s >= anchors.low[i, w]))
            first = np.searchsorted(i[at], i[at], "left")
            at = at[np.arange(len(at)) - first < want]
            kept.append((i[at], np.full(len(at), w), j[at], s[at]))
            full &= ~open_[:, w] | (np.bincount(i[at], minlength=len(full)) >= want)
        done = np.zeros(len(full), bool)
        done[active] = full[active] | (least <= floor[active])
        out += [[c[done[k[0]]] for c in k] for k in kept]
        active = active[~done[active]]
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(4))


def unpack(x: pa.Scalar, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = x.values
    flat = rows.field("x").flatten().to_numpy(zero_copy_only=False)
    return rows.field("id").to_numpy(), rows.field("label").to_numpy(), flat.reshape(len(rows), size)


def packed(rows: DataFrame, by: Column, *more: str) -> DataFrame:
    """(size, part, rows): vectors of one length in lists."""
    rows = rows.select(F.size("x").alias("size"), by.alias("part"), F.struct("id", "label", "x").alias("row"), *more)
    return rows.groupBy("size", "part").agg(F.collect_list(F.struct("row", *more)).alias("both")).select("size", "part", F.expr("transform(both, r -> r.row)").alias("rows"), *(F.expr(f"transform(both, r -> r.{m})").alias(m) for m in more))


def searched(shards: DataFrame, anchors: DataFrame, n: int, pilot: bool, run: Callable, schema: str) -> DataFrame:
    """Each block of anchors with each shard (of the pilot, or of the rest). Packed vectors are many times as large as their
    files, and the copies of anchors grow with the square of the rows, so neither side may be sent to the driver."""
    chosen = (F.col("shard") % PILOT == 0) if pilot else (F.col("shard") % PILOT != 0)
    blocks = anchors.withColumnRenamed("rows", "anchors").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(chosen)
    mine = shards.select("size", F.col("part").alias("shard"), "rows").where(chosen)
    return blocks.join(mine.hint("merge"), ["size", "shard"]).mapInArrow(run, schema)


def indexed(rows: pa.ListScalar, size: int, shard: int, last: dict) -> Index:
    """The index of a shard, kept while the shard stays the same."""
    if (size, shard) not in last:
        last.clear()
        last[size, shard] = Index(*unpack(rows, size))
    return last[size, shard]


def searching(same: bool, want: int, low: int, high: int) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        for b in batches:
            for r in range(b.num_rows):
                size = b.column("size")[r].as_py()
                index = indexed(b.column("rows")[r], size, b.column("shard")[r].as_py(), last)
                ids, labels, x = unpack(b.column("anchors")[r], size)
                floors = b.column("floors")[r].as_py()
                if same:
                    ps = [[None]] * len(ids)
                    tops = np.full((len(ids), 1), LONGEST)
                    lows = np.array([[-LONGEST if f is None else f] for f in floors], np.int64).reshape(-1, 1)
                else:
                    ps = [[p["id"] for p in f] for f in floors]
                    width = max(map(len, ps), default=0)
                    tops, lows = np.full((len(ids), width), -1), np.zeros((len(ids), width), np.int64)
                    for k, f in enumerate(floors):
                        for w, p in enumerate(f):
                            tops[k, w] = high * p["score"] // 100
                            lows[k, w] = max(-(-low * p["score"] // 100), -LONGEST if p["floor"] is None else p["floor"])
                i, w, j, s = fill(index, Anchors(ids, labels, x, tops, lows), same, want)
                p = pa.array([ps[a][b] for a, b in zip(i.tolist(), w.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), p, pa.array(index.ids[j]), pa.array(s.astype(np.int64))], names=["anchor_id", "positive_id", "vec_id", "score"])

    return run


def best(found: DataFrame, keys: list[str], want: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: id, label, x array<bigint>; anchor: a condition on rows. An anchor's positives are the `positives` other rows
    of its label with the highest inner product; for each of them the `negatives` best rows of another label whose score
    is from low to high percent of the positive's come back, equal scores by smaller id. A positive without such rows
    has none, so one of negative score has none.

    Rows with a null id, label, vector or component take no part, nor do those with a squared norm of 2^56 or more. Only
    vectors of one length meet, those without components among themselves with score 0. Of rows that share an id the one
    of least label, then least vector stays. Further columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(rows.sparkSession, "hardneg")
    good = "id is not null and label is not null and x is not null and not exists(x, v -> v is null)"
    norm = f"aggregate(x, 0D, (s, v) -> s + cast(v as double) * v) < {LONGEST}D"
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<bigint>").alias("x"), anchor.alias("anchor")).where(good).where(norm)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("id", "r.label", "r.x", "r.anchor")
    rows = scratch.put(rows, "rows")
    n = max(1, -(-rows.count() // SHARD))
    shards = scratch.put(packed(rows, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), "shards")
    anchors = rows.where("anchor").select("id", "label", "x")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, -(-anchors.count() // BLOCK)))).cast("int")
    schema = "anchor_id long, positive_id long, vec_id long, score long"

    # positives: the pilot's last one of a full window is a floor for the rest
    run, keys = searching(True, positives, low, high), ["anchor_id"]
    first = anchors.withColumn("floors", F.lit(None).cast("long"))
    near = scratch.put(best(searched(shards, packed(first, block, "floors"), n, True, run, schema), keys, positives), "positives-pilot")
    floors = near.groupBy(F.col("anchor_id").alias("id")).agg(F.when(F.count("*") >= positives, F.min("score")).alias("floors"))
    rest = searched(shards, packed(anchors.join(floors, "id", "left"), block, "floors"), n, False, run, schema)
    near = scratch.put(best(near.drop("rank").unionByName(rest), keys, positives), "positives")
    near = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    # negatives: likewise per positive
    run, keys = searching(False, negatives, low, high), ["anchor_id", "positive_id"]

    def windows(given: DataFrame) -> DataFrame:
        p = given.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"), "floor")).alias("floors"))
        return packed(anchors.join(p, "id"), block, "floors")

    hard = scratch.put(best(searched(shards, windows(near.withColumn("floor", F.lit(None).cast("long"))), n, True, run, schema), keys, negatives), "negatives-pilot")
    floors = hard.groupBy(*keys).agg(F.when(F.count("*") >= negatives, F.min("score")).alias("floor"))
    rest = searched(shards, windows(near.join(floors, keys, "left")), n, False, run, schema)
    hard = best(hard.drop("rank").unionByName(rest), keys, negatives).join(near, keys)
    hard = hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    hard = scratch.put(hard, "found")
    scratch.only("found")
    return hard
