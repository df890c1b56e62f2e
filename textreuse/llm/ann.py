"""Nearest neighbours by largest inner product: inverted file with product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a bounded sample (`sample` rows of least id hash). Every vector
is indexed under its nearest centroid with the codes of its residual and the length of what the codes leave, in shards of
about `block` rows: several small lists, or a part of a large one. The sample's k-th best score is a floor of a query's
k-th best of all. A query visits the shards with a list whose centre and radius allow that floor; there the products with
decoded rows, and the lengths of what they leave, bound every score, and rows that can reach the floor are scored exactly,
in double precision, on the original vectors. So nothing is lost, whatever the rows are like; how much is left out depends
on them. With `probes` or `rerank` given, a query takes that many lists and that share of a shard instead. The best of
all shards are merged by a window that keeps k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, tidy

K = 20


@dataclass(frozen=True)
class Codebooks:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # parts x codes x dim / parts

    @property
    def parts(self) -> int:
        return len(self.books)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (x - self.centroids[lists]).reshape(len(x), self.parts, -1)
        out = np.empty((len(x), self.parts), np.uint8)
        for p, book in enumerate(self.books):
            out[:, p] = nearest(rest[:, p], book)
        return out

    def decoded(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return self.centroids[lists] + rest


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 8192] @ centres.T - norms).argmax(axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, turns: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from a seeded choice of distinct rows; empty clusters keep their centre."""
    x = np.asarray(x, np.float32)
    rows = np.unique(x, axis=0)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(turns):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, at, x)
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    return centres


def fit(x: np.ndarray, lists: int, parts: int, codes: int = 256) -> Codebooks:
    dim = x.shape[1]
    parts = next(p for p in range(min(parts, dim), 0, -1) if dim % p == 0)
    centroids = kmeans(x, lists)
    rest = (x - centroids[nearest(x, centroids)]).reshape(len(x), parts, -1)
    books = [kmeans(rest[:, p], codes) for p in range(parts)]
    n = min(map(len, books))
    return Codebooks(centroids, np.stack([b[:n] for b in books]))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is neither null nor zero nor holds null or non-finite components."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )


def matrix(column: pa.Array, dim: int, kind=np.float32) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dim)


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths in double precision, rounded up."""
    x = np.asarray(x, np.float64)
    return np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9)


def index(vectors: DataFrame, model: Codebooks) -> DataFrame:
    """(list, row, id, v, codes, far, left): every vector as it is, under its nearest centroid, with the codes of its
    residual, its distance from the centroid and from what its codes stand for."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    dim = model.centroids.shape[1]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = matrix(b.column("v"), dim, np.float64)
            lists = nearest(x.astype(np.float32), m.centroids)
            codes = m.codes(x.astype(np.float32), lists)
            far, left = lengths(x - m.centroids[lists]), lengths(x - m.decoded(codes, lists))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists.astype(np.int32)), b.column("row"), b.column("id"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(left)],
                names=["list", "row", "id", "v", "codes", "far", "left"],
            )

    return vectors.mapInArrow(run, f"list int, row long, id long, v {vectors.schema['v'].dataType.simpleString()}, codes binary, far double, left double")


def shards(sizes: dict[int, int], lists: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each list and the number of its shards: a list of more than `block` rows has several to itself,
    smaller ones share one as long as they fit."""
    first, parts, at, room = np.zeros(lists, np.int64), np.ones(lists, np.int64), -1, 0
    for c, n in sorted(sizes.items(), key=lambda t: (t[1] <= block, t[0])):
        if n > block:
            first[c], parts[c] = at + 1, -(-n // block)
            at += int(parts[c])
            continue
        if n > room:
            at, room = at + 1, block
        first[c], room = at, room - n
    return first, parts


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, every: int = 20, k: int = K, lists: int = 64, probes: int | None = None, parts: int = 16, rerank: float | None = None, sample: int = 20_000, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by `every`, among all other rows.

    Ties go to the smaller id. Rows whose vector is null, zero, or holds null or non-finite components take no part; nor
    do null ids. Vectors of different lengths have no inner product; those of each length are searched among themselves.
    Rows that share an id are candidates each, and each a query if the id is one. Without usable vectors the result is
    empty; with fewer than k candidates found, all of them are returned.
    """
    spark, rows = vectors.sparkSession, usable(vectors, id_col, vector_col)
    found = spark.createDataFrame([], RESULT)
    dims = [r["dim"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*")).orderBy("dim").collect()]  # mostly one
    for dim in dims:
        mine = rows.where(F.size("v") == dim) if len(dims) > 1 else rows
        found = found.unionByName(_search(mine, dim, every, k, lists, probes, parts, rerank, sample, block))
    return found


def _search(rows: DataFrame, dim: int, every: int, k: int, lists: int, probes: int | None, parts: int, rerank: float | None, sample: int, block: int) -> DataFrame:
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "ann")
    some = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).toArrow()
    some = matrix(some.column("v").combine_chunks(), dim)
    model = fit(some, lists, parts)
    lists = len(model.centroids)
    shared, seen = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(some)
    # the number of a row is fixed once the index is written
    held = scratch.put(index(rows.withColumn("row", F.monotonically_increasing_id()), model), "index")
    stats = held.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row per list
    first, parts_of = shards({r["list"]: r["n"] for r in stats}, lists, block)
    radius = np.full(lists, -np.inf)
    for r in stats:
        radius[r["list"]] = r["far"]
    at = lambda numbers: F.get(F.lit(numbers.tolist()), F.col("list"))
    held = held.withColumn("shard", (at(first) + F.pmod(F.xxhash64("row"), at(parts_of))).cast("int"))
    asks = held.where(F.col("id") % every == 0)
    shares = max(1, -(-asks.count() // block))
    rounding = (dim + 8) * 2.0**-23  # of a product in single precision, as a share of both lengths

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, seen.value
        filled, longest = np.flatnonzero(radius >= 0), lengths(known).max()
        of = np.zeros((lists, int((first + parts_of).max())), bool)
        for c in filled:
            of[c, first[c] : first[c] + parts_of[c]] = True
        for b in batches:
            x = matrix(b.column("v"), dim, np.float64)
            size = lengths(x)
            near = x @ m.centroids.T.astype(np.float64)
            if probes is None:
                floor = np.full(len(x), -np.inf)
                for i in range(0, len(x) if len(known) > k else 0, 256):  # the query itself may be among them
                    found = x[i : i + 256].astype(np.float32) @ known.T
                    floor[i : i + 256] = np.partition(found, len(known) - k - 1, axis=1)[:, len(known) - k - 1]
                floor -= rounding * size * longest
                near += size[:, None] * radius * (1 + 1e-9)
                goes = ~(near < (floor - 1e-9 * size * lengths(m.centroids).max())[:, None])
                goes[:, radius < 0] = False
            else:
                floor, goes = np.full(len(x), -np.inf), np.zeros(near.shape, bool)
                np.put_along_axis(goes, filled[np.argsort(-near[:, filled], axis=1, kind="stable")[:, :probes]], True, axis=1)
            who, where = np.nonzero(goes @ of)
            taken = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), *(b.column(c).take(taken) for c in ("row", "id", "v")), pa.array(floor[who])], names=["shard", "row", "id", "v", "floor"])

    share = F.pmod(F.xxhash64("row", F.lit("q")), F.lit(shares)).cast("int")
    visits = asks.select("row", "id", "v").mapInArrow(visit, f"shard int, row long, id long, v {rows.schema['v'].dataType.simpleString()}, floor double").withColumn("share", share)
    copies = held.drop("far").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        kind = {"query": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kind.items()})
        left = left.sort_by([("id", "ascending"), ("row", "ascending")])
        ids, own = left.column("id").to_numpy(), left.column("row").to_numpy()
        exact = matrix(left.column("v").combine_chunks(), dim, np.float64)
        codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        hat = m.decoded(codes, left.column("list").to_numpy())
        asked, rows_asked, floors = (right.column(c).to_numpy() for c in ("id", "row", "floor"))
        queries = matrix(right.column("v").combine_chunks(), dim, np.float64)
        sizes = lengths(queries)
        spare = (left.column("left").to_numpy() + rounding * lengths(hat)).astype(np.float32) * np.float32(1 + 1e-6)
        longest = lengths(exact).max()
        most = None if rerank is None else min(len(ids), max(k + 1, 16, int(np.ceil(len(ids) * rerank))))  # the query itself may be among them
        out = []
        for at in range(0, len(asked), 256):
            ys = queries[at : at + 256]
            guess = ys.astype(np.float32) @ hat.T
            if most is None:
                guess += sizes[at : at + 256, None].astype(np.float32) * np.float32(1 + 1e-6) * spare
                live = ~(guess < floors[at : at + 256, None] - rounding * sizes[at : at + 256, None] * longest)
                some = np.flatnonzero(live.any(axis=0))
                if not len(some):
                    continue
                scores = ys @ (exact if len(some) == len(ids) else exact[some]).T
                n = min(len(some), k + 1)
                # a product's last bits depend on its place in the matrix, so the best are taken with those next to them
                edges = np.partition(scores, len(some) - n, axis=1)[:, len(some) - n] - dim * 2.0**-50 * sizes[at : at + 256] * longest
                chosen = (some[np.flatnonzero(s >= edge)] for s, edge in zip(scores, edges, strict=True))
            else:
                edges = -np.partition(-guess, most - 1, axis=1)[:, most - 1]
                # ties at the edge go to the smaller ids
                chosen = (np.concatenate((np.flatnonzero(g > edge), np.flatnonzero(g == edge)))[:most] for g, edge in zip(guess, edges, strict=True))
            for i, best in enumerate(chosen, at):
                best = best[own[best] != rows_asked[i]]
                s = (exact[best] * queries[i]).sum(axis=1)  # the same for equal vectors, wherever they stand
                top = np.lexsort((own[best], ids[best], -s))[:k]
                out.append((np.full(len(top), rows_asked[i]), np.full(len(top), asked[i]), ids[best][top], s[top]))
        if not out:
            return pa.table({c: pa.array([], t) for c, t in kind.items()})
        return pa.table(dict(zip(kind, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    key = ["shard", "share"]
    found = copies.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(score, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
