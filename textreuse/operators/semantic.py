"""Cosine candidates, vector search, and the embedder plug point."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textreuse.functions.columns import cosine, l2_normalize, norm
from textreuse.operators.chunks import sliced
from textreuse.operators.lineage import checkpointed


def embedding_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds dimension and norm."""
    return vectors.withColumns({"dimension": F.size(vector), "norm": norm(F.col(vector))})


def blocks(vectors: DataFrame, on: list[str], key: str, vector: str, rows: int) -> DataFrame:
    """(on, _size, _block, x): vectors of one length in lists of about `rows` (k, v), each divided by its length once."""
    keys = [*on, "_size"]
    unit = l2_normalize(F.col(vector).cast("array<double>"))
    vectors = vectors.select(*on, F.col(key).alias("_k"), unit.alias("_v")).withColumn("_size", F.size("_v")).where("_v is not null and _size > 0")
    n = vectors.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("_blocks"))
    placed = vectors.join(n, keys).withColumn("_block", F.pmod(F.xxhash64("_k"), F.col("_blocks")))
    return placed.groupBy(*keys, "_block").agg(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_v").alias("v"))).alias("x"))


def unpacked(x: pa.ListScalar, size: int) -> tuple[pa.Array, np.ndarray]:
    """Keys and vectors of a block."""
    return x.values.field("k"), x.values.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def semantic_candidates(left: DataFrame, right: DataFrame, on: list[str], top_k: int = 50, threshold: float = 0.65, digits: int | None = None, itself: bool = True, block: int = 1024) -> DataFrame:
    """(on, left_chunk, right_chunk, semantic_score): the top_k right chunks of each left chunk, then the threshold.

    left: on, left_chunk, left_vec; right: on, right_chunk, right_vec. Ties go to the greater right chunk; without `itself`
    equal chunks don't meet. Vectors that are null, of another length, or hold null or non-finite numbers have no
    candidates. A block of left vectors meets a block of right ones by one matrix product and keeps top_k per left chunk;
    a window merges them.
    """
    sides = [blocks(d, on, f"{s}_chunk", f"{s}_vec", block).select(*on, "_size", F.col("x").alias(s)) for d, s in ((left, "left"), (right, "right"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                size = b.column("_size")[i].as_py()
                (lk, lv), (rk, rv) = (unpacked(b.column(s)[i], size) for s in ("left", "right"))
                names = rk.to_pylist()
                order = sorted(range(len(names)), key=lambda j: (names[j] is not None, names[j]), reverse=True)
                s = lv @ rv[order].T
                s = s if digits is None else np.round(s, digits)
                fine = np.isfinite(s) & (s >= threshold)
                if not itself:
                    fine &= np.array(lk.to_pylist(), object)[:, None] != np.array(names, object)[order]
                s = np.where(fine, s, -np.inf)
                best = np.argsort(-s, axis=1, kind="stable")[:, :top_k]
                score = np.take_along_axis(s, best, 1)
                at, _ = np.nonzero(np.isfinite(score))
                to = np.array(order, np.int64)[best[np.isfinite(score)]]
                shared = [b.column(c).take(pa.array(np.full(len(at), i))) for c in on]
                yield pa.RecordBatch.from_arrays([*shared, lk.take(pa.array(at)), rk.take(pa.array(to)), pa.array(score[np.isfinite(score)])], names=[*on, "left_chunk", "right_chunk", "semantic_score"])

    ddl = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for d, c in [*((left, c) for c in on), (left, "left_chunk"), (right, "right_chunk")])
    found = sides[0].join(sides[1], [*on, "_size"]).mapInArrow(run, f"{ddl}, semantic_score double")
    order = Window.partitionBy(*on, "left_chunk").orderBy(F.desc("semantic_score"), F.desc("right_chunk"))
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_k).drop("_rank")


def spread(sample: np.ndarray, cells: int, turns: int = 8) -> np.ndarray:
    """Unit centres of at most `cells` cells of a sample of unit vectors: rounds of means from evenly chosen distinct rows."""
    rows = np.unique(sample, axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)] if len(rows) else rows
    for _ in range(turns):
        at = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        n = np.linalg.norm(sums, axis=1)
        centres = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1)[:, None], centres)
    return centres


def celled(vectors: DataFrame, key: str, vector: str = "embedding", cells: int | None = None, block: int = 1024, sample: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(key, _v, _size, _cell, _angle): unit vectors, the coarse cell of each, and its angle to the cell's centre; the centres.

    Centres are fitted on the `sample` vectors of least key hash; their number follows the table, a cell for about four
    blocks of vectors and at most 256. Vectors of another length than the first one of the sample are cell -1, where
    nothing is known of them; null vectors and those with null components are left out.
    """
    unit = l2_normalize(F.col(vector).cast("array<double>"))
    vectors = vectors.select(key, unit.alias("_v")).where("_v is not null and size(_v) > 0 and not exists(_v, x -> x is null or isnan(x))").withColumn("_size", F.size("_v"))
    some = vectors.orderBy(F.xxhash64(key), key).limit(sample).select("_v").toArrow().column("_v").to_pylist()
    size = len(some[0]) if some else 0
    fit = np.array([x for x in some if len(x) == size], float).reshape(-1, size)
    n = cells if cells is not None else min(256, max(1, vectors.count() // (4 * block)))
    centres = spread(fit, n)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("_size").to_numpy()
            cell, angle = np.full(len(sizes), -1, np.int32), np.full(len(sizes), np.pi)
            fits = np.flatnonzero(sizes == size)
            if len(fits) and len(shared.value):
                x = b.column("_v").take(pa.array(fits)).flatten().to_numpy().reshape(-1, size)
                s = x @ shared.value.T
                cell[fits] = s.argmax(axis=1)
                angle[fits] = np.where(np.linalg.norm(x, axis=1) > 0, np.arccos(np.clip(s.max(axis=1), -1, 1)), np.pi)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, "_cell", "_angle"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.mapInArrow(run, f"`{key}` {kind}, _v array<double>, _size int, _cell int, _angle double"), centres


def near_places(placed: DataFrame, vectors: DataFrame, top_k: int, threshold: float, within: str = "source", key: str = "text_hash", cells: int | None = None, block: int = 1024) -> DataFrame:
    """(within, left, right, right_document_id, right_chunk, semantic_score): for each distinct text and each document after
    the first one that has the text, the top_k of that document's chunks by cosine (rounded to 9 digits, equal ones: the
    later chunk first) that reach the threshold. What is ranked does not depend on any later score.

    placed: within, doc_id, chunk_index, key; vectors: key, embedding. Texts and chunks lie in blocks by coarse cells of
    their vectors. Two blocks meet, by one matrix product, where some angle between them can reach the threshold; the
    others are left out without loss. Each product keeps top_k per text and document, and a window merges the blocks: so
    what is written grows with k and the chunks, not with the pairs above the threshold.
    """
    unit, centres = celled(vectors, key, cells=cells, block=block)
    unit = checkpointed(unit)
    chunks = placed.select(within, "doc_id", "chunk_index", key).join(unit, key)
    texts = placed.groupBy(within, key).agg(F.min("doc_id").alias("first")).join(unit, key)

    def packed(rows: DataFrame, names: list[str], side: str) -> DataFrame:
        """Blocks of rows of one cell; a text or chunk is dealt by the hash of its key."""
        on = [within, "_size", "_cell"]
        n = rows.groupBy(*on).agg(F.ceil(F.count("*") / block).alias("_n"))
        rows = rows.join(n, on).withColumn("_block", F.pmod(F.xxhash64(*names), F.col("_n")).cast("int"))
        both = F.collect_list(F.struct(*names, F.col("_v").alias("v"))).alias(side)
        return checkpointed(rows.groupBy(*on, "_block").agg(both, F.max("_angle").alias("_reach")))

    left, right = packed(texts, [key, "first"], "left"), packed(chunks, ["doc_id", "chunk_index", key], "right")
    meta = lambda d, s: d.select(within, "_size", *(F.col(c).alias(f"{s}{c}") for c in ("_cell", "_block", "_reach")))
    turns = np.arccos(np.clip(centres @ centres.T, -1, 1)) if len(centres) else np.zeros((0, 0))
    spark = placed.sparkSession
    # at most 256 x 256 rows
    apart = spark.createDataFrame([(int(i), int(j), float(turns[i, j])) for i in range(len(turns)) for j in range(len(turns))], "l_cell int, r_cell int, apart double")
    meet = meta(left, "l").join(meta(right, "r"), [within, "_size"]).join(F.broadcast(apart), ["l_cell", "r_cell"], "left")
    limit = float(np.arccos(np.clip(threshold - 1e-9, -1, 1))) + 1e-6
    meet = meet.where(F.col("apart").isNull() | (F.col("apart") - F.col("l_reach") - F.col("r_reach") <= limit)).drop("apart", "l_reach", "r_reach")
    for d, s in ((left, "l"), (right, "r")):
        meet = meet.join(d.drop("_reach").withColumnsRenamed({"_cell": f"{s}_cell", "_block": f"{s}_block"}), [within, "_size", f"{s}_cell", f"{s}_block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                size = b.column("_size")[i].as_py()
                mine, other = b.column("left")[i].values, b.column("right")[i].values
                docs, places = (np.array(other.field(c).to_pylist()) for c in ("doc_id", "chunk_index"))
                order = np.lexsort((-places, docs))  # a document's chunks together, later ones first
                x, y = (r.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for r in (mine, other))
                s = np.round(x @ y[order].T, 9)
                docs = docs[order]
                good = (s >= threshold) & (np.array(mine.field("first").to_pylist())[:, None] < docs[None, :])
                starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
                for a, z in zip(starts, [*starts[1:], len(docs)], strict=True):
                    if z - a > top_k:
                        rank = np.argsort(np.argsort(-s[:, a:z], axis=1, kind="stable"), axis=1, kind="stable")
                        good[:, a:z] &= rank < top_k
                at, to = np.nonzero(good)
                shared = b.column(within).take(pa.array(np.full(len(at), i)))
                to_rows = pa.array(order[to])
                columns = [shared, mine.field(key).take(pa.array(at)), *(other.field(c).take(to_rows) for c in (key, "doc_id", "chunk_index")), pa.array(s[at, to])]
                yield pa.RecordBatch.from_arrays(columns, names=[within, "left", "right", "right_document_id", "right_chunk", "semantic_score"])

    kind = {c: placed.schema[c].dataType.simpleString() for c in (within, key, "doc_id", "chunk_index")}
    found = meet.mapInArrow(run, f"`{within}` {kind[within]}, left {kind[key]}, right {kind[key]}, right_document_id {kind['doc_id']}, right_chunk {kind['chunk_index']}, semantic_score double")
    order = Window.partitionBy(within, "left", "right_document_id").orderBy(F.desc("semantic_score"), F.desc("right_chunk"))
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_k).drop("_rank")


def ranked_places(placed: DataFrame, vectors: DataFrame, near: DataFrame, top_k: int, threshold: float, within: str = "source", key: str = "text_hash") -> DataFrame:
    """The rows of near_places whose texts are a pair (within, left, right) of `near`, which has both ways round and texts with
    themselves: the same ranks, among all chunks of the right document.

    Vectors meet inside a document only: those of its chunks, and those of the texts that have a near one there. What is
    written grows with the chunks and with the places of near texts.
    """
    first = placed.groupBy(within, key).agg(F.min("doc_id").alias("_first"))
    own = placed.select(within, "doc_id", "chunk_index", key).join(first, [within, key]).withColumn("_asked", F.col("_first") < F.col("doc_id")).drop("_first")
    far = near.where("left <> right").join(own.select(within, "doc_id", F.col(key).alias("right")).distinct(), [within, "right"])
    far = far.join(first.withColumnRenamed(key, "left"), [within, "left"]).where("_first < doc_id").select(within, "doc_id", F.col("left").alias(key)).distinct()
    far = checkpointed(far.join(own.select(within, "doc_id", key).distinct(), [within, "doc_id", key], "left_anti"))
    asked = own.where("_asked").select(within, "doc_id").unionByName(far.select(within, "doc_id")).distinct()
    rows = own.join(asked, [within, "doc_id"], "left_semi").unionByName(far.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    fine = vectors.where("size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x))").select(key, F.col("embedding").alias("v"))
    held = rows.join(fine, key).groupBy(within, "doc_id").agg(F.collect_list(F.struct("chunk_index", F.col(key).alias("k"), "_asked", "v")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.column("x")[i].values
                place, wanted = x.field("chunk_index").to_pylist(), x.field("_asked").to_pylist()
                names, sizes = x.field("k").to_pylist(), pa.compute.list_value_length(x.field("v")).to_numpy()
                for size in np.unique(sizes):
                    mine = np.flatnonzero(sizes == size)
                    v = x.field("v").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny)
                    left = list({names[j]: n for n, j in enumerate(mine) if wanted[j]}.values())
                    right = sorted((n for n, j in enumerate(mine) if place[j] is not None), key=lambda n: -place[mine[n]])  # later ones first
                    s = np.round(v[left] @ v[right].T, 9)
                    best = np.argsort(-s, axis=1, kind="stable")[:, :top_k]
                    score = np.take_along_axis(s, best, 1)
                    at, to = np.nonzero(score >= threshold)
                    a, z = pa.array(mine[np.array(left, int)[at]]), pa.array(mine[np.array(right, int)[best[at, to]]])
                    shared = [b.column(c).take(pa.array(np.full(len(at), i))) for c in (within, "doc_id")]
                    columns = [shared[0], x.field("k").take(a), x.field("k").take(z), shared[1], x.field("chunk_index").take(z), pa.array(score[at, to])]
                    yield pa.RecordBatch.from_arrays(columns, names=[within, "left", "right", "right_document_id", "right_chunk", "semantic_score"])

    kind = {c: placed.schema[c].dataType.simpleString() for c in (within, key, "doc_id", "chunk_index")}
    found = held.mapInArrow(run, f"`{within}` {kind[within]}, left {kind[key]}, right {kind[key]}, right_document_id {kind['doc_id']}, right_chunk {kind['chunk_index']}, semantic_score double")
    unequal = near.where("left <> right").select(within, "left", "right")
    return found.where("left = right").unionByName(found.where("left <> right").join(unequal, [within, "left", "right"], "left_semi"))


def best_of_rows(s: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and number of the top_k greatest of each row; of equal ones the earlier columns, NaN last."""
    given, s = s, np.where(np.isnan(s), -np.inf, s)
    if s.shape[1] > top_k:
        floor = -np.partition(-s, top_k - 1, axis=1)[:, top_k - 1]
        at, to = np.nonzero(s >= floor[:, None])  # the top_k and what equals the last of them
    else:
        at, to = np.nonzero(np.ones(s.shape, bool))
    order = np.lexsort((to, -s[at, to], at))
    at, to = at[order], to[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    at, to = at[place < top_k], to[place < top_k]
    return at, to, given[at, to]


def vector_search(queries: DataFrame, vectors: DataFrame, top_k: int = 50, where: Column | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, similarity): top_k by cosine of a stated query set against all rows, in blocks.

    Queries go to the executors in blocks of a bounded number of rows; every row is scored by a block product in double
    precision, each batch keeps its best top_k per query, and a window merges them.
    """
    rows = vectors if where is None else vectors.where(where)
    spark, found, block = vectors.sparkSession, None, 4096
    ids, vecs = [], []

    def against(ids: list, vecs: list) -> DataFrame:
        q = np.array(vecs, float)
        lengths = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((np.array(ids), q / np.where(lengths == 0, 1, lengths)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, unit = shared.value
            for b in batches:
                b = b.sort_values("id", kind="stable")  # so that a stable order by score leaves equal ones to the smaller id
                for i in range(0, len(b), 8192):
                    part = b.iloc[i : i + 8192]
                    x = np.array(part["v"].tolist(), float).reshape(len(part), -1)
                    n = np.linalg.norm(x, axis=1, keepdims=True)
                    x, key = x / np.where(n == 0, 1, n), part["id"].to_numpy()
                    for q in range(0, len(names), 256):
                        at, to, score = best_of_rows(np.round(unit[q : q + 256] @ x.T, 9), top_k)
                        yield pd.DataFrame({"query_id": names[q + at], "id": key[to], "similarity": score})

        return rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("v is not null").mapInPandas(run, "query_id long, id long, similarity double")

    for r in queries.select(id_col, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        ids.append(r[0])
        vecs.append(r[1])
        if len(ids) == block:
            found = against(ids, vecs) if found is None else found.unionByName(against(ids, vecs))
            ids, vecs = [], []
    if ids or found is None:
        part = against(ids, vecs) if ids else spark.createDataFrame([], "query_id long, id long, similarity double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


_HASHES: dict[int, int] = {}  # of grams; bounded, as it lives as long as its worker


def _gram_hash(code: int) -> int:
    gram = "".join(chr(c - 1) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)
    return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16)


def hashed_grams(texts: list[str], dimension: int = 256) -> np.ndarray:
    """The default embedder: hashed character 3-grams, counted. Each distinct one is hashed once a batch at most; a text of
    fewer than three signs is its own gram."""
    lowered = [(t or "").lower() for t in texts]
    size = np.array([len(t) for t in lowered], int)
    signs = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass") + bytes(12), np.uint32).astype(np.int64) + 1  # 0: no sign
    count = np.maximum(size - 2, 1)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start, code = (np.cumsum(size) - size)[owner] + at, np.zeros(len(owner), np.int64)
    for i in range(3):
        code = code << 21 | np.where(at + i < size[owner], signs[start + i], 0)
    grams, which = np.unique(code, return_inverse=True)
    if len(_HASHES) > 1 << 17:
        _HASHES.clear()
    hashes = [_HASHES.get(g) for g in grams.tolist()]
    for i, h in enumerate(hashes):
        if h is None:
            g = int(grams[i])
            hashes[i] = _HASHES[g] = _gram_hash(g)
    cells = np.array(hashes, np.int64) % dimension
    return np.bincount(owner * dimension + cells[which], minlength=len(texts) * dimension).reshape(-1, dimension).astype(np.float32)


def embed_texts(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_grams, dimension: int = 256, batch: int = 20, stored: DataFrame | None = None) -> DataFrame:
    """(text_hash, embedding, embedded): each distinct text is embedded once, those in stored (text_hash, embedding) not at
    all; a batch that fails gets zero vectors and embedded false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, max(1, 1000 // batch) * batch):
            texts, vectors, fine = b.column("text").to_pylist(), [], []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    got, good = np.asarray(embedder(part), np.float32), True
                    if got.ndim != 2 or len(got) != len(part):
                        raise ValueError(f"{got.shape} for {len(part)} texts")
                except Exception:  # a failing service costs the batch, not the job
                    got, good = np.zeros((len(part), dimension), np.float32), False
                vectors.append(got)
                fine += [good] * len(part)
            ends = np.cumsum([0, *(x.shape[1] for x in vectors for _ in x)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x.ravel() for x in vectors] or [np.zeros(0, np.float32)])))
            yield pa.RecordBatch.from_arrays([b.column("text_hash"), lists, pa.array(fine, pa.bool_())], names=["text_hash", "embedding", "embedded"])

    distinct = chunks.select("text_hash", "text").dropDuplicates(["text_hash"])
    if stored is not None:
        distinct = distinct.join(stored.select("text_hash"), "text_hash", "left_anti")
    vectors = distinct.mapInArrow(run, "text_hash string, embedding array<float>, embedded boolean")
    if stored is not None:
        vectors = vectors.unionByName(stored.select("text_hash", "embedding", F.lit(True).alias("embedded")))
    return vectors


def embed_chunks(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_grams, dimension: int = 256, batch: int = 20, stored: DataFrame | None = None) -> DataFrame:
    """Adds embedding and embedded, as of embed_texts."""
    return chunks.join(embed_texts(chunks, embedder, dimension, batch, stored), "text_hash")


__all__ = ["cosine", "embed_chunks", "embed_texts", "embedding_stats", "hashed_grams", "near_places", "ranked_places", "semantic_candidates", "vector_search"]
