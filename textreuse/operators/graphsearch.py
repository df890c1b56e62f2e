"""Nearest vectors by a navigable small-world graph, with filters.

Rows are dealt by hash into shards of about `rows` vectors. Each shard has its own graph, stored as rows of a table
(size, shard, node, neighbours, unit vector and what is kept of the row for filters). A node is linked to near ones that
no nearer link already covers, to those that chose it, to a few at random and to the next node, so every node can be
reached. A query walks the graph of each shard and looks only at the neighbours of the best nodes found so far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS, LINKS, BEAM, BLOCK = 8192, 24, 64, 4096
#: A walk looks at about so many vectors per place of its beam.
PER_PLACE = 24


def unit_rows(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def linked(unit: np.ndarray, links: int = LINKS) -> list[np.ndarray]:
    """The neighbours of each node of a shard: at most 2 * links near ones, links // 4 at random and the next one."""
    n, k = len(unit), min(len(unit) - 1, 3 * links)
    chosen: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for a in range(0, n if k > 0 else 0, 256):
        s = unit[a : a + 256] @ unit.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        score = np.take_along_axis(s, near, 1)
        between = np.einsum("bid,bjd->bij", unit[near], unit[near])
        kept = np.zeros(near.shape, bool)
        for j in range(k):  # from the nearest on: left out where a kept one is nearer to it than the node is
            covered = ((between[:, j] > score[:, j, None] + 1e-12) & kept).any(axis=1)
            kept[:, j] = ~covered & (kept.sum(axis=1) < links)
        for i, j in zip(*np.nonzero(kept), strict=True):
            chosen[a + i].append((score[i, j], int(near[i, j])))
    back: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for i, mine in enumerate(chosen):
        for s, j in mine:
            back[j].append((s, i))
    far = np.random.default_rng(n).integers(0, n, (n, max(1, links // 4)))
    found = []
    for i in range(n):
        mine = dict.fromkeys(j for _, j in chosen[i])
        more = [j for _, j in sorted(back[i], reverse=True) if j not in mine][: 2 * links - len(mine)]
        found.append(np.array([j for j in dict.fromkeys([*mine, *more, *far[i].tolist(), (i + 1) % n]) if j != i], np.int32))
    return found


def build_graph(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), rows: int = ROWS, links: int = LINKS) -> DataFrame:
    """(size, shard, node, id, unit, neighbours, keep...): a row per vector. Ids are unique.

    Vectors null, empty or with null or non-finite components have no row; those of different lengths get graphs of their
    own. A vector of zeros is similar to nothing, with 0.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *keep).where(F.coalesce(fine, F.lit(False)) & (F.size("v") > 0)).withColumn("size", F.size("v"))
    shards = held.groupBy("size").agg(F.ceil(F.count("*") / rows).alias("_n"))  # a row per length of vectors
    held = held.join(shards, "size").withColumn("shard", F.pmod(F.xxhash64("id", "v"), "_n").cast("int")).drop("_n")
    kept = "".join(f", `{c}` {held.schema[c].dataType.simpleString()}" for c in keep)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        unit = unit_rows(part["v"].tolist())
        out = part[["size", "shard", "id", *keep]].copy()
        return out.assign(node=np.arange(len(part), dtype=np.int32), unit=list(unit), neighbours=linked(unit, links))

    return held.groupBy("size", "shard").applyInPandas(build, f"size int, shard int, id long{kept}, node int, unit array<double>, neighbours array<int>")


def walk(unit: np.ndarray, links: list[np.ndarray], good: np.ndarray, queries: np.ndarray, top_k: int, beam: int = BEAM, banned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(nodes, similarities, how many vectors were looked at) of the top_k good nodes per query, -1 where there are fewer.

    The beam is widened by the share of good nodes; where a walk would look at more vectors than are good, these are looked
    at one and all. banned: a node per query that is not its own answer, or -1.
    """
    n, sure = len(unit), int(good.sum())
    banned = np.full(len(queries), -1) if banned is None else banned
    nodes, scores, looked = np.full((len(queries), top_k), -1), np.full((len(queries), top_k), -np.inf), 0
    if not sure:
        return nodes, scores, 0
    wide = max(beam, 2 * top_k) * n // sure
    if PER_PLACE * wide >= sure:
        only = np.flatnonzero(good)
        for a in range(0, len(queries), 256):
            s = np.round(queries[a : a + 256] @ unit[only].T, 9)
            s[only[None, :] == banned[a : a + 256, None]] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :top_k]
            value = np.take_along_axis(s, best, 1)
            nodes[a : a + 256, : best.shape[1]], scores[a : a + 256, : best.shape[1]] = np.where(np.isfinite(value), only[best], -1), value
        return nodes, scores, sure * len(queries)
    width = max(map(len, links))
    table = np.array([np.pad(x, (0, width - len(x)), constant_values=i) for i, x in enumerate(links)])
    for a in range(0, len(queries), 64):
        q, mine = queries[a : a + 64], np.arange(len(queries[a : a + 64]))[:, None]
        seen = np.zeros((len(q), n), bool)
        at = np.tile(np.linspace(0, n - 1, 16).astype(int), (len(q), 1))
        seen[mine, at] = True
        s, open_ = np.einsum("qd,qjd->qj", q, unit[at]), np.ones(at.shape, bool)
        looked += at.size
        while open_.any():
            step = np.argsort(np.where(open_, -s, np.inf), axis=1, kind="stable")[:, :4]
            live = np.take_along_axis(open_, step, 1)
            open_[mine, step] = False
            new = table[np.take_along_axis(at, step, 1)].reshape(len(q), -1)
            new = np.where(np.repeat(live, width, axis=1), new, at[:, :1])
            new.sort(axis=1)
            fresh = ~seen[mine, new] & np.concatenate([np.ones((len(q), 1), bool), new[:, 1:] != new[:, :-1]], axis=1)
            seen[mine, new] = True
            looked += int(fresh.sum())
            value = np.full(new.shape, -np.inf)
            r, c = np.nonzero(fresh)
            value[r, c] = np.einsum("id,id->i", q[r], unit[new[r, c]])
            at, s, open_ = np.concatenate([at, new], 1), np.concatenate([s, value], 1), np.concatenate([open_, fresh], 1)
            if at.shape[1] > wide:
                best = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
                at, s, open_ = (np.take_along_axis(x, best, 1) for x in (at, s, open_))
        s = np.where(np.isfinite(s) & good[at] & (at != banned[a : a + 64, None]), np.round(s, 9), -np.inf)
        order = np.lexsort((at, -s), axis=1)[:, :top_k]
        value = np.take_along_axis(s, order, 1)
        nodes[a : a + 64, : order.shape[1]], scores[a : a + 64, : order.shape[1]] = np.where(np.isfinite(value), np.take_along_axis(at, order, 1), -1), value
    return nodes, scores, looked


def graph_search(queries: DataFrame, graph: DataFrame, top_k: int = 50, where: Column | None = None, id_col: str = "vec_id", vector: str = "embedding", beam: int = BEAM, itself: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank, looked): the top_k found by cosine among the rows that where lets through, ties to
    smaller ids. where may use id and what the graph keeps. looked: vectors that were compared for the block of the query,
    per query. itself: a query may find its own id.

    Queries (unique ids) meet each shard in blocks of a bounded size; a graph is sent once per block. Odd queries, as in
    build_graph, and lengths that the graph doesn't have find nothing.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False))).withColumn("size", F.size("v"))
    blocks = asked.groupBy("size").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    shards = graph.groupBy("size").agg((F.max("shard") + 1).alias("_shards"))
    asked = asked.join(blocks.join(shards, "size"), "size").withColumn("block", F.pmod(F.xxhash64("query_id", "v"), "_blocks"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))).select("size", "shard", "block", "query_id", "v")
    held = graph.withColumn("good", F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)).select("size", "shard", "node", "id", "unit", "neighbours", "good")
    held = held.join(blocks, "size").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")

    def run(part: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(of):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": [], "looked": []})
        of = of.sort_values("node", ignore_index=True)
        ids = of["id"].to_numpy()
        unit, asks = np.stack(of["unit"].tolist()), part["query_id"].to_numpy()
        banned = None
        if not itself:
            place = {x: i for i, x in enumerate(ids)}
            banned = np.array([place.get(x, -1) for x in asks])
        nodes, scores, looked = walk(unit, of["neighbours"].tolist(), of["good"].to_numpy(bool), unit_rows(part["v"].tolist()), top_k, beam, banned)
        r, c = np.nonzero(nodes >= 0)
        return pd.DataFrame({"query_id": asks[r], "id": ids[nodes[r, c]], "similarity": scores[r, c], "looked": looked / len(part)})

    key = ["size", "shard", "block"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(run, "query_id long, id long, similarity double, looked double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
