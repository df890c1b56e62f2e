"""Near-duplicates by the Jaccard similarity of word shingles: the pipeline's stage after SimHash.

SimHash of 64 bits puts two texts of similarity 0.8 about ten bits apart, farther than a multi-index can reach. So its
links (five words, radius 3) are joined by those of texts that share a band of MinHash values, and every candidate is
verified on the complete sets of shingles. Texts of equal sets are one node.

A band of four values is shared at 0.8 with probability 0.41, one of 20 bands with 0.99997. Within a bucket of at most
`small` nodes all pairs are candidates. In a larger one, around a common passage or of near copies, each node first meets
two others: the one that shares most bands with the corpus and one by hash, another in each band. What is found makes
groups. Then all nodes of large buckets are joined by an exact set-similarity join: two sets of the wanted similarity share
one of their rarest shingles, with enough of both sets after it. Only nodes of different groups meet there, so a group of
thousands of copies makes no pairs of its own, and no pair of a large bucket depends on a centre.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreuse.operators.setjoin import least_overlap

from . import simhash
from .common import Scratch, pieces, texts, tidy
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4

_stream = np.random.default_rng(42)
FACTORS = _stream.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _stream.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    found = list(simhash.hashes(text, SHINGLE))
    return np.unique(np.concatenate(found).view(np.uint64).ravel()) if found else np.zeros(0, np.uint64)


def bands(grams: np.ndarray) -> np.ndarray:
    """A key for each band, different from band to band."""
    if not len(grams):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(grams), 4096):
        x = grams[i : i + 4096, None] * FACTORS + OFFSETS
        x ^= x >> np.uint64(31)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, fp, size, keys): one row per document; size: of its set of shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "_t", 1_000_000):
                raw = texts(b, "_t")
                grams = [shingles(x) for x in raw]
                fp = pa.array([simhash.fingerprint(x, shingle=SHINGLE) for x in raw], pa.int64())
                size = pa.array([len(g) for g in grams], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_i"), pa.array(node_of(grams)), fp, size, lists([bands(g) for g in grams])], names=[id_col, "node", "fp", "size", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, node long, fp long, size long, keys array<long>")


def lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))


def node_of(grams: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(g.tobytes(), 7) for g in grams], np.uint64).view(np.int64)


def sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, grams) of the wanted nodes (node, least: an id that has it): only their texts are read again."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "_t", 1_000_000):
                grams = [shingles(x) for x in texts(b, "_t")]
                yield pa.RecordBatch.from_arrays([pa.array(node_of(grams)), lists(grams)], names=["node", "grams"])

    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    mine = rows.join(wanted.select(F.col("least").alias("_i")).where("_i is not null"), "_i", "left_semi")
    if not wanted.where("least is null").isEmpty():
        mine = mine.unionByName(rows.where("_i is null"))
    found = mine.select("_t").mapInArrow(run, "node long, grams array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def all_pairs(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """(u, v): the pairs of each bucket; for small ones."""
    few = entries.join(buckets, "key").groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("all"))
    few = few.select("all", F.posexplode("all").alias("at", "u"))
    return few.select("u", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("v"))


def apart(crowd: DataFrame, labels: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(u, v, u_size, v_size): nodes of different groups of the crowd (node, grams) that may be similar. Shingles are ordered from the rarest
    on; a pair meets at a shingle of both prefixes, if sizes and what is left on both sides allow the similarity."""
    crowd = scratch.put(crowd.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "grams"), "crowd")
    flat = crowd.select("node", F.explode("grams").alias("g"))
    often = flat.groupBy("g").agg(F.count("*").alias("c"))
    n = F.size("s")
    ranked = flat.join(often, "g").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("s"))
    prefix = ranked.select("node", n.alias("n"), F.posexplode(F.slice("s", F.lit(1), (n - F.ceil(similarity * n - F.lit(1e-9)) + 1).cast("int"))).alias("at", "x"))
    # a shingle of one node meets nothing
    prefix = scratch.put(prefix.where("x.c > 1").select("node", "n", "at", F.col("x.g").alias("g")).join(crowd.select("node", "label"), "node"), "prefixes")
    left, right = (prefix.select("g", F.col("node").alias(e), *(F.col(c).alias(f"{e}_{c}") for c in ("n", "at", "label"))) for e in "uv")
    near = F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-9
    rest = 1 + F.least(F.col("u_n") - F.col("u_at") - 1, F.col("v_n") - F.col("v_at") - 1)
    pairs = left.join(right, "g").where((F.col("u") < F.col("v")) & (F.col("u_label") != F.col("v_label")) & near & (rest >= least_overlap(similarity, F.col("u_n"), F.col("v_n"))))
    return pairs.select("u", "v", F.col("u_n").alias("u_size"), F.col("v_n").alias("v_size")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, small: int = 16) -> DataFrame:
    """One row per document: id, component_id (smallest id reachable over pairs of at least this similarity).

    Null, empty and blank texts are equal; a text of fewer words than a shingle is one shingle. Repeated ids keep their
    rows. A null id is carried along: its component is the smallest id that its text reaches, or null.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = scratch.put(signed(docs, id_col, text_col), "signed")
    read = lambda wanted: sets(docs, wanted, id_col, text_col)
    nodes = scratch.put(rows.groupBy("node").agg(F.min(id_col).alias("least"), F.min("fp").alias("fp"), F.max("size").alias("size"), F.min("keys").alias("keys")), "nodes")
    fps = scratch.put(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    same = nodes.join(fps, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    ends = (fps.select(F.col("fp").alias(e), F.col("first").alias(f"_{e}")) for e in "uv")
    near = simhash.links(fps, scratch)
    for end in ends:
        near = near.join(end, end.columns[0])
    pairs = same.unionByName(near.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    entries = nodes.select("node", F.explode("keys").alias("key"))
    buckets = scratch.put(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = entries.join(buckets, "key").groupBy("node").agg(F.sum("n").alias("shared"))
    large = scratch.put(entries.join(buckets.where(F.col("n") > small).select("key"), "key", "left_semi").join(shared, "node"), "large")
    centres = large.groupBy("key").agg(F.max_by("node", F.struct("shared", "node")).alias("middle"), F.min_by("node", F.xxhash64("node", "key")).alias("by_hash"))
    centred = large.join(centres, "key").select(F.col("node").alias("u"), F.explode(F.array("middle", "by_hash")).alias("v"))
    pairs = all_pairs(entries, buckets.where(F.col("n") <= small)).unionByName(centred).unionByName(same).unionByName(near.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    links = scratch.put(verified(pairs, read, nodes, similarity, scratch, "first"), "links")
    scratch.free("sets-first", "pairs-first")
    label = connected_components(links, scratch, "first")
    crowd = scratch.put(nodes.join(large.select("node").distinct(), "node", "left_semi").select("node", "least"), "crowded")
    if not crowd.isEmpty():
        rest = scratch.put(apart(read(crowd), label.toDF("node", "label"), similarity, scratch), "rest")
        scratch.free("crowd", "prefixes")
        links = links.unionByName(scratch.put(verified(rest, read, nodes, similarity, scratch, "second"), "links-second"))
        label = connected_components(links, scratch, "second")
    nodes = nodes.select("node", "least").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    found = nodes.join(least, "label").select("node", "component_id")
    found = scratch.put(rows.select(id_col, "node").join(found, "node").select(id_col, "component_id"), "components")
    scratch.only("components")
    return found


def verified(pairs: DataFrame, read: Callable, nodes: DataFrame, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) of nodes whose complete sets are at least that similar. With u_size and v_size they are u < v already
    and none stands twice."""
    if "u_size" not in pairs.columns:
        pairs = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        for end in "uv":
            pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size")), end)
    pairs = scratch.put(pairs.where(F.least("u_size", "v_size") >= similarity * F.greatest("u_size", "v_size")), f"pairs-{name}")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = scratch.put(nodes.join(ends, "node", "left_semi").select("node", "least"), f"wanted-{name}")
    found = scratch.put(read(wanted), f"sets-{name}")
    for end in "uv":
        pairs = pairs.join(found.select(F.col("node").alias(end), F.col("grams").alias(f"{end}_grams")), end)
    both = F.size(F.array_intersect("u_grams", "v_grams"))
    return pairs.where(both >= similarity * (F.col("u_size") + F.col("v_size") - both)).select("u", "v")
