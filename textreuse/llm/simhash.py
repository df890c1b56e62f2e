"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in one pass over the texts, without a shuffle. Equal ones are then one node, so copies never
meet. A fingerprint is cut into two segments of 32 bits: two that differ in at most 3 bits differ in at most one bit
in one of the segments. The table holds each segment as it is; each fingerprint enumerates the ball of radius 1 around
its own segments and fetches the table's matches. Complete distances are verified within a bucket, which gives up a
spanning forest of its links instead of all pairs. A bucket to which more than `hot` rows come is cut again by the 16-bit
parts of the other segment (the same argument holds there), after which 48 bits are fixed but for one flip each: a bucket
then has at most 33 * 17 * 65,536 rows whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, texts, tidy
from .components import connected_components

SHINGLE = 3
RADIUS = 3


def hashes(text: bytes | None, shingle: int = SHINGLE, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """64-bit hashes of the word shingles of a UTF-8 text, as rows of 8 bytes, a block at a time; none without words."""
    words = text.lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:]
    digest = xxhash.xxh64_digest
    for i in range(0, n, block):
        spans = zip(starts[i : min(i + block, n)].tolist(), last[i : i + block].tolist(), strict=True)
        yield np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 8)


def fingerprint(text: bytes | None, block: int = 1 << 16, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for raw in hashes(text, shingle, block):
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
        n += len(raw)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per document; null and empty texts have 0."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "_t"):
                fp = pa.array([fingerprint(x) for x in texts(b, "_t")], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_i"), fp], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links (at most RADIUS differing bits) between distinct fingerprints."""
    out, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= RADIUS
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp), sorted by bucket -> links (u, v). Groups that go on in the next batch wait for it."""
    kept: list[np.ndarray] = []

    def groups(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1 if len(key) else np.zeros(0, np.int64)
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
        two = starts[ends - starts == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        near = near[fp[near] != fp[near + 1]]
        u, v = [fp[near]], [fp[near + 1]]
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            if links := forest(np.unique(fp[a:b])):
                x = np.array(links, np.uint64)
                u.append(x[:, 0])
                v.append(x[:, 1])
        arrays = [pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in (u, v)]
        return pa.RecordBatch.from_arrays(arrays, names=["u", "v"])

    for b in batches:
        kept.append(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sub", "fp")], axis=1))
        last = kept[-1][-1, :2] if len(kept[-1]) else None
        if last is None or (kept[0][0, :2] == last).all():
            continue
        rows = np.concatenate(kept)
        cut = len(rows) - int((rows[:, :2] == last).all(axis=1)[::-1].argmin())
        kept = [rows[cut:]]
        yield groups(rows[:cut, :2], rows[:cut, 2].view(np.uint64).copy())
    if kept and len(rows := np.concatenate(kept)):
        yield groups(rows[:, :2], rows[:, 2].view(np.uint64).copy())


def _ball(value: Column, bits: int) -> list[Column]:
    return [value, *(value.bitwiseXOR(F.lit(1 << i)) for i in range(bits))]


def _balls(fps: DataFrame, segments: list, bits: int) -> DataFrame:
    """Each member with the buckets in its balls: n entries of the table, `one` of them.

    Of buckets with a single entry, only those remain in which the complete distance to it is small enough.
    """
    wide = lambda s, v: F.lit(s << 32).cast("long").bitwiseOR(v)
    keep = fps.columns
    by = [c for c in keep if c != "fp"] + ["at"]
    held = fps.select(*keep, F.explode(F.array(*(wide(s, v) for s, v in enumerate(segments)))).alias("at"))
    held = held.groupBy(*by).agg(F.count("*").alias("n"), F.min("fp").alias("one"))
    around = F.array(*(wide(s, x) for s, v in enumerate(segments) for x in _ball(v, bits)))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("one")))
    # Spark takes an exploded table for as small as what it came from, and would broadcast it
    near = fps.select(*keep, F.explode(around).alias("at"))
    return near.join(held.hint("merge"), by).where((F.col("n") > 1) | far.between(1, RADIUS))


def links(fps: DataFrame, scratch: Scratch, hot: int = 4096) -> DataFrame:
    """(u, v) between distinct fingerprints of column fp; enough of them to connect all that link.

    A bucket is hot by the rows that come to it, its own entries and those one flip away.
    """
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    fp, n = F.col("fp"), F.col("n")
    found = scratch.put(_balls(fps.select("fp"), [low(fp), F.shiftrightunsigned(fp, 32)], 32), "buckets")
    several = found.where(n > 1).select(F.col("at").alias("key"), "fp")
    crowded = several.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot)
    # no more of them than there are rows over `hot`, and mostly none
    crowded = scratch.put(crowded.select("key", F.lit(True).alias("crowded")), "hot")
    if crowded.isEmpty():
        groups, pairs = several.withColumn("sub", F.lit(-1).cast("long")), []
    else:
        several = several.join(crowded.hint("merge"), "key", "left")
        other = F.when(F.shiftrightunsigned("key", 32) == 0, F.shiftrightunsigned(fp, 32)).otherwise(low(fp))
        again = _balls(several.where("crowded").drop("crowded"), [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)], 16)
        again = scratch.put(again, "hot-buckets")
        groups = several.where("crowded is null").select("key", "fp", F.lit(-1).cast("long").alias("sub"))
        groups = groups.unionByName(again.where(n > 1).select("key", F.col("at").alias("sub"), "fp"))
        pairs = [again.where(n == 1)]
    groups = groups.select("key", "sub", "fp").repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(tidy(_link), "u long, v long")
    for one in (found.where(n == 1), *pairs):
        groups = groups.unionByName(one.select(fp.alias("u"), F.col("one").alias("v")))
    return groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 4096) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated ids keep their rows.
    A null id is carried along: its component is the smallest id that its fingerprint reaches, or null.
    A text of any length is hashed whole, in slices of bounded memory. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = scratch.put(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    label = connected_components(links(nodes, scratch, hot), scratch).withColumnRenamed("node", "fp")
    nodes = nodes.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    found = scratch.put(nodes.join(least, "label").select("fp", "component_id"), "components")
    scratch.only("fingerprints", "components")
    return fps.join(found, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
