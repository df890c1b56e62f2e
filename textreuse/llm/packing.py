"""Best-fit decreasing packing of tokenised documents into sequences.

Pieces differ for packing only by their length, of which there are at most `capacity` values. The plan is therefore made
from the histogram of lengths alone: best-fit decreasing over runs of equal pieces, with a segment tree over remaining
capacities that finds the tightest open bin in logarithmic time. It is the plan that best-fit decreasing over all
pieces in one list gives. Its size depends on the capacity, not on the number of documents; every piece then finds its
own place from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, kept, pieces, texts, tidy

CAPACITY = 4096
END = 1
#: Words whose ids a worker keeps; it starts afresh beyond that.
KEPT_WORDS = 500_000


#: A letter before an ASCII sign other than the apostrophe: the vocabulary's words end there as well.
LETTERS = rb"[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
SPLIT = re.compile(rb"(" + LETTERS + rb")([!-&(-/:-@\[-`{-~])")
SIMPLE = re.compile(rb"(?:" + LETTERS + rb")+")


class WordIds:
    """Ids of words, each encoded once. The vocabulary drops white space and ignores case, so words are independent.

    Words of letters only are one word of the vocabulary, the last id of which is marked as an end: many of them are
    encoded as one text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _keep(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.at)
        for name, need in (("flat", self.used + len(flat)), ("starts", n + len(words)), ("sizes", n + len(words))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate((held, np.zeros(max(need, len(held)), held.dtype))))
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[n : n + len(words)] = sizes
        self.starts[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def _encode(self, some: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        simple = [w for w in new if SIMPLE.fullmatch(w)]
        for i in range(0, len(simple), 20_000):
            some = simple[i : i + 20_000]
            lines = [b" ".join(some[k : k + 200]).decode() for k in range(0, len(some), 200)]
            flat = np.concatenate([np.array(x, np.uint32) for x in self._encode(lines)])
            last = np.flatnonzero(self.ends[flat])
            if len(last) != len(some):
                raise ValueError("a word of letters has no single end mark")
            self._keep(some, flat, np.diff(last, prepend=-1))
        other = [w for w in new if not SIMPLE.fullmatch(w)]
        for i in range(0, len(other), 20_000):
            some = other[i : i + 20_000]
            ids = self._encode([x.decode() for x in some])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(some, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)

    def encode(self, rows: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.at) > KEPT_WORDS:
            self.clear()
        # a text with what may be a special token keeps its case, which those heed
        words = [(x if b"<|" in x else SPLIT.sub(rb"\1 \2", x.lower())).split() if x else [] for x in rows]
        flat = [w for x in words for w in x]
        if new := set(flat).difference(self.at):
            self._learn(list(new))
        at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate(([0], ends))
        to = 0
        for x in words:
            a, to = to, to + len(x)
            yield ids[ends[a] : ends[to]]


def tokenizer(path: str) -> WordIds:
    return kept(path, lambda: WordIds(path))


PIECE = "piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids, with `part` and `nth`: the task, and the rank in it among pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = tokenizer(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for big in batches:
            for b in pieces(big, "text", 2_000_000):
                who, out = [], []
                for i, ids in enumerate(words.encode(texts(b, "text"))):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        x = ids[at : at + capacity]
                        who.append(i)
                        out.append((k, at, len(x), zlib.crc32(x), seen[len(x)]))
                        seen[len(x)] += 1
                got = np.array(out, np.int64).reshape(-1, 5)
                arrays = [b.column("doc_id").take(pa.array(who, pa.int64())), pa.array(got[:, 0].astype(np.int32))]
                arrays += [pa.array(got[:, i]) for i in range(1, 5)] + [pa.array(np.full(len(got), part, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run, keeps=path), f"doc_id {kind}, {PIECE}, nth long, part int")


class Tightest:
    """Segment tree over capacities 0..top: which of them have open bins."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, at: int, open_: bool) -> None:
        i = at + self.leaves
        self.any[i] = open_
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def first(self, least: int) -> int | None:
        """The smallest capacity of at least `least` with an open bin."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces a bin, offset), sorted: pieces of that length from that rank on go
    to successive bins, so many to each."""
    tree, bins, fresh, rows = Tightest(capacity), {}, 0, []

    def put(left: int, start: int, n: int) -> None:
        if n:
            bins.setdefault(left, []).append((start, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            left = tree.first(length)
            if left is None:
                left, start = capacity, fresh
                m = -(-n // (capacity // length))
                fresh += m
            else:
                start, m = bins[left].pop()
                if not bins[left]:
                    tree.set(left, False)
            each = left // length
            full = min(m, n // each)
            if full:
                rows.append((length, rank, start, each, capacity - left))
                put(left - each * length, start, full)
                rank, n, start, m = rank + full * each, n - full * each, start + full, m - full
            if n and m:
                rows.append((length, rank, start, n, capacity - left))
                put(left - n * length, start, 1)
                n, start, m = 0, start + 1, m - 1
            put(left, start, m)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null and empty texts are the end id alone. Rows with a repeated or null doc_id are packed like any other. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cuts = scratch.put(cut(docs, path, capacity), "pieces")
    by_part = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(plan({r["length"]: r["n"] for r in counts}, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cuts.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        wide = np.int64(1) << 45
        keys = rows[:, 0] * wide + rows[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            r = rows[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            nth = rank - r[:, 1]
            arrays = [b.column(c) for c in names] + [pa.array(r[:, 2] + nth // r[:, 3]), pa.array(r[:, 4] + nth % r[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "rank").mapInArrow(place, f"doc_id {kind}, {PIECE}, sequence_id long, offset long")
