"""Benchmark decontamination on a distributed positional inverted index.

The index is partitioned by documents: a row holds a segment (the documents of a few megabytes of text) and, for every
term, the list of its positions there. It is a written table. A phrase of the test set is looked up in each segment from
its rarest term on: that term's list, moved back by the term's offset, gives the places where the phrase can begin, and
the offset-adjusted lists of the next terms, in order of their frequency in the whole corpus, leave fewer and fewer of
them. What all terms leave is an exact match. Positions run through a segment with `GAP` empty ones between documents,
so no phrase spans two of them.

The test set's phrases are a written table too, which every task passes over in blocks: neither the driver nor a task
ever holds them all. A segment's row meets all phrases in one task, so its documents are reported without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, stored, texts, tidy

WINDOW = 10
#: Longest phrase or proximity span.
GAP = 64
#: With more terms than this in the test set, every term of the corpus is indexed, not those alone.
MOST_TERMS = 500_000
#: Phrases that a task looks up at a time.
BLOCK = 20_000
#: Places of rarest terms that a task holds at a time.
MOST_PLACES = 1 << 20
#: A-Z become a-z; every ASCII sign but digits and letters separates words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(terms array<string>, items array<string>): the distinct runs of `window` words and the items that have them.

    An item of fewer words, but not none, is one run. Null ids and null texts give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, found = [], []
            for i, text in zip(b.column("item").to_pylist(), texts(b, "text"), strict=True):
                w = [x.decode() for x in words(text)]
                for k in range(max(1, len(w) - window + 1) if w else 0):
                    who.append(i)
                    found.append(w[k : k + window])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["item", "terms"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    rows = rows.mapInArrow(run, "item string, terms array<string>")
    return rows.groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items"))


def build_index(docs: DataFrame, vocabulary: str | None = None, segment_bytes: int = 2_000_000, id_col: str = "doc_id") -> DataFrame:
    """A row per segment: doc_ids and their doc_words; terms, how often each stands (counts), and all their positions.

    vocabulary: folder of a written table (term) to index those terms alone; None: every term.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        if vocabulary is not None:
            known = {t: i for i, t in enumerate(t for b in stored(vocabulary) for t in texts(b, "term"))}
        part, nth = TaskContext.get().partitionId(), 0
        for big in batches:
            for b in pieces(big, "text", segment_bytes):
                segment, nth = part << 32 | nth, nth + 1
                split = [words(x) for x in texts(b, "text")]
                n = np.fromiter(map(len, split), np.int64, len(split))
                flat = [x for w in split for x in w]
                ids = known if known is not None else {w: i for i, w in enumerate(dict.fromkeys(flat))}
                which = np.fromiter((ids.get(x, -1) for x in flat), np.int32, len(flat))
                pos = (np.arange(len(flat)) + np.repeat(beginnings(n) - np.cumsum(n) + n, n)).astype("<i4")
                which, pos = which[which >= 0], pos[which >= 0]
                order = np.argsort(which, kind="stable")
                names, counts = np.unique(which, return_counts=True)
                spelt = list(ids)
                columns = [[segment], [b.column("_i").to_pylist()], [n], [[spelt[i].decode() for i in names.tolist()]], [counts], [pos[order].tobytes()]]
                kinds = [pa.int64(), pa.list_(b.column("_i").type), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["segment", "doc_ids", "doc_words", "terms", "counts", "positions"])

    row = f"segment long, doc_ids array<{kind}>, doc_words array<long>, terms array<string>, counts array<int>, positions binary"
    return docs.select(F.col(id_col).alias("_i"), "text").mapInArrow(run, row)


def beginnings(doc_words: np.ndarray) -> np.ndarray:
    """The position of each document's first word in its segment."""
    return np.cumsum(doc_words + GAP) - doc_words - GAP


class Segment:
    """The lists of one row of the index."""

    def __init__(self, terms: list[str], counts: np.ndarray, positions: bytes, size: int):
        self.number = {t: i for i, t in enumerate(terms)}
        self.ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.positions = np.frombuffer(positions, "<i4").astype(np.int64)
        self.at = np.full(size, -1, np.int32)  # whose list a position is in
        self.at[self.positions] = np.repeat(np.arange(len(terms), dtype=np.int32), counts)

    def begin(self, terms: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) by the list of each phrase's first term, so many places at a time."""
        sizes = self.ends[terms + 1] - self.ends[terms]
        total, a = np.cumsum(sizes), 0
        while a < len(terms):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + MOST_PLACES, side="right")))
            n = sizes[a:z]
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[terms[a:z]], n)
            yield np.repeat(np.arange(a, z), n), self.positions[places] - np.repeat(offsets[a:z], n)
            a = z

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its term."""
        inside = (positions >= 0) & (positions < len(self.at))
        return inside & (self.at[np.where(inside, positions, 0)] == terms)

    def near(self, terms: np.ndarray, positions: np.ndarray, span: int) -> np.ndarray:
        """Whether each position has one of its term's list less than `span` away."""
        wide = np.int64(len(self.at) + 2 * GAP)
        keys = self.at[self.positions] * wide + self.positions
        want = terms * wide + positions
        after = np.searchsorted(keys, want - span, side="right")
        return (after < len(keys)) & (keys[np.minimum(after, len(keys) - 1)] < want + span)


class Phrases:
    """A block of the written phrases: terms (rarest first), offsets and items."""

    def __init__(self, block: pa.RecordBatch):
        lists = block.column("terms")
        self.sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        spelt = lists.flatten().dictionary_encode()
        self.vocabulary = spelt.dictionary.to_pylist()
        most = int(self.sizes.max()) if len(self.sizes) else 0
        self.filled = np.arange(most)[None, :] < self.sizes[:, None]
        self.terms = np.zeros((len(self.sizes), most), np.int64)
        self.terms[self.filled] = spelt.indices.to_numpy(zero_copy_only=False)
        self.offsets = np.zeros((len(self.sizes), most), np.int64)
        self.offsets[self.filled] = block.column("offsets").flatten().to_numpy(zero_copy_only=False)
        self.items = block.column("items")

    def within(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """The phrases all of whose terms the segment has, and their terms by its numbers."""
        number = np.fromiter((segment.number.get(t, -1) for t in self.vocabulary), np.int64, len(self.vocabulary))
        if not len(number):
            return np.zeros(0, np.int64), self.terms
        terms = number[self.terms]
        which = np.flatnonzero(((terms >= 0) | ~self.filled).all(axis=1))
        return which, terms[which]

    def exact(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every place where a phrase stands."""
        which, terms = self.within(segment)
        offsets, filled, out = self.offsets[which], self.filled[which], []
        if len(which):
            for p, start in segment.begin(terms[:, 0], offsets[:, 0]):
                for r in range(1, terms.shape[1]):
                    keep = ~filled[p, r] | segment.has(terms[p, r], start + offsets[p, r])
                    p, start = p[keep], start[keep]
                out.append((which[p], start))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def close(self, segment: Segment, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of the shortest runs of words, at most `span` long, that hold every term of a phrase."""
        which, terms = self.within(segment)
        filled, found = self.filled[which], set()
        if len(which):
            for p, at in segment.begin(terms[:, 0], np.zeros(len(which), np.int64)):
                for r in range(1, terms.shape[1]):
                    keep = ~filled[p, r] | segment.near(terms[p, r], at, span)
                    p, at = p[keep], at[keep]
                for i, x in zip(p.tolist(), at.tolist(), strict=True):
                    wanted = set(terms[i][filled[i]].tolist())
                    low = max(0, x - span + 1)
                    found.update((which[i], low + k) for k in runs(segment.at[low : x + span].tolist(), wanted, span) if low + k <= x)
        both = np.array(sorted(found), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def runs(words: list[int], wanted: set[int], span: int) -> Iterator[int]:
    """Starts of the runs of at most `span` words that hold all that is wanted and that no shorter one at their end ends."""
    last: dict[int, int] = {}
    for k, w in enumerate(words):
        if w in wanted:
            last[w] = k
            if len(last) == len(wanted) and k - (first := min(last.values())) < span:
                yield first


def ranked(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(terms, offsets, items): the phrases all of whose terms the index has, the terms in order of their frequency."""
    totals = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("total"))
    each = windows.withColumn("phrase", F.array_join("terms", " ")).select("phrase", "items", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    order = F.array_sort(F.collect_list(F.struct("total", "offset", "term")))
    whole = each.join(totals, "term").groupBy("phrase").agg(order.alias("x"), F.first("size").alias("size"), F.first("items").alias("items"))
    return whole.where(F.size("x") == F.col("size")).select(F.col("x.term").alias("terms"), F.col("x.offset").alias("offsets"), "items")


def looked_up(docs: DataFrame, items: DataFrame, tell: Callable, row: str, name: str, window: int = WINDOW, most_terms: int = MOST_TERMS, block: int = BLOCK, id_col: str = "doc_id") -> DataFrame:
    """tell(index row, its segment, blocks of phrases) for each segment."""
    scratch = Scratch(docs.sparkSession, name)
    found = scratch.put(item_windows(items, window), "windows")
    vocabulary = scratch.put(found.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    few = vocabulary.limit(most_terms + 1).count() <= most_terms
    index = scratch.put(build_index(docs, f"{scratch.path}/vocabulary" if few else None, id_col=id_col), "index")
    scratch.put(ranked(index, found), "phrases")
    at = f"{scratch.path}/phrases"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, n, terms, counts, positions = (b.column(c)[i] for c in ("doc_ids", "doc_words", "terms", "counts", "positions"))
                n, counts = (x.values.to_numpy(zero_copy_only=False) for x in (n, counts))
                segment = Segment(terms.as_py(), counts, positions.as_py(), int((n + GAP).sum()))
                yield tell(ids.values, n, segment, map(Phrases, stored(at, block)))

    return index.select("doc_ids", "doc_words", "terms", "counts", "positions").mapInArrow(run, row)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", **sizes) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids), one row per document.

    Null texts have no words; documents with a repeated or null id are reported row by row; an empty table gives an
    empty table, an empty test set hits nothing. Items with a null id or text are left out.
    """
    if window > GAP:
        raise ValueError(f"windows of more than {GAP} words")

    def tell(ids: pa.Array, n: np.ndarray, segment: Segment, blocks: Iterator[Phrases]) -> pa.RecordBatch:
        starts = beginnings(n)
        edges, there = np.zeros(len(segment.at) + 1, np.int64), [set() for _ in range(len(n))]
        for block in blocks:
            p, at = block.exact(segment)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + block.sizes[p], -1)
            both = np.unique(np.stack((np.searchsorted(starts, at, side="right") - 1, p), axis=1), axis=0)
            for d, i in both.tolist():
                there[d].update(block.items[i].as_py())
        covered = np.concatenate(([0], np.cumsum(np.cumsum(edges) > 0)))
        n_hit = covered[starts + n] - covered[starts]
        listed = [sorted(x) for x in there]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0), pa.array(listed, pa.list_(pa.string()))],
            names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    row = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"
    return looked_up(docs, items, tell, row, "decontam", window, id_col=id_col, **sizes)


def proximity(docs: DataFrame, items: DataFrame, span: int = 20, window: int = WINDOW, id_col: str = "doc_id", **sizes) -> DataFrame:
    """(id, start, item_ids): where in a document a run of at most `span` words begins that has all terms of a window of
    those items, in any order; the last such beginning for each end. Terms that a window repeats need to stand once."""
    if max(span, window) > GAP:
        raise ValueError(f"spans of more than {GAP} words")

    def tell(ids: pa.Array, n: np.ndarray, segment: Segment, blocks: Iterator[Phrases]) -> pa.RecordBatch:
        starts, found = beginnings(n), {}
        for block in blocks:
            for i, at in zip(*(x.tolist() for x in block.close(segment, span)), strict=True):
                found.setdefault(at, set()).update(block.items[i].as_py())
        at = np.array(sorted(found), np.int64)
        which = np.searchsorted(starts, at, side="right") - 1
        listed = pa.array([sorted(found[x]) for x in at.tolist()], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(at - starts[which]), listed], names=[id_col, "start", "item_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return looked_up(docs, items, tell, f"`{id_col}` {kind}, start long, item_ids array<string>", "proximity", window, id_col=id_col, **sizes)
