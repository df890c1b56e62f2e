"""Exact substring dedup: seed and extend on winnowed anchors.

Every window of `length` words has one anchor: the k-gram of least hash in it. Windows with equal words have equal
anchors, and winnowing leaves about one anchor in seven words. The anchors are the seeds; the windows that share an
anchor's place are the seed extended both ways as far as it speaks for, its surroundings.

Places of one anchor are joined by their surroundings first: where those are equal, all windows are, and the first place
stands for the others, which are repeats as a whole. Where an anchor has several surroundings, their first places meet
window by window (equal anchor and equal window), so that places which agree on one side only are matched as far as they
agree. Windows with an earlier equal one that follow each other merge into maximal repeats of at least `length` words,
and these are removed. Equality is that of two 64-bit hashes, of the anchor and of the words around it.

The order of places is that of (doc_id, text's hash, start): rows with one doc_id are told apart by their texts. Rows
with equal words are one source: the copies are removed whole and take no part. Anchors with so many surroundings that
they could crowd a task are few by arithmetic and are joined by broadcast. Passes over the texts are narrow.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, sliced, texts, tidy

LENGTH = 20
GRAM = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: An anchor with more than this share of all surroundings is joined by broadcast: there are fewer than 1 / share of them.
HOT_SHARE = 1 / 5000


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads sums of word hashes over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def word_hashes(flat: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    seen: defaultdict[bytes, int] = defaultdict(count().__next__)
    at = np.fromiter(map(seen.__getitem__, flat), np.int64, len(flat))
    digest = b"".join([xxhash.xxh64_digest(w) for w in seen])
    return np.frombuffer(digest, ">u8").astype(np.uint64)[at] if flat else np.zeros(0, np.uint64)


class Words:
    """The words of some texts in a row, by their hashes; ends[i] and ends[i + 1] bound those of text i."""

    def __init__(self, rows: list[bytes | None]):
        self.split = [(x or b"").split() for x in rows]
        self.ends = np.cumsum([0, *map(len, self.split)])
        h = word_hashes([w for x in self.split for w in x])
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(h), BASE))))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(h * powers[:-1], dtype=np.uint64)))
        self.back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(h), INVERSE))))

    def hashes(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Hash of the words from a up to z, each."""
        return mixed((self.sums[z] - self.sums[a]) * self.back[a] + (z - a).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def places(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: text, first start, how many, and the anchor's hash."""
        n = int(self.ends[-1])
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        firsts = np.arange(n - gram + 1)
        grams = self.hashes(firsts, firsts + gram)
        at = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1).argmin(axis=1) + np.arange(n - length + 1)
        text = np.repeat(np.arange(len(self.split)), np.diff(self.ends))[: len(at)]
        start = np.flatnonzero(np.arange(len(at)) + length <= self.ends[text + 1])
        at, text = at[start], text[start]
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        return text[new], start[new], np.diff(np.append(new, len(at))), grams[at[new]]


def lists(which: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """Values as n lists; which, ascending, says in which each is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def survey(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (row, doc_id, text) -> (row, doc_id, text, n_words, sha, tie, starts, counts, anchors, arounds)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in pieces(big, "text", 1_000_000):
                words = Words(texts(b, "text"))
                text, start, n, anchor = words.places(length, gram)
                around = words.hashes(start, start + n - 1 + length)
                sha = [hashlib.sha256(b" ".join(x)) for x in words.split]
                found = [start - words.ends[text], n]
                columns = [b.column("row"), b.column("doc_id"), b.column("text"), pa.array(np.diff(words.ends)), pa.array([x.hexdigest() for x in sha], pa.string())]
                columns += [pa.array([int.from_bytes(x.digest()[:8], "big", signed=True) for x in sha], pa.int64())]
                columns += [lists(text, b.num_rows, x.astype(np.int32)) for x in found] + [lists(text, b.num_rows, x.view(np.int64)) for x in (anchor, around)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text", "n_words", "sha", "tie", "starts", "counts", "anchors", "arounds"])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"row {kind}, doc_id long, text string, n_words long, sha string, tie long, starts array<int>, counts array<int>, anchors array<long>, arounds array<long>")


def extended(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs: rows of the survey with contested starts -> (doc_id, tie, anchor, window, start): each window there."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in pieces(big, "text", 1_000_000):
                words, out = Words(texts(b, "text")), []
                for i in range(b.num_rows):
                    starts, counts, anchors, wanted = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("starts", "counts", "anchors", "contested"))
                    at = np.searchsorted(starts, np.sort(wanted))
                    n = counts[at].astype(np.int64)
                    first = np.repeat(starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    out.append((np.full(len(first), i), np.repeat(anchors[at], n), first))
                row, anchor, start = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
                begin = words.ends[row] + start
                window = words.hashes(begin, begin + length).view(np.int64)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(taken), b.column("tie").take(taken), pa.array(anchor.astype(np.int64)), pa.array(window), pa.array(start.astype(np.int32))],
                    names=["doc_id", "tie", "anchor", "window", "start"],
                )

    return docs.mapInArrow(run, "doc_id long, tie long, anchor long, window long, start int")


def covered(n: int, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of n words the windows at these starts cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def contested(shapes: DataFrame) -> DataFrame:
    """shapes with a column: whether their anchor has several surroundings."""
    many = shapes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    most = max(2.0, shapes.count() * HOT_SHARE)
    hot, cold = many.where(F.col("n") > most).select("anchor"), many.where(F.col("n") <= most).select("anchor", F.lit(True).alias("contested"))
    crowd = shapes.join(F.broadcast(hot), "anchor", "left_semi").withColumn("contested", F.lit(True))
    rest = shapes.join(F.broadcast(hot), "anchor", "left_anti").join(cold.hint("merge"), "anchor", "left")
    return crowd.unionByName(rest.withColumn("contested", F.coalesce("contested", F.lit(False))))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (row, doc_id long, text) -> one row each: (row, doc_id, text, n_words, sha, copy, spans).

    spans: the maximal repeats (start, end) in words, ascending; copy: the whole text stands in an earlier document.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    seen = scratch.put(survey(docs, length, gram), "survey")
    key, place = ["doc_id", "tie"], F.struct("doc_id", "tie", "start")
    # copies: of rows with equal words those of the smallest id stay
    ids = seen.where("doc_id is not null").select(*key, "sha", "n_words")
    same = ids.where(F.col("n_words") >= length).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = scratch.put(ids.join(same, "sha").where("doc_id > first").select(*key).distinct(), "copies")
    # a tie says something only where an id has several texts; elsewhere it is left out of what is shuffled
    several = ids.groupBy("doc_id").agg(F.min("tie").alias("a"), F.max("tie").alias("z")).where("a <> z").select("doc_id", F.lit(True).alias("several"))
    several = scratch.put(several, "several")
    alone = several.isEmpty()

    def short(rows: DataFrame) -> DataFrame:
        if alone:
            return rows.withColumn("tie", F.lit(0).cast("long"))
        return rows.join(several, "doc_id", "left").withColumn("tie", F.when(F.col("several"), F.col("tie")).otherwise(0)).drop("several")

    def long(rows: DataFrame) -> DataFrame:
        ties = ids.select(*key).distinct()
        return rows.join(short(ties.withColumn("_tie", F.col("tie"))), key).withColumn("tie", F.col("_tie")).drop("_tie")

    whole = seen.where("doc_id is not null and size(starts) > 0").select(*key, "anchors", "arounds", "starts").join(copies, key, "left_anti")
    sources = short(whole).select(*key, F.inline(F.arrays_zip("anchors", "arounds", "starts"))).toDF(*key, "anchor", "around", "start")
    shapes = scratch.put(sources.groupBy("anchor", "around").agg(F.min(place).alias("first")).select("anchor", "first.*"), "shapes")
    firsts = contested(shapes).groupBy(*key).agg(F.collect_list("start").alias("firsts"), F.collect_list(F.when(F.col("contested"), F.col("start"))).alias("contested"))
    firsts = scratch.put(long(firsts), "firsts")
    scratch.free("shapes")

    open_ = firsts.where("size(contested) > 0").select(*key, "contested")
    windows = extended(seen.select(*key, "text", "starts", "counts", "anchors").join(open_, key), length)
    windows = windows.groupBy("anchor", "window").agg(F.min(place).alias("first")).select("first.*")
    windows = scratch.put(windows.groupBy(*key).agg(F.collect_list("start").alias("windows")), "windows")
    marked = copies.withColumn("copy", F.lit(True))
    found = seen.drop("anchors", "arounds").join(firsts, key, "left").join(windows, key, "left").join(marked, key, "left")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "text", "n_words", "sha", "copy"]
        for b in sliced(batches, "text", 2_000_000):
            spans, lost = [], b.column("copy").fill_null(False).to_pylist()
            for i, n in enumerate(b.column("n_words").to_pylist()):
                gone = [(0, n)] if lost[i] else []
                if not lost[i] and n >= length and b.column("doc_id")[i].is_valid:
                    starts, counts, first, open_, kept = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in (b.column(c)[i] for c in ("starts", "counts", "firsts", "contested", "windows")))
                    # a window stays if its place is the first of its kind, and where that is contested it is itself
                    own = np.repeat(np.isin(starts, first), counts)
                    fight = np.repeat(np.isin(starts, open_), counts)
                    each = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                    cover = covered(n, each[~own | (fight & ~np.isin(each, kept))], length)
                    edges = np.flatnonzero(np.diff(cover, prepend=False, append=False))
                    gone = edges.reshape(-1, 2).tolist()
                spans.append([{"start": a, "end": z} for a, z in gone])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(lost), pa.array(spans, kind)], names=[*names, "spans"])

    kind = docs.schema["row"].dataType.simpleString()
    return found.mapInArrow(run, f"row {kind}, doc_id long, text string, n_words long, sha string, copy boolean, spans array<struct<start:int,end:int>>")


def cut(found: DataFrame) -> DataFrame:
    """Adds n_removed, kept (the words left, joined by one space; null where all are) and kept_sha to rows of repeats()."""
    kind = found.schema["row"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "text", "n_words"]
        for b in sliced(batches, "text", 2_000_000):
            out = []
            for text, sha, gone in zip(texts(b, "text"), b.column("sha").to_pylist(), b.column("spans").to_pylist(), strict=True):
                left = None
                if gone:
                    words, at, left = text.split(), 0, []
                    for x in gone:
                        left += words[at : x["start"]]
                        at = x["end"]
                    left = b" ".join([*left, *words[at:]])
                    sha = hashlib.sha256(left).hexdigest()
                out.append((sum(x["end"] - x["start"] for x in gone), left and left.decode(), sha))
            n, kept, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=[*names, "n_removed", "kept", "kept_sha"])

    return found.mapInArrow(run, f"row {kind}, doc_id long, text string, n_words long, n_removed long, kept string, kept_sha string")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per document.

    Null and empty texts have no words; a text of any length is read whole. A row with a null doc_id loses nothing and is
    no source. Of rows with one doc_id and other words, those of the smaller hash come first; rows equal in both are one
    row and lose the same. An empty table gives an empty table.
    """
    rows = docs.select(F.lit(0).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(repeats(rows, length, gram)).select("doc_id", "n_words", "n_removed", F.col("kept_sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with their repeats cut out of text (n_chars follows); documents of which nothing is left go.

    Texts without repeats stay as they are, white space included. Other columns are kept: they travel as one column, so
    no name can clash.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(repeats(rows, length, gram)).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in rest:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
