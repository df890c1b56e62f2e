"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked id pairs.

A text is cut where a space follows something else: neither tokenizer merges across such a place, so each unit is
tokenised by itself and the frequent ones once per worker. The ids of a document are written as two binaries; all that
follows is arithmetic on them. Where both tokenizers end a token at the same byte, a group ends; each stretch between
two neighbouring ends of either is one link.

Counts: a first pass over the ids gathers the pairs of each task. The distinct ones, dealt to `PARTS` by a hash, get a
minimal perfect hash function per part (levels of bits that hold the keys which meet no other; the rank of a key's bit
is its slot). Each task's pairs become dense count vectors indexed by slot, summed in a tree: first per part and salt, then per part.
A slot also keeps its key, so a pair that was never counted is told apart. A second pass aligns the documents again and
looks their pairs up. The tables go to the tasks while they hold at most `MOST_PAIRS` pairs; more of them are taken in
ranges of parts, a pass over the ids for each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, kept, pieces, tidy

UNIT = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*| +\Z)*")
PARTS, SALTS, MOST_PAIRS = 256, 8, 4_000_000
KEPT_UNITS, SLICE, TOKENS = 300_000, 2_000_000, 1 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def byte_signs() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable sign: itself, or the next free one from U+0100 on."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of each of their tokens, and the units seen so far."""

    def __init__(self, a: str, b: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        signs, vocab = byte_signs(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.a = {i: bytes(signs[c] for c in t) for t, i in vocab.items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged == sorted(merged):  # ids are ranks
            self.encode_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in self.a.items()}, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            one = Tokenizer.from_file(a)
            one.encode_special_tokens = True
            self.encode_a = lambda t: one.encode(t, add_special_tokens=False).ids
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        size = self.pieces.get_piece_size()
        self.b = [self.bytes_of(self.pieces.id_to_piece(i)) for i in range(size)]
        self.sizes = max(self.a) + 1, size
        self.units: dict[str, tuple[bytes, bytes] | None] = {}

    @staticmethod
    def bytes_of(piece: str) -> bytes:
        if m := re.fullmatch(r"<0x([0-9A-F]{2})>", piece):
            return bytes([int(m[1], 16)])
        return piece.replace("▁", " ").encode()

    def add(self, new: list[str]) -> None:
        """Ids of units as two binaries, None where either does not give the bytes back."""
        for u, y in zip(new, self.pieces.encode([u[1:] for u in new], num_threads=1), strict=True):
            x, raw = self.encode_a(u), u.encode()
            same = b"".join([self.a[i] for i in x]) == raw and b"".join([self.b[i] for i in y]) == raw
            self.units[u] = (np.array(x, "<u4").tobytes(), np.array(y, "<u4").tobytes()) if same else None

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        cut = [UNIT.findall(f" {t}") if t else [] for t in texts]
        new = {u for units in cut for u in units if u not in self.units}
        if len(self.units) + len(new) > KEPT_UNITS and self.units:
            self.units, new = {}, {u for units in cut for u in units}
        self.add(list(new))
        a, b = [], []
        for units in cut:
            got = [self.units[u] for u in units]
            fine = None not in got
            a.append(b"".join([x for x, _ in got]) if fine else b"")
            b.append(b"".join([y for _, y in got]) if fine else b"")
        return a, b

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        a = np.zeros(self.sizes[0], np.int64)
        for i, t in self.a.items():
            a[i] = len(t)
        return a, np.array([len(t) for t in self.b], np.int64)


@dataclass(frozen=True)
class Files:
    a: str  # byte-level BPE
    b: str  # pieces with byte fallback
    pattern: str  # how A cuts text before merging

    def load(self) -> Tokenizers:
        return kept(f"crosstok {self.a} {self.b}", lambda: Tokenizers(self.a, self.b, self.pattern))


def small(ids: bytes, size: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if size <= 1 << 16 else ids


def encoded(docs: DataFrame, files: Files, id_col: str, text_col: str) -> DataFrame:
    """(id, a, b): ids of a row, in two bytes each where the vocabulary allows it."""
    keeps = f"crosstok {files.a} {files.b}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = files.load()
        for whole in batches:
            for part in pieces(whole, "_t", SLICE):
                a, b = both.encode(part.column("_t").to_pylist())
                a, b = ([small(x, n) for x in y] for y, n in zip((a, b), both.sizes, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("_i"), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=[id_col, "a", "b"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).mapInArrow(tidy(run, keeps), f"`{id_col}` {kind}, a binary, b binary")


class Aligned:
    """Several documents one after the other; as A and B of each cover the same bytes, both stay in step."""

    def __init__(self, a: list[bytes], b: list[bytes], lengths: tuple[np.ndarray, np.ndarray]):
        kinds = ["<u2" if len(n) <= 1 << 16 else "<u4" for n in lengths]
        self.n_a, self.n_b = (np.array([len(x) for x in y], np.int64) // int(k[-1]) for y, k in zip((a, b), kinds, strict=True))
        self.a, self.b = (np.frombuffer(b"".join(y), k).astype(np.int64) for y, k in zip((a, b), kinds, strict=True))
        end_a, end_b = (np.cumsum(n[x]) for n, x in zip(lengths, (self.a, self.b), strict=True))
        to = np.searchsorted(end_b, end_a)
        self.last_a = end_b[to] == end_a if len(end_a) else np.zeros(0, bool)  # tokens that end a group
        self.last_b = np.zeros(len(end_b), bool)
        self.last_b[to[self.last_a]] = True
        # an end of either is a link: the tokens that hold the byte before it
        self.ends = np.sort(np.concatenate([end_a, end_b[~self.last_b]]))
        self.key = (self.a[np.searchsorted(end_a, self.ends)] << 32) | self.b[np.searchsorted(end_b, self.ends)]
        self.of_doc = np.searchsorted(self.ends, np.concatenate([[0], end_a])[np.cumsum(self.n_a)], "right")  # links up to each document's end
        self.groups = np.concatenate([[0], np.cumsum(self.last_a)])[np.cumsum(self.n_a)]

    def per_doc(self, upto: np.ndarray) -> np.ndarray:
        return np.diff(upto, prepend=0)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per link over each document."""
        return self.per_doc(np.concatenate([[0], np.cumsum(values)])[self.of_doc])

    def written(self, signs: list[bytes], sizes: tuple[int, int]) -> Iterator[bytes]:
        """a1,a2|b1;a3|b2,b3 of each document."""
        ga, gb = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        n = int(self.last_a.sum())
        before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n))]) for g in (ga, gb))
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + before_b[ga]] = self.a + self.last_a * sizes[0]
        out[np.arange(len(self.b)) + before_a[gb + 1]] = self.b + 2 * sizes[0] + self.last_b * sizes[1]
        at = 0
        for size in (self.n_a + self.n_b).tolist():
            yield b"".join([signs[i] for i in out[at : at + size].tolist()])[:-1]
            at += size


def signs_of(sizes: tuple[int, int]) -> list[bytes]:
    return [b"%d%c" % (i, c) for n, (one, last) in zip(sizes, (b",|", b",;"), strict=True) for c in (one, last) for i in range(n)]


def slices(batches: Iterator[pa.RecordBatch], tokens: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """Batches of about so many tokens."""
    for b in batches:
        step = max(1, int(b.num_rows * tokens * 2 / max(1, b.column("a").nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def part_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, -1) % np.uint64(PARTS)).astype(np.int64)


class Function:
    """Minimal perfect hash functions of several parts. sizes: parts x levels, in bits; bits: those of a part together."""

    def __init__(self, parts: list[int], sizes: list[list[int]], bits: list[bytes]):
        depth = max(map(len, sizes), default=0)
        self.row = np.full(PARTS, -1)
        self.row[parts] = np.arange(len(parts))
        self.sizes = np.array([s + [0] * (depth - len(s)) for s in sizes], np.int64).reshape(len(sizes), depth)
        flat = self.sizes.ravel()
        self.starts = (np.cumsum(flat) - flat).reshape(self.sizes.shape)
        self.words = np.frombuffer(b"".join(bits), "<u8")
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    @staticmethod
    def build(keys: np.ndarray) -> tuple[list[int], bytes]:
        """(sizes, bits) over distinct keys. A level's bit stands for the only key that falls on it."""
        sizes, bits, left = [], [], keys
        while len(left):
            size = -(-3 * len(left) // 128) * 64  # 1.5 bits a key, whole words
            at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").tobytes())
            left = left[~alone[at]]
        return sizes, b"".join(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """0 .. n - 1 for keys of the parts; -1 for some others, any slot for the rest."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        row = self.row[part_of(keys)]
        left = left[row >= 0]
        for level in range(self.sizes.shape[1]):
            size = self.sizes[row[left], level]
            left, size = left[size > 0], size[size > 0]
            at = self.starts[row[left], level] + (mixed(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.ranks[at[hit] >> 6] + below
            left = left[~hit]
        return out


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(first, append=len(keys))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def task_pairs(ids: DataFrame, lengths: tuple[np.ndarray, np.ndarray], most: int = 1_000_000) -> DataFrame:
    """(part, keys, counts): the pairs of a task by parts; more than `most` distinct ones come in several lots."""
    shared = ids.sparkSession.sparkContext.broadcast(lengths)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            part = part_of(keys)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(PARTS + 1))
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x[order])) for x in (keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), *lists], names=["part", "keys", "counts"]).filter(pa.array(np.diff(at) > 0))

        for b in slices(batches):
            k, n = summed(Aligned(b.column("a").to_pylist(), b.column("b").to_pylist(), shared.value).key)
            keys, counts = summed(np.concatenate([keys, k]), np.concatenate([counts, n]))
            if len(keys) > most:
                yield out()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out()

    return ids.select("a", "b").mapInArrow(run, "part int, keys array<long>, counts array<long>")


def hashed(pairs: DataFrame) -> DataFrame:
    """(part, sizes, bits, keys): the function of each part, and its keys by slot."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, keys = b.column("part")[i].as_py(), np.sort(b.column("keys")[i].values.to_numpy())
                sizes, bits = Function.build(keys)
                by_slot = np.empty_like(keys)
                by_slot[Function([part], [sizes], [bits]).slots(keys)] = keys
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sizes], pa.list_(pa.int32())), pa.array([bits]), pa.array([by_slot], pa.list_(pa.int64()))], names=["part", "sizes", "bits", "keys"])

    distinct = pairs.select("part", F.explode("keys").alias("key")).distinct()
    return distinct.groupBy("part").agg(F.collect_list("key").alias("keys")).mapInArrow(run, "part int, sizes array<int>, bits binary, keys array<long>")


def tree_sum(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """(part, counts): a dense vector by slot. A row of pairs is turned into slots by its part's function, which comes before
    them in the order of the partition; only the vector that is being summed is held."""
    salted = pairs.select("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("salt"), "keys", "counts", *(F.lit(None).cast(t).alias(c) for c, t in (("sizes", "array<int>"), ("bits", "binary"))))
    first = functions.select("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("array<long>").alias("counts"), "sizes", "bits")

    @tidy
    def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = salt = function = vector = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([vector], pa.list_(pa.int64()))], names=["part", "counts"])

        for b in batches:
            for i in range(b.num_rows):
                if b.column("bits")[i].is_valid:
                    if vector is not None and vector.any():
                        yield out()
                    part, salt = b.column("part")[i].as_py(), b.column("salt")[i].as_py()
                    function = Function([part], [b.column("sizes")[i].as_py()], [b.column("bits")[i].as_py()])
                    vector = np.zeros(int(function.ranks[-1]), np.int64)
                else:
                    assert (part, salt) == (b.column("part")[i].as_py(), b.column("salt")[i].as_py())
                    vector[function.slots(b.column("keys")[i].values.to_numpy())] += b.column("counts")[i].values.to_numpy()
        if vector is not None and vector.any():
            yield out()

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, vector = None, None
        for b in batches:
            for i in range(b.num_rows):
                mine, counts = b.column("part")[i].as_py(), b.column("counts")[i].values.to_numpy()
                if mine != part:
                    if part is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([vector], pa.list_(pa.int64()))], names=["part", "counts"])
                    part, vector = mine, np.zeros(len(counts), np.int64)
                vector = vector + counts
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([vector], pa.list_(pa.int64()))], names=["part", "counts"])

    rows = first.unionByName(salted).repartition("part", "salt").sortWithinPartitions("part", "salt", F.col("bits").isNull())
    vectors = rows.mapInArrow(by_slot, "part int, counts array<long>")
    return vectors.repartition("part").sortWithinPartitions("part").mapInArrow(whole, "part int, counts array<long>")


@dataclass
class Counts:
    """Counts of the pairs of some parts, and for each B id the highest count of any of its pairs."""

    function: Function
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self.function.slots(keys)
        found = (slot >= 0) & (slot < len(self.keys))
        found[found] = self.keys[slot[found]] == keys[found]
        out = np.zeros(len(keys), np.int64)
        out[found] = self.counts[slot[found]]
        return out


def collected(tables: DataFrame, parts: list[int], best: np.ndarray) -> Counts:
    """Of these parts, with at most MOST_PAIRS pairs together (or of one part)."""
    got = tables.where(F.col("part").isin(parts)).toArrow().sort_by("part")
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy() for x in got.column(c))])
    function = Function(got.column("part").to_pylist(), got.column("sizes").to_pylist(), got.column("bits").to_pylist())
    return Counts(function, flat("keys"), flat("counts"), best)


def looked_up(ids: DataFrame, counts: Counts, lengths: tuple[np.ndarray, np.ndarray], id_col: str, whole: bool) -> DataFrame:
    """The second pass: n_best and count_sum of the links whose pairs the counts hold, by _row; with whole all columns."""
    shared = ids.sparkSession.sparkContext.broadcast((counts, lengths))
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"] if whole else []

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = shared.value
        sizes = tuple(map(len, lengths))
        signs = signs_of(sizes) if whole else []
        for b in slices(batches):
            x = Aligned(b.column("a").to_pylist(), b.column("b").to_pylist(), lengths)
            distinct, at = np.unique(x.key, return_inverse=True)
            n = known.of(distinct)
            best = (n > 0) & (n == known.best[distinct & 0xFFFFFFFF])
            columns = [b.column("_row"), pa.array(x.sums(best[at].astype(np.int64))), pa.array(x.sums(n[at]))]
            if whole:
                sha = pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in x.written(signs, sizes)], pa.string())
                columns += [b.column(id_col), *(pa.array(v) for v in (x.n_a, x.n_b, x.per_doc(x.groups), x.per_doc(x.of_doc))), sha]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "n_best", "count_sum", *names])

    more = f", `{id_col}` {ids.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" if whole else ""
    return ids.mapInArrow(run, f"_row long, n_best long, count_sum long{more}")


def counted(docs: DataFrame, files: Files, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, tuple]:
    """Written ids (_row, id, a, b), tables (part, sizes, bits, keys, counts) of the corpus, and lengths of all tokens."""
    lengths = files.load().lengths()
    ids = scratch.put(encoded(docs, files, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "ids")
    pairs = scratch.put(task_pairs(ids, lengths), "pairs")
    functions = scratch.put(hashed(pairs), "functions")
    tables = scratch.put(functions.join(tree_sum(pairs, functions), "part"), "tables")
    scratch.free("pairs", "functions")
    return ids, tables, lengths


def pair_counts(docs: DataFrame, files: Files, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, count): how many links of the corpus hold the pair."""
    _, tables, _ = counted(docs, files, Scratch(docs.sparkSession, "crosstok"), id_col, text_col)
    return pair_rows(tables).select((F.shiftright("key", 32)).alias("a_id"), low(F.col("key")).alias("b_id"), "count")


def pair_rows(tables: DataFrame) -> DataFrame:
    return tables.select(F.explode(F.arrays_zip("keys", "counts")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.counts").alias("count"))


def low(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << 32) - 1))


def align(docs: DataFrame, files: Files, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row.

    Texts null, empty, or not given back by both tokenizers have no tokens: zeros, an empty groups_sha256, nothing counted.
    Rows that share an id or have none are rows of their own, and repeated rows count as often as they stand there. Texts
    of any length are read whole. Other columns are ignored. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "crosstok")
    ids, tables, lengths = counted(docs, files, scratch, id_col, text_col)
    # a row per B id and a row per part: bounded by the vocabulary and by PARTS
    top = pair_rows(tables).groupBy(low(F.col("key")).alias("b")).agg(F.max("count").alias("count")).toArrow()
    best = np.zeros(len(lengths[1]), np.int64)
    best[top.column("b").to_numpy()] = top.column("count").to_numpy()
    ranges, held = [[]], 0
    for part, n in sorted(map(tuple, tables.select("part", F.size("keys")).collect())):
        if held + n > most_pairs and ranges[-1]:
            ranges, held = [*ranges, []], 0
        ranges[-1].append(part)
        held += n
    columns = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = looked_up(ids, collected(tables, ranges[0], best), lengths, id_col, True)
    if len(ranges) == 1:
        return found.select(*columns)
    for k, parts in enumerate(ranges):
        more = looked_up(ids, collected(tables, parts, best), lengths, id_col, not k)
        sums = scratch.put(more, f"sums-{k}") if not k else sums.unionByName(scratch.put(more, f"sums-{k}"), allowMissingColumns=True)
    named = [F.max(c).alias(c) for c in columns if c not in ("n_best", "count_sum")]
    return sums.groupBy("_row").agg(*named, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).select(*columns)
