"""Katz back-off language model on bigrams of words, with Good-Turing discounts and exactly normalised back-off weights.

    p(w | h) = d(c(hw)) c(hw) / c(h)   where c(hw) > 0,  else  a(h) p(w)
    p(w)     = d(c(w)) c(w) / N        where c(w) > 0,   else  what the discounts leave, for any unknown word
    a(h)     = (1 - sum of p(w | h) over seen w) / (1 - sum of p(w) over the same w);  1 where h is unknown

Counts up to `K` are discounted. A history all of whose followers are seen more often than that has c(h) + 1 for c(h),
so that something is left for unseen followers. A text's first word follows the end of a text. Histories of `HOT` tokens
or more are dealt to several buckets, which changes nothing in the model: whether one of them has c(h) + 1 is decided by
the sums over its buckets, and documents' sums that were made without it are set right.

How it runs: texts become chunks of word numbers, each with its own vocabulary (one pass). Word counts are summed over
the chunks' vocabularies and given back to them. Each chunk then deals its bigrams, with the documents that have them,
to buckets by the history's hash (histories of HOT tokens: by both words); a bucket sums counts over chunks, and returns
its part of the model, the buckets' shares of the documents' sums (by count, so that the discounts, which need all
buckets, come last), and the documents' unseen bigrams with their history's figures. Words are identified by 64-bit
hashes. What crosses the network are packed columns of a chunk's bucket; their number grows with the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pieces, texts

K = 5
HOT = 500_000
END = b""  # no word is empty
CHUNK_TOKENS = 1_200_000
BUCKET_TOKENS = 1_000_000
#: The buckets are filled in so many rounds, so that only a share of the bigrams is in shuffle files at a time.
ROUNDS = 2


_SHRINK, _GROW = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def packed(x: np.ndarray) -> bytes:
    """Integers as the bytes of their planes, compressed."""
    x = np.ascontiguousarray(x, "<i8")
    return _SHRINK.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_GROW.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def listed(x: np.ndarray, *along: np.ndarray) -> bytes:
    """Repeated values as numbers into the list of distinct ones; along: what depends on the value, listed once as well."""
    values, first, at = np.unique(x, return_index=True, return_inverse=True)
    parts = [packed(at), packed(values), *(packed(y[first]) for y in along)]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unlisted(raw: bytes) -> list[np.ndarray]:
    parts, i = [], 0
    while i < len(raw):
        n = int.from_bytes(raw[i : i + 8], "little")
        parts.append(unpacked(raw[i + 8 : i + 8 + n]))
        i += 8 + n
    return [x[parts[0]] for x in parts[1:]]


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from; a null id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, vocabulary binary, counts binary"


def encode(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of texts: word numbers of each document, its end included, and the hashes and training counts of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, fresh = TaskContext.get().partitionId(), 0, True
        for big in batches:
            for b in pieces(big, "text", 2_000_000):
                if fresh:
                    seen: defaultdict[bytes, int] = defaultdict(count().__next__)
                    ids, held, sizes, tokens, fresh = [], [], [], [], False
                words = []
                for x in texts(b, "text"):
                    mine = (x or b"").lower().split()
                    sizes.append(len(mine) + 1)
                    words += mine
                    words.append(END)
                tokens.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                ids += b.column("doc_id").to_pylist()
                held += b.column("held").to_pylist()
                if sum(map(len, tokens)) >= chunk_tokens:
                    yield chunk(part << 32 | nth, ids, held, sizes, tokens, seen)
                    nth, fresh = nth + 1, True
        if not fresh:
            yield chunk(part << 32 | nth, ids, held, sizes, tokens, seen)

    def chunk(key: int, ids: list, held: list, sizes: list, tokens: list, seen: dict) -> pa.RecordBatch:
        flat = np.concatenate(tokens)
        learnt = np.repeat(~np.array(held, bool), sizes)
        hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in seen]), ">i8").astype(np.int64)
        n = np.bincount(flat[learnt], minlength=len(seen))
        columns = [[key], [ids], [held], *([packed(x)] for x in (np.array(sizes), flat, hashes, n))]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
        names = ["chunk", "doc_ids", "held", "sizes", "tokens", "vocabulary", "counts"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(run, CHUNKS)


def vocabularies(chunks: DataFrame) -> DataFrame:
    """(chunk, at, word, n): each chunk's words, their numbers there and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, words, n in zip(*(b.column(c).to_pylist() for c in ("chunk", "vocabulary", "counts")), strict=True):
                w, n = unpacked(words), unpacked(n)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(w), key), np.arange(len(w)), w, n)], names=["chunk", "at", "word", "n"])

    return chunks.select("chunk", "vocabulary", "counts").mapInArrow(run, "chunk long, at long, word long, n long")


def discounts(by_count: dict[int, int]) -> np.ndarray:
    """Good-Turing factors of the counts 0..K (index 0 unused). Where the counts of counts give none between 0 and 1,
    as in small or odd tables, half a count is taken instead."""
    n = [by_count.get(r, 0) for r in range(K + 2)]
    d = np.ones(K + 1)
    cut = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class Unigrams:
    """p(w) by count."""

    def __init__(self, total: int, distinct: int, by_count: dict[int, int]):
        self.total, self.distinct, self.d = total, distinct, discounts(by_count)
        kept = total - sum((1 - self.d[r]) * r * by_count.get(r, 0) for r in range(1, K + 1))
        self.below = total if total - kept > 0 else total + 1
        self.unknown = 1 - kept / self.below

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.where(c <= K, self.d[np.minimum(c, K)], 1.0) * c / self.below, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


#: kind: local (a chunk's documents), pairs (a chunk's bigrams in a bucket), share (their documents' sums), model, hot.
PARTS = "kind string, bucket long, chunk long, doc_ids array<long>, held array<boolean>, a binary, b binary, c binary, d binary, e binary, f binary, g binary, x binary, y binary"
NAMES = ["kind", "bucket", "chunk", "doc_ids", "held", "a", "b", "c", "d", "e", "f", "g", "x", "y"]
SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((c, pa.binary()) for c in NAMES[5:])])


def rows_of(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([{c: r.get(c) for c in NAMES} for r in rows], schema=SCHEMA)


def deal(chunks: DataFrame, one: Unigrams, buckets: int, hot: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """chunks with word_counts array<struct<at, total>> -> pairs rows of the round's buckets; local rows in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                got = {c: b.column(c)[i] for c in b.schema.names}
                for r in split(got):
                    yield from rows_of([r]).to_batches()

    def split(got: dict) -> Iterator[dict]:
        key, held = got["chunk"].as_py(), np.array(got["held"].as_py(), bool)
        sizes, t, words = (unpacked(got[c].as_py()) for c in ("sizes", "tokens", "vocabulary"))
        total = unpacked(got["counts"].as_py()).copy()
        counts = got["word_counts"].values
        total[counts.field("at").to_numpy(zero_copy_only=False)] = counts.field("total").to_numpy(zero_copy_only=False)
        end = int(np.flatnonzero(words == END_HASH)[0])
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        before = np.concatenate(([end], t[:-1]))
        before[starts] = end
        by_doc = lambda v: np.add.reduceat(v, starts)
        alone = total[before] == 0  # an unknown history leaves the word to itself
        local = np.where(alone, np.log10(one.p(total[t])), 0.0)
        if turn == 0:
            yield {
                "kind": "local", "bucket": -1 - key % buckets, "chunk": key, "doc_ids": got["doc_ids"].as_py(), "held": got["held"].as_py(),
                "a": packed(sizes), "b": packed(by_doc((total[t] > 0).astype(np.int64))), "x": by_doc(one.base(total[t])).tobytes(), "y": by_doc(local).tobytes(),
            }
        h, w, doc = before[~alone], t[~alone], doc[~alone]
        if not len(h):
            return
        # entries: a bigram in a document, and how often
        pair, doc, n = entries_of(h * len(words) + w, doc, len(words) ** 2, len(sizes))
        at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        entries = np.diff(np.append(at, len(pair)))
        learnt = np.add.reduceat(np.where(held[doc], 0, n), at)
        h, w = np.divmod(pair[at], len(words))
        del pair, t, before, alone
        spread = np.where(total[h] >= hot, mix(words[w]) % np.maximum(1, (total[h] // hot + 1)).astype(np.uint64) + np.uint64(1), np.uint64(0))
        where = (mix(words[h] ^ mix(spread).view(np.int64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        order = order[where[order] % rounds == turn]
        edges = np.flatnonzero(np.diff(where[order], prepend=-1, append=-1))
        begin = at
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            o = order[a:z]
            mine = np.repeat(begin[o] - np.cumsum(entries[o]) + entries[o], entries[o]) + np.arange(entries[o].sum())
            yield {
                "kind": "pairs", "bucket": int(where[o[0]]), "chunk": key, "a": listed(words[h[o]], total[h[o]]), "b": listed(words[w[o]], total[w[o]]), "e": packed(learnt[o]), "f": packed(entries[o]), "g": packed(doc[mine]), "x": packed(n[mine]),
            }

    return chunks.mapInArrow(run, PARTS)


def entries_of(pair: np.ndarray, doc: np.ndarray, pairs: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, doc) in order, and how often each stands."""
    if pairs * docs < 1 << 62:
        both, n = np.unique(pair * docs + doc, return_counts=True)
        return both // docs, both % docs, n
    order = np.lexsort((doc, pair))
    pair, doc = pair[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))))
    return pair[first], doc[first], np.diff(np.append(first, len(pair)))


END_HASH = int(np.frombuffer(xxhash.xxh64_digest(END), ">i8")[0])


def gather(parts: DataFrame, one: Unigrams, hot: int) -> DataFrame:
    """local rows as they are; pairs rows of a bucket -> model, share and hot rows."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == "local":
            return table.select(NAMES).cast(SCHEMA)
        rows = table.to_pylist()
        rows.sort(key=lambda r: r["chunk"])
        bucket = rows[0]["bucket"]
        history, word = ([unlisted(r[c]) for r in rows] for c in "ab")
        sizes = [len(x) for x, _ in history]
        h, ch, w, cw = (np.concatenate([x[i] for x in side]) for side in (history, word) for i in (0, 1))
        learnt, entries = (np.concatenate([unpacked(r[c]) for r in rows]) for c in "ef")
        del history, word
        order = np.lexsort((w, h))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])))
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        top = order[new]
        c = np.bincount(of, learnt, minlength=len(top)).astype(np.int64)
        h, w, ch, cw = h[top], w[top], ch[top], cw[top]
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        group = np.cumsum(np.concatenate(([False], h[1:] != h[:-1])))
        seen = c > 0
        few = np.stack([np.bincount(group[c == r], minlength=len(lead)) for r in range(1, K + 1)], axis=1)
        many = np.bincount(group, np.where(c > K, c, 0), minlength=len(lead)).astype(np.int64)
        p_seen = np.bincount(group, np.where(seen, one.p(cw), 0.0), minlength=len(lead))
        big = ch[lead] >= hot
        none = few.sum(axis=1) == 0
        below = ch[lead] + (none & ~big)
        out = [{
            "kind": "model", "bucket": bucket, "a": listed(h[seen]), "b": listed(w[seen]), "c": packed(c[seen]),
            "d": packed(np.bincount(c[c <= K + 1], minlength=K + 2)),
        }]
        if big.any():
            out.append({"kind": "hot", "bucket": bucket, "a": packed(h[lead][big]), "b": packed(below[big]), "c": packed(few[big].reshape(-1)), "d": packed(many[big]), "x": p_seen[big].tobytes()})
        log = np.where(seen, np.log10(np.maximum(c, 1) / below[group]), 0.0)
        kind = np.where(seen & (c <= K), c, 0)
        a = 0
        for r, m in zip(rows, sizes, strict=True):
            doc, n = unpacked(r["g"]), unpacked(r["x"])
            mine = np.repeat(of[a : a + m], entries[a : a + m])
            a += m
            docs, at = np.unique(doc, return_inverse=True)
            sums = np.bincount(at, n * log[mine], minlength=len(docs))
            by = np.bincount(at * (K + 1) + kind[mine], n, minlength=len(docs) * (K + 1)).astype(np.int64).reshape(-1, K + 1)[:, 1:]
            u = np.flatnonzero(~seen[mine])
            g, who = group[mine[u]], mine[u]
            figures = np.concatenate((below[g][:, None], many[g][:, None], few[g], cw[who][:, None], n[u][:, None], doc[u][:, None], np.where(big[g], h[who], 0)[:, None], big[g][:, None]), axis=1)
            # of a dealt history only all buckets together say whether it has c(h) + 1
            may = np.flatnonzero(seen[mine] & (big & none)[group[mine]])
            out.append({
                "d": packed(doc[may]), "e": packed(h[mine[may]]), "f": packed(n[may]),
                "kind": "share", "bucket": bucket, "chunk": r["chunk"], "a": packed(docs), "b": packed(by.reshape(-1)), "c": packed(figures.T.reshape(-1)),
                "x": sums.tobytes(), "y": p_seen[g].tobytes(),
            })
        return rows_of(out)

    return parts.groupBy("bucket").applyInArrow(run, PARTS)


def finish(parts: DataFrame, one: Unigrams, two: np.ndarray, hot: dict[int, tuple]) -> DataFrame:
    """Adds up the shares of each chunk's documents. hot: (below, few, many, p_seen) by history, summed over buckets."""
    shared = parts.sparkSession.sparkContext.broadcast(hot)
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def weight(below: np.ndarray, few: np.ndarray, many: np.ndarray, p_seen: np.ndarray) -> np.ndarray:
        kept = (few * (two[1:] * np.arange(1, K + 1))).sum(axis=1) + many
        return np.log10((1 - kept / below) / (1 - p_seen))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        local = next(r for r in rows if r["kind"] == "local")
        score = np.frombuffer(local["y"]).copy()
        for r in sorted((r for r in rows if r["kind"] == "share"), key=lambda r: r["bucket"]):
            docs, by = unpacked(r["a"]), unpacked(r["b"]).reshape(-1, K)
            score[docs] += np.frombuffer(r["x"]) + by @ np.log10(two[1:])
            u = unpacked(r["c"]).reshape(K + 7, -1).T
            below, many, few, cw, n, doc, h, is_hot = u[:, 0], u[:, 1], u[:, 2 : K + 2], u[:, K + 2], u[:, K + 3], u[:, K + 4], u[:, K + 5], u[:, -1]
            p_seen = np.frombuffer(r["y"]).copy()
            below, many, few = below.copy(), many.copy(), few.copy()
            for i in np.flatnonzero(is_hot):
                below[i], few[i], many[i], p_seen[i] = shared.value[h[i]]
            d, e, f = (unpacked(r[c]) for c in "def")
            for k in np.unique(e):
                above, f0, *_ = shared.value[k]
                if not f0.any():
                    np.add.at(score, d[e == k], f[e == k] * np.log10((above - 1) / above))
            np.add.at(score, doc, n * (weight(below, few, many, p_seen) + np.log10(one.p(cw))))
        sizes = unpacked(local["a"])
        return pa.table(
            [pa.array(local["doc_ids"], pa.int64()), pa.array(local["held"]), pa.array(sizes), pa.array(unpacked(local["b"])), pa.array(np.full(len(sizes), one.total)), pa.array(np.frombuffer(local["x"])), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return parts.where("kind in ('local', 'share')").groupBy("chunk").applyInArrow(run, kinds)


def score(docs: DataFrame, hot: int = HOT, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Null and empty texts are their end alone. Rows with repeated ids count and are scored each; a row with a null id is
    held out. Without training documents every token is unknown, with probability 1. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "katz")
    chunks = scratch.put(encode(docs, chunk_tokens), "chunks")
    # one exchange: the total of each word, its first row (which stands for the word), back to its chunks
    mine = Window.partitionBy("word")
    given = vocabularies(chunks).withColumns({"total": F.sum("n").over(mine), "first": F.row_number().over(mine.orderBy("chunk")) == 1})
    given = scratch.put(given.where("first or total <> n").drop("word"), "unigrams")
    words = given.where("first and total > 0")
    sums = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    counts = {r["total"]: r["n"] for r in words.where(F.col("total") <= K + 1).groupBy("total").agg(F.count("*").alias("n")).collect()}
    one = Unigrams(sums["total"], sums["distinct"], counts)
    # a chunk's own count is the total where no row says otherwise
    back = given.where("total <> n").select("chunk", F.struct(F.col("at").cast("int").alias("at"), "total").alias("x"))
    back = back.groupBy("chunk").agg(F.collect_list("x").alias("word_counts"))
    none = F.array().cast("array<struct<at:int,total:long>>")
    counted = chunks.join(back, "chunk", "left").withColumn("word_counts", F.coalesce("word_counts", none))
    counted = scratch.put(counted, "counted")
    scratch.free("chunks")
    buckets = max(1, -(-one.total // bucket_tokens))
    rounds, parts = min(ROUNDS, buckets), None
    for turn in range(rounds):
        some = scratch.put(gather(deal(counted, one, buckets, hot, turn, rounds), one, hot), f"ngrams-{turn}", by="kind")
        parts = some if parts is None else parts.unionByName(some)
    scratch.free("counted")
    by_count = np.zeros(K + 2, np.int64)
    for r in parts.where("kind = 'model'").select("d").toLocalIterator():  # a row per bucket
        by_count += unpacked(r["d"])
    two = discounts({r: int(n) for r, n in enumerate(by_count)})
    summed: dict[int, tuple] = {}
    for r in parts.where("kind = 'hot'").toLocalIterator():  # histories of at least `hot` tokens
        few = unpacked(r["c"]).reshape(-1, K)
        for h, below, f, many, p in zip(unpacked(r["a"]).tolist(), unpacked(r["b"]).tolist(), few, unpacked(r["d"]).tolist(), np.frombuffer(r["x"]).tolist(), strict=True):
            _, f0, m0, p0 = summed.get(h, (0, 0, 0, 0.0))
            summed[h] = (below, f0 + f, m0 + many, p0 + p)
    summed = {h: (below + (not f.any()), f, many, p) for h, (below, f, many, p) in summed.items()}
    return finish(parts, one, two, summed)
