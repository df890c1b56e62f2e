"""Personal data by patterns, and what gives it away: information-theoretic sanitisation.

Patterns find mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected entity c. Words
that stand within `window` words of a mention are its context, and the corpus tells how strongly a word t reveals c:

    disclosure(c, t) = PMI(c; t) / IC(c) = log(n(c,t) n / (n(c) n(t))) / log(n / n(c))

with n documents, n(c) and n(t) of them with c and with t, and n(c,t) with t in a context of c. It is 1 where t only
occurs beside c, and falls as t occurs elsewhere. Words of at least `generalise` are generalised, those of at least
`remove` removed, in all documents. A word must stand beside c in `support` different contexts: copies of one passage
say nothing about the word.

Counts cover all documents. Contexts are a few rows per mention; the document counts of their words are summed within
tasks first, for words of contexts only, which a Bloom filter of at most 16 MB tells. The words found go to the tasks as
a sorted list while they are at most `MOST_TERMS`; beyond that a Bloom filter picks their places, and a join confirms.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, tidy

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
WINDOW, SUPPORT, GENERALISE, REMOVE = 8, 3, 0.9, 0.97
MOST_TERMS, MOST_BITS = 2_000_000, 1 << 27
SLICE = 2_000_000

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# what follows a run of digits decides, so a run is tried at its start only; that keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the local part goes back to the last sign that it can't hold, or to the match before."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain, start = DOMAIN.match(text, at + 1), at
        if domain:
            while start > last and LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, domain.end()
                last = domain.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    twice = [d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2])]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def mentions(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the patterns, ordered."""
    out = []
    if "@" in text:
        out += [(a, 0, z, text[a:z].lower()) for a, z in emails(text)]
    for m in IP.finditer(text):
        if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), m[0]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 10 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def hashed(word: str) -> int:
    h = xxhash.xxh64_intdigest(word.encode())
    return h - (1 << 64) if h >> 63 else h


def free_terms(text: str, found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, word) outside the mentions, lower-cased words."""
    out, ends = [], []
    for m in found:  # ends[i]: how far mentions up to i reach
        ends.append(max(m[2], ends[-1] if ends else 0))
    starts = [m[0] for m in found]
    for m in TERM.finditer(text):
        i = bisect.bisect_left(starts, m.end()) - 1
        if i < 0 or ends[i] <= m.start():
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def contexts_of(text: str, window: int) -> list[tuple[int, int | None, str | None, int]]:
    """(entity, term, word, context): a row without a term per entity of the text, and one per entity and word near it."""
    found = mentions(text)
    if not found:
        return []
    terms, seen = free_terms(text, found), {}
    starts = [t[0] for t in terms]
    for start, kind, _, value in found:
        entity = hashed(f"{KINDS[kind]}:{value}")
        seen.setdefault((entity, None), (None, 0))
        i = bisect.bisect_left(starts, start)
        near = [w for _, _, w in terms[max(0, i - window) : i + window]]
        context = hashed(" ".join(near))
        for w in near:
            seen.setdefault((entity, hashed(w)), (w, context))
    return [(e, t, w, c) for (e, t), (w, c) in seen.items()]


def contexts(docs: DataFrame, window: int, text_col: str = "text") -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "_t", SLICE):
                rows = [r for t in b.column("_t").to_pylist() if t for r in contexts_of(t, window)]
                e, t, w, c = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(t, pa.int64()), pa.array(w, pa.string()), pa.array(c, pa.int64())], names=["entity", "term", "word", "context"])

    return docs.select(F.col(text_col).alias("_t")).mapInArrow(run, "entity long, term long, word string, context long")


class Bloom:
    """Two bits per hash; at most MOST_BITS of them, so its size is bounded whatever it holds."""

    def __init__(self, hashes: DataFrame):
        """hashes: a column `term`, distinct."""
        n = hashes.count()
        self.bits = min(MOST_BITS, 1 << max(16, (16 * n).bit_length()))
        low = F.lit(self.bits - 1).cast("long")
        place = F.explode(F.array(F.col("term").bitwiseAND(low), F.shiftrightunsigned("term", 32).bitwiseAND(low)))
        words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        hit = np.ones(len(h), bool)
        for p in (h & np.uint64(self.bits - 1), (h >> np.uint64(32)) & np.uint64(self.bits - 1)):
            hit &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return hit


class Listed:
    """The hashes themselves, each with its level."""

    def __init__(self, terms: DataFrame):
        got = terms.select("term", "level").toArrow()
        order = np.argsort(got.column("term").to_numpy(), kind="stable")
        self.terms, self.levels = got.column("term").to_numpy()[order], got.column("level").to_numpy()[order].astype(np.int8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)

    def level(self, term: int) -> int:
        return int(self.levels[np.searchsorted(self.terms, term)])


def document_counts(docs: DataFrame, wanted: Bloom, text_col: str = "text", most: int = 400_000) -> DataFrame:
    """(term, n): documents of a task with a word that may be wanted; a task's sums come in parts of `most` words."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            h = np.fromiter(map(hashed, counts), np.int64, len(counts))
            n = np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            hit = shared.value(h)
            return pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array(n[hit])], names=["term", "n"])

        for whole in batches:
            for b in pieces(whole, "_t", SLICE):
                for t in b.column("_t").to_pylist():
                    if t:
                        counts.update({w.lower() for w in set(TERM.findall(t))})
                if len(counts) > most:
                    yield out()
        yield out()

    return docs.select(F.col(text_col).alias("_t")).mapInArrow(run, "term long, n long")


def disclosing(docs: DataFrame, scratch: Scratch, text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, word, entity, disclosure, level): each word that reveals an entity, with the entity that it reveals most
    (ties: the smaller hash) and level 4 (generalise) or 5 (remove)."""
    n = docs.count()
    near = scratch.put(contexts(docs, window, text_col), "contexts")
    entities = near.where("term is null").groupBy("entity").agg(F.count("*").alias("of_entity"))
    pairs = near.where("term is not null").groupBy("entity", "term", "context").agg(F.count("*").alias("n"), F.min("word").alias("word"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts"), F.min("word").alias("word"))
    pairs = scratch.put(pairs.where(F.col("contexts") >= support), "pairs")
    counts = document_counts(docs, Bloom(pairs.select("term").distinct()), text_col).groupBy("term").agg(F.sum("n").alias("of_term"))
    held = F.log(F.col("both") * n / (F.col("of_entity") * F.col("of_term"))) / F.log(F.lit(n) / F.col("of_entity"))
    found = pairs.join(entities, "entity").where(F.col("of_entity") < n).join(counts, "term").select("term", "word", "entity", held.alias("disclosure")).where(F.col("disclosure") >= generalise)
    most = F.max_by(F.struct("word", "entity", "disclosure"), F.struct("disclosure", -F.col("entity"))).alias("m")
    found = found.groupBy("term").agg(most).select("term", "m.*").withColumn("level", F.when(F.col("disclosure") >= remove, 5).otherwise(4))
    return scratch.put(found, "terms")


def places(docs: DataFrame, terms: Listed | Bloom, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """(id, base, extra): spans (start, kind, end) of the patterns, and of the terms with their hash (kind null for a Bloom
    filter, which only knows what may be one); with keep the text too."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    extra_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("term", pa.int64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, known = shared.value, {}
        for whole in batches:
            for b in pieces(whole, "_t", SLICE):
                texts = [t or "" for t in b.column("_t").to_pylist()]
                words = [set(TERM.findall(t)) for t in texts]
                new = sorted({w for ws in words for w in ws if w not in known})
                h = np.fromiter((hashed(w.lower()) for w in new), np.int64, len(new))
                if len(known) > 300_000:
                    known = {}
                    new = sorted(set().union(*words))
                    h = np.fromiter((hashed(w.lower()) for w in new), np.int64, len(new))
                known |= {w: x if hit else None for w, x, hit in zip(new, h.tolist(), listed(h).tolist(), strict=True)}
                base, extra = [], []
                for t, ws in zip(texts, words, strict=True):
                    found = mentions(t)
                    base.append([{"start": a, "kind": k, "end": z} for a, k, z, _ in found])
                    mine = {known[w] for w in ws} - {None}
                    spans = []
                    if mine:
                        for a, z, w in free_terms(t, found):
                            x = known[t[a:z]]
                            if x is not None:
                                spans.append({"start": a, "kind": listed.level(x) if isinstance(listed, Listed) else None, "end": z, "term": x})
                    extra.append(spans)
                yield pa.RecordBatch.from_arrays([b.column("_i"), pa.array(base, base_type), pa.array(extra, extra_type), *([b.column("_t")] if keep else [])], names=[id_col, "base", "extra", *(["text"] if keep else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    span = "struct<start: int, kind: int, end: int>"
    schema = f"`{id_col}` {kind}, base array<{span}>, extra array<struct<start: int, kind: int, end: int, term: bigint>>" + ", text string" * keep
    return docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).mapInArrow(run, schema)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_terms: int = MOST_TERMS, keep: bool = False, **limits) -> DataFrame:
    """(id, base, all): per row the spans (start, kind, end; kind by KINDS) of the patterns, and these with the words
    that give them away, by start, then kind. Offsets are code points, the end is exclusive; words never overlap patterns.

    A null text is empty and has none. Rows are judged one by one, also those that share an id or have none; repeated
    rows count as documents of their own. Texts are read whole. Other columns are ignored. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    terms = disclosing(docs, scratch, text_col, **limits)
    both = lambda extra: F.array_sort(F.concat("base", extra)).alias("all")
    plain = F.transform("extra", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    texts = ["text"] * keep
    if terms.count() <= most_terms:
        return places(docs, Listed(terms), id_col, text_col, keep).select(id_col, "base", both(plain), *texts)
    rows = places(docs, Bloom(terms.select("term")), id_col, text_col, keep).withColumn("_row", F.monotonically_increasing_id())
    rows = scratch.put(rows, "places")  # written, so that _row stays the same
    may = rows.select("_row", F.explode("extra").alias("s")).select("_row", "s.start", "s.end", "s.term")
    sure = may.join(terms.select("term", "level"), "term").groupBy("_row").agg(F.collect_list(F.struct("start", F.col("level").cast("int").alias("kind"), "end")).alias("sure"))
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    return rows.join(sure, "_row", "left").select(id_col, "base", both(F.coalesce("sure", none)), *texts)


def joined(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row; see `spans`."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans(docs, id_col, **options).select(id_col, *map(count, range(4)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, text): patterns and generalised words become their kind in brackets, a capital word [Name], another [word];
    removed words go. Of overlapping spans what is not yet replaced goes with the later one. Null texts come back empty."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, found in zip(b.column("text").to_pylist(), b.column("all").to_pylist(), strict=True):
                parts, last = [], 0
                for s in found:
                    word = (t or "")[s["start"] : s["end"]]
                    shown = {4: "[Name]" if word[:1].isupper() else "[word]", 5: ""}.get(s["kind"], f"[{KINDS[s['kind']]}]")
                    if s["end"] > last:
                        parts += [(t or "")[last : max(last, s["start"])], shown]
                        last = s["end"]
                out.append("".join(parts) + (t or "")[last:])
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(out, pa.string())], names=[id_col, "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spans(docs, id_col, keep=True, **options).select(id_col, "all", "text").mapInArrow(run, f"`{id_col}` {kind}, text string")
