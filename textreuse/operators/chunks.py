"""Paragraph and sentence chunks with exact offsets, and the paragraph of each sentence.

The rules are sequential within a line, so both splitters are one Arrow pass over the texts each, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textreuse.functions.columns import language_class

SENTENCE = re.compile(r"[^.!?。！？；]*[.!?。！？；]|[^.!?。！？；]+")
NUMBERED = re.compile(r"(?:[^.!?。！？；]|(?<=[0-9])\.(?=.))*(?:(?<![0-9])\.|(?<=[0-9])\.\Z|[!?。！？；])|(?:[^.!?。！？；]|(?<=[0-9])\.(?=.))+")


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    left = len(part) - len(part.lstrip())
    return start + left, start + max(left, len(part.rstrip()))


def cut_point(text: str, english: bool) -> int:
    """Where a long paragraph is cut: after the sign nearest its middle, else at a blank before it, else there."""
    middle = len(text) // 2
    for sign in (". ", "; ") if english else ("。", "；"):
        ends = [m.end() for m in re.finditer(re.escape(sign), text)]
        if ends:
            return min(ends, key=lambda e: abs(e - middle))
    blank = text.rfind(" ", 0, middle) if english else 0
    return blank + 1 if blank > 0 else middle


def paragraph_spans(text: str, english: bool, least: int = 20, most: int = 600, strict: bool = False) -> Iterator[tuple[int, int]]:
    """Lines of at least `least` signs; longer ones than `most` are cut. The left part of a cut is taken as it is, so it
    can be longer than `most`; strict cuts it again."""
    at = 0
    for line in text.split("\n"):
        a, z = trimmed(text, at, at + len(line))
        at += len(line) + 1
        todo = [(a, z)] if z - a >= least else []
        while todo:
            a, z = todo.pop()
            if z - a > most:
                middle = a + cut_point(text[a:z], english)
                left, right = trimmed(text, a, middle), trimmed(text, middle, z)
                todo.append(right)
                if strict and left[1] - left[0] > most:
                    todo.append(left)
                    continue
                a, z = left
            if z - a >= least:
                yield a, z


def sentence_spans(text: str, english: bool, least: int = 20, protect_numbers: bool = False, merge_short: bool = False) -> Iterator[tuple[int, int]]:
    """Sentences of each line by their end signs; short ones are left out.

    protect_numbers: a point after a digit ends no sentence. merge_short: a sentence of under four words (signs, where
    there are no blanks) joins the one before, but for the first, the last, and exclamations and questions.
    """
    least, at = max(least, 40 if english else 20), 0
    for line in text.split("\n"):
        a, z = trimmed(text, at, at + len(line))
        at += len(line) + 1
        found = [(a + m.start(), a + m.end()) for m in (NUMBERED if protect_numbers else SENTENCE).finditer(text[a:z])]
        if merge_short:
            joined: list[tuple[int, int]] = []
            for i, (x, y) in enumerate(found):
                part = text[x:y]
                size = len(part.split()) if " " in part.strip() else len(re.findall(r"[㐀-鿿]|[^\s㐀-鿿]+", part))
                if joined and size < 4 and i + 1 < len(found) and not re.search("[！？]", part):
                    joined[-1] = (joined[-1][0], y)
                else:
                    joined.append((x, y))
            found = joined
        for x, y in found:
            x, y = trimmed(text, x, y)
            if y - x >= least:
                yield x, y


def parent_of(paragraphs: list[tuple[int, int]], start: int, end: int, fallback: str = "start") -> int | None:
    """Which of the paragraphs, in order and without overlap, holds the sentence; else the nearest by start or centre."""
    at = bisect_right(paragraphs, start, key=lambda p: p[0]) - 1
    if at >= 0 and end <= paragraphs[at][1]:
        return at
    place = (lambda p: p[0]) if fallback == "start" else sum
    wanted = place((start, end))
    after = bisect_left(paragraphs, wanted, key=place)
    near = [i for i in (after - 1, after) if 0 <= i < len(paragraphs)]
    return min(near, key=lambda i: abs(place(paragraphs[i]) - wanted), default=None)


def parented_spans(text: str, english: bool, fallback: str, sentences, paragraphs) -> Iterator[tuple[int, ...]]:
    """Sentences with their paragraph's number, start and length."""
    own = list(paragraphs(text, english))
    for n, (a, z) in enumerate(sentences(text, english)):
        p = parent_of(own, a, z, fallback)
        if p is None:
            yield a, z, None if fallback == "start" else n, None, None
        else:
            yield a, z, p, own[p][0], own[p][1] - own[p][0]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what a worker holds at once does not grow with Spark's batches."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _split(docs: DataFrame, id_col: str, lang: Column, kind: str, spans, keep: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """keep: columns of docs that go along; more: names of the numbers that spans gives after start and end."""
    ints = ["chunk_index", "start_pos", "end_pos", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            who, rows = [], []
            for i, (text, english) in enumerate(zip(b.column("text").to_pylist(), b.column("english").to_pylist(), strict=True)):
                for n, (a, z, *rest) in enumerate(spans(text or "", english)):
                    who.append(i)
                    rows.append((n, a, z, *rest, text[a:z]))
            columns = list(zip(*rows, strict=True)) or [[]] * (len(ints) + 1)
            kinds = [pa.int32()] * len(ints) + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(who, pa.int64())) for c in (id_col, *keep)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[id_col, *keep, *ints, "text"],
            )

    carried = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    rows = docs.select(id_col, *keep, "text", (language_class(lang) == "en").alias("english"))
    rows = rows.mapInArrow(run, f"{carried}, {', '.join(f'{c} int' for c in ints)}, text string")
    return rows.withColumns({"chunk_type": F.lit(kind), "text_hash": F.sha2("text", 256)})


def split_paragraphs(docs: DataFrame, min_length: int = 20, max_chars: int = 600, id_col: str = "doc_id", strict_max: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, chunk_index, start_pos, end_pos, text, chunk_type, text_hash); docs have text and lang."""
    return _split(docs, id_col, F.col("lang"), "paragraph", lambda t, e: paragraph_spans(t, e, min_length, max_chars, strict_max), keep)


def split_sentences(docs: DataFrame, min_length: int = 20, id_col: str = "doc_id", protect_numbers: bool = False, merge_short: bool = False) -> DataFrame:
    return _split(docs, id_col, F.col("lang"), "sentence", lambda t, e: sentence_spans(t, e, min_length, protect_numbers, merge_short))


def sentences_in_paragraphs(docs: DataFrame, fallback: str = "start", min_length: int = 20, max_chars: int = 600, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The sentences with parent_index, parent_start and parent_length, by the rules of `assign_parents`.

    Both kinds of chunks come from one text, so the paragraph is found in the pass that cuts it, without a join."""
    sentences, paragraphs = lambda t, e: sentence_spans(t, e, min_length), lambda t, e: paragraph_spans(t, e, min_length, max_chars)
    spans = lambda t, e: parented_spans(t, e, fallback, sentences, paragraphs)
    return _split(docs, id_col, F.col("lang"), "sentence", spans, keep, ("parent_index", "parent_start", "parent_length"))


def with_sentence_index(paragraphs: DataFrame, sentences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Both kinds in one table; sentence numbers follow the paragraphs'."""
    n = paragraphs.groupBy(id_col).agg(F.count("*").cast("int").alias("_n"))
    after = sentences.join(n, id_col, "left").withColumn("chunk_index", F.col("chunk_index") + F.coalesce("_n", F.lit(0))).drop("_n")
    return paragraphs.unionByName(after)


def assign_parents(paragraphs: DataFrame, sentences: DataFrame, fallback: str = "start", id_col: str = "doc_id") -> DataFrame:
    """Adds parent_index: the paragraph that holds the sentence; else the nearest one, by start or by centre; ties go to
    the earlier. Documents without paragraphs: null, or with fallback centre the sentence's own index.

    For chunks that are tables already; the paragraphs of a document do not overlap. Paragraphs know the one after them, and
    a row before all knows the first; so a sentence looks back only, in one order per document (by centre in two): one
    shuffle and one sort of the sentences, linear.
    """
    place = lambda a, z: a if fallback == "start" else a + z
    at = lambda kind: (F.col("start_pos").alias("_start"), place(F.col("start_pos"), F.col("end_pos")).alias("_place"), F.lit(kind).alias("_kind"))
    own = F.struct(F.col("start_pos").alias("a"), F.col("end_pos").alias("z"), F.col("chunk_index").alias("n"))
    known = paragraphs.select(F.col(id_col).alias("_id"), *at(0), own.alias("_own"))
    after = F.lead("_own").over(Window.partitionBy("_id").orderBy("_start"))
    rows = known.withColumn("_p", F.struct(F.col("_own").alias("own"), after.alias("next"))).drop("_own")
    before = known.groupBy("_id").agg(F.min("_own").alias("_f")).select("_id", *(F.lit(-1).alias(c) for c in ("_start", "_place", "_kind")), F.struct(F.lit(None).cast(known.schema["_own"].dataType).alias("own"), F.col("_f").alias("next")).alias("_p"))
    rows = rows.unionByName(before).unionByName(sentences.select(F.col(id_col).alias("_id"), *at(1), F.struct(*sentences.columns).alias("_s")), allowMissingColumns=True)
    last = lambda *order: F.last("_p", ignorenulls=True).over(Window.partitionBy("_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_held", last("_start", "_kind"))
    rows = rows.withColumn("_met", F.col("_held") if fallback == "start" else last("_place", "_kind"))
    far = lambda p: F.abs(place(p["a"], p["z"]) - F.col("_place"))
    held, low, high = F.col("_held")["own"], F.col("_met")["own"], F.col("_met")["next"]
    nearest = F.when(high.isNull() | (far(low) <= far(high)), low["n"]).otherwise(high["n"])
    found = F.when((held["a"] <= F.col("_s")["start_pos"]) & (held["z"] >= F.col("_s")["end_pos"]), held["n"]).otherwise(nearest)
    out = rows.where("_kind = 1").select("_s.*", found.alias("parent_index"))
    return out if fallback == "start" else out.withColumn("parent_index", F.coalesce("parent_index", "chunk_index"))


def preset_parents(sentences: DataFrame, paragraphs: DataFrame, preset: str, id_col: str = "doc_id") -> DataFrame:
    """parent_index from the preset column where that is a paragraph of the document, else as it stands."""
    known = paragraphs.select(id_col, F.col("chunk_index").alias(preset), F.lit(True).alias("_known")).distinct()
    out = sentences.join(known, [id_col, preset], "left")
    return out.withColumn("parent_index", F.when(F.col("_known"), F.col(preset)).otherwise(F.col("parent_index"))).drop("_known")


def document_counts(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Paragraphs, sentences and mean length (integer division) per document."""
    size = F.col("end_pos") - F.col("start_pos")
    return chunks.groupBy(id_col).agg(
        F.count_if(F.col("chunk_type") == "paragraph").alias("paragraph_count"),
        F.count_if(F.col("chunk_type") == "sentence").alias("sentence_count"),
        F.floor(F.sum(size) / F.count("*")).cast("long").alias("avg_length"),
    )


def document_types(chunks: DataFrame, wanted: str = "paragraph") -> DataFrame:
    """(document, chunk_type): the wanted type where the document has it, or the other."""
    have = chunks.groupBy(F.col("doc_id").alias("document")).agg(
        F.max(F.col("chunk_type") == "paragraph").alias("paragraph"), F.max(F.col("chunk_type") == "sentence").alias("sentence")
    )
    other = "sentence" if wanted == "paragraph" else "paragraph"
    return have.select("document", F.when(F.col(wanted), wanted).when(F.col(other), other).alias("chunk_type"))


def select_granularity(chunks: DataFrame, pairs: DataFrame, wanted: str = "paragraph") -> DataFrame:
    """(pair_id, side, document, chunk_type): the wanted type if both sides have it, else each side's own: the wanted
    one where it has it, or the other."""
    sides = pairs.select("pair_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_document_id").alias("document")) for s in ("left", "right")))).alias("x"))
    return sides.select("pair_id", "x.side", "x.document").join(document_types(chunks, wanted), "document", "left").select("pair_id", "side", "document", "chunk_type")


def text_positions(lines: DataFrame, id_col: str, order: str) -> DataFrame:
    """Running offset of each line in its document: the lengths before it, and their line ends."""
    before = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
