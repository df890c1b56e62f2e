"""Match reports, highlight intervals and segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def match_report(pairs: DataFrame, docs: DataFrame, groups: DataFrame, details: DataFrame) -> DataFrame:
    """Pair, both documents (null where they are gone), and each group with its details under it."""
    under = details.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in details.columns if c not in ("group_id", "pair_id"))))).alias("details"))
    out = pairs.join(groups, "pair_id", "left").join(under, "group_id", "left")
    for s in ("left", "right"):
        mine = docs.select(F.col("doc_id").alias(f"{s}_document_id"), F.struct(*(c for c in docs.columns if c != "text")).alias(f"{s}_document"))
        out = out.join(mine, f"{s}_document_id", "left")
    return out


def highlight_intervals(groups: DataFrame, side: str, key: list[str], threshold: float = 0.75) -> DataFrame:
    """(key, mode, start, end, ordinal): a block per match, and where less than `threshold` is aligned its distinct
    fragments after it. groups: key, spans (array of struct), alignment_ratio."""
    spans = groups.select(*key, "alignment_ratio", F.explode("spans").alias("s")).select(*key, "alignment_ratio", F.col(f"s.{side}_start").alias("start"), F.col(f"s.{side}_end").alias("end"))
    spans = spans.where("start >= 0 and end > start")
    block = spans.groupBy(*key).agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumns({"mode": F.lit("block"), "ordinal": F.lit(0)})
    order = Window.partitionBy(*key).orderBy("start", "end")
    fragments = spans.where(F.coalesce("alignment_ratio", F.lit(0.0)) < threshold).select(*key, "start", "end").distinct()
    fragments = fragments.withColumns({"mode": F.lit("fragment"), "ordinal": F.row_number().over(order)})
    return block.unionByName(fragments)


def highlight_segments(docs: DataFrame, intervals: DataFrame, id_col: str = "doc_id", match: str = "match_key", overlap: str = "all", beyond: str = "cut") -> DataFrame:
    """(id, start, end, text, matches): the text cut at every boundary, with the matches active there, in the order of
    their intervals (the first is primary). Intervals: id, match, start, end.

    overlap: all, or first: an interval that overlaps one before it is left out. beyond: what lies beyond the text is cut
    off, or with split a segment of its own without text, or with whole one segment with what lies before it."""
    if overlap == "first":
        intervals = drop_overlaps(intervals, id_col)
    cuts, active = _active(docs, intervals, id_col, [match], beyond)
    active = active.groupBy(id_col, "_i").agg(F.array_sort(F.collect_list(F.struct("_s", "_e", match))).alias("_m"))
    out = cuts.where("end is not null").join(active, [id_col, "_i"], "left").join(docs.select(id_col, "text"), id_col)
    found = F.coalesce(F.transform("_m", lambda m: m[match]), F.array().cast(f"array<{intervals.schema[match].dataType.simpleString()}>"))
    return out.select(id_col, "start", "end", F.expr("substring(text, start + 1, end - start)").alias("text"), found.alias("matches"))


def counted_segments(docs: DataFrame, intervals: DataFrame, id_col: str = "doc_id", match: str = "match_key", beyond: str = "cut") -> DataFrame:
    """(id, start, end, text, active, match): the same with the number of matches active there and the primary one, or null.
    Intervals: id, match, start, end, n: the least of the n matches that have this interval. beyond: as of highlight_segments."""
    cuts, active = _active(docs, intervals, id_col, [match, "n"], beyond)
    active = active.groupBy(id_col, "_i").agg(F.sum("n").alias("active"), F.min_by(match, F.struct("_s", "_e", match)).alias(match))
    out = cuts.where("end is not null").join(active, [id_col, "_i"], "left").join(docs.select(id_col, "text"), id_col)
    return out.select(id_col, "start", "end", F.expr("substring(text, start + 1, end - start)").alias("text"), F.coalesce("active", F.lit(0)).alias("active"), match)


def _active(docs: DataFrame, intervals: DataFrame, id_col: str, carried: list[str], beyond: str) -> tuple[DataFrame, DataFrame]:
    """Cuts (id, start, end, _i), and which intervals (_s, _e, carried) are active in which."""
    size = docs.select(id_col, F.length("text").alias("_n")).where("_n is not null")
    clean = intervals.where("end > start").join(size, id_col)
    a, z = (F.least("start", "_n"), F.least("end", "_n")) if beyond == "cut" else (F.col("start"), F.col("end"))
    clean = clean.select(id_col, *carried, F.col("start").alias("_s"), F.col("end").alias("_e"), a.alias("_a"), z.alias("_z")).where("_a < _z")
    ends = clean.select(id_col, F.explode(F.array("_a", "_z")).alias("start"))
    if beyond == "whole":
        size = size.join(clean.groupBy(id_col).agg(F.max("_z").alias("_last")), id_col, "left").withColumn("_n", F.greatest("_n", "_last"))
    cuts = ends.unionByName(size.select(id_col, F.explode(F.array(F.lit(0), "_n")).alias("start"))).distinct()
    order = Window.partitionBy(id_col).orderBy("start")
    cuts = cuts.withColumns({"_i": F.row_number().over(order), "end": F.lead("start").over(order)})
    # the numbers of the cuts say which segments an interval covers, so each is met once
    for at, number in (("_a", "_from"), ("_z", "_to")):
        clean = clean.join(cuts.select(id_col, F.col("start").alias(at), F.col("_i").alias(number)), [id_col, at])
    return cuts, clean.select(id_col, "_s", "_e", *carried, F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_i"))


def drop_overlaps(intervals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Greedy by start: an interval stays if it begins at or after the end of the last that stayed. Sequential within a
    document, so one task takes a document's intervals, in one sorted pass over all of its documents: a worker holds a batch."""
    rest = [c for c in intervals.columns if c not in (key, "start", "end")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, None
        for b in batches:
            keep = []
            for k, a, z in zip(*(b.column(c).to_pylist() for c in (key, "start", "end")), strict=True):
                stays = end is None or k != last or a >= end
                last, end = k, z if stays else end
                keep.append(stays)
            yield b.filter(pa.array(keep, pa.bool_()))

    placed = intervals.repartition(key).sortWithinPartitions(key, "start", "end", *rest)
    return placed.mapInArrow(run, intervals.schema)
