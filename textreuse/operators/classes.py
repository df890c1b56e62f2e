"""Equal texts of a project as classes: what would be pairs of places, counted and not expanded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_document(chunks: DataFrame, within: str) -> DataFrame:
    chunks = chunks.where(F.col(within).isNotNull() & F.col("doc_id").isNotNull() & F.col("text_hash").isNotNull())
    return chunks.groupBy(within, "text_hash", "doc_id").agg(F.count("*").alias("n"))


def text_classes(chunks: DataFrame, within: str = "source") -> DataFrame:
    """(within, text_hash, places, documents, links) of texts that stand in two documents or more. links: pairs of places in
    different documents, counted from places per document, so a text of a hundred thousand documents costs as many rows.

    chunks: within, doc_id, text_hash. Rows with a null among these are in no class.
    """
    per = _per_document(chunks, within)
    n = F.col("n").cast("decimal(38,0)")  # squares of places can exceed a long's half
    found = per.groupBy(within, "text_hash").agg(F.sum("n").alias("places"), F.count("*").alias("documents"), ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).cast("long").alias("links"))
    return found.where("documents > 1")


def members(chunks: DataFrame, classes: DataFrame, within: str = "source") -> DataFrame:
    """The chunks of the classes, each with the class's first place: representative_document and representative_chunk. A
    representative beside its members stands for all pairs of a class."""
    mine = chunks.where(F.col("doc_id").isNotNull()).join(classes.select(within, "text_hash"), [within, "text_hash"], "left_semi")
    first = mine.groupBy(within, "text_hash").agg(F.min(F.struct("doc_id", "chunk_index")).alias("_f"))
    return mine.join(first, [within, "text_hash"]).select(*mine.columns, F.col("_f.doc_id").alias("representative_document"), F.col("_f.chunk_index").alias("representative_chunk"))


def document_links(chunks: DataFrame, classes: DataFrame, within: str = "source") -> DataFrame:
    """(within, doc_id, classes, links): of each document with text of a class, how many classes it is in and how many pairs
    of a place of its own and one of another document they give."""
    per = _per_document(chunks, within).join(classes, [within, "text_hash"])
    return per.groupBy(within, "doc_id").agg(F.count("*").alias("classes"), F.sum(F.col("n") * (F.col("places") - F.col("n"))).alias("links"))
