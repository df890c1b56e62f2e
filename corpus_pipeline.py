"""Corpus pipeline: quality classifier, SimHash near-dedup, substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textreuse.llm import decontam, neardup, packing, quality, substring
from textreuse.llm.common import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the best grade, each judged by its text; trained on the rated documents of the stage's own input. A null text
    is judged like an empty one."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keyed(docs: DataFrame) -> DataFrame:
    """(_row, row, text): _row orders rows by doc_id (nulls last), then text; rows equal in both have one key."""
    place = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(F.coalesce(place, F.lit("~")), F.lit(" "), F.coalesce(F.sha2("text", 256), F.lit("-")))
    return docs.select(key.alias("_row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def unkeyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): that of least id,
    one with a null id only if all ids of the group are null. Of rows with one id the one of lesser hash comes first, and
    of rows equal in id and text one stays."""
    rows = keyed(docs)
    found = neardup.near_duplicates(rows.select("_row", "text"), "_row").where("_row = component_id").select("_row").distinct()
    return unkeyed(rows.join(found, "_row", "left_semi").dropDuplicates(["_row"]), docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; rows with a null id lose nothing."""
    return substring.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any run of words of the benchmark, whatever their id: of rows with one id each is judged by its text."""
    rows = keyed(docs)
    found = decontam.report(rows.select("_row", "text"), table(spark, sf_dir, "benchmark"), id_col="_row")
    return unkeyed(rows.join(found.where("contaminated").select("_row").distinct(), "_row", "left_anti"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the pieces in sequences of 4096 tokens; every row is packed, also those with repeated or null ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("simhash", one_of_each_group),
    ("substring", cut_repeats),
    ("decontam", drop_contaminated),
    ("packing", pack),
]

#: The classifier is fitted, so SQL cannot give the rows; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, one written table after the other."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
