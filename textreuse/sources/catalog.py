"""Tables of the comparison service as partitioned parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<left_start:int,left_end:int,right_start:int,right_end:int>"
SCHEMAS = {
    "project": "id long, name string, description string, created_at timestamp, updated_at timestamp",
    "document": "doc_id long, project_id string, title string, filename string, source string, checksum string, status string, lang string, char_count int, paragraph_count int, "
    "sentence_count int, text string, storage_path string, metadata map<string,string>, error_message string, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "document_chunk": "doc_id long, chunk_type string, chunk_index int, start_pos int, end_pos int, parent_index int, text string, text_hash string",
    "chunk_embedding": "text_hash string, model string, dimension int, norm double, embedding array<float>",
    "compare_job": "job_id long, project_id string, name string, status string, config string, created_at timestamp, updated_at timestamp",
    "compare_pair": "pair_id string, job_id long, left_document_id long, right_document_id long, status string, metrics struct<group_count:long,top_score:double,aggregate_alignment:double>, started_at timestamp, completed_at timestamp",
    "match_group": f"pair_id string, left_parent int, right_parent int, final_score double, semantic_score double, cross_score double, alignment_ratio double, span_count int, match_count long, paragraph_spans array<{SPAN}>, document_spans array<{SPAN}>",
    "match_detail": f"pair_id string, left_parent int, right_parent int, left_chunk int, right_chunk int, final_score double, semantic_score double, cross_score double, spans array<{SPAN}>",
}
PARTITIONS = {"document": "project_id", "document_chunk": "chunk_type", "compare_pair": "job_id", "compare_job": "project_id"}
STATUSES = {
    "document": ("pending", "processing", "completed", "failed"),
    "compare_job": ("draft", "queued", "running", "completed", "failed"),
    "compare_pair": ("pending", "running", "completed", "failed", "skipped"),
}


class Catalog:
    """Reads and writes the tables under a root folder; missing columns are null, unknown ones are dropped."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def shaped(self, name: str, df: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], SCHEMAS[name]).schema
        out = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
        if name in STATUSES:
            known = F.col("status").isNull() | F.col("status").isin(*STATUSES[name])
            out = out.withColumn("status", F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit(f"{name}: no such status: "), F.col("status")))))
        return out

    def write(self, name: str, df: DataFrame, mode: str = "append") -> None:
        """overwrite replaces only the partitions that df has, where the table is partitioned."""
        writer = self.shaped(name, df).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        if name in PARTITIONS:
            writer = writer.partitionBy(PARTITIONS[name])
        writer.parquet(self.path(name))

    def read(self, name: str, **filters) -> DataFrame:
        self.settle(name)
        df = self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        for column, value in filters.items():
            df = df.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
        return df

    def document_chunks(self, doc_id: int, chunk_type: str | None = None) -> DataFrame:
        df = self.read("document_chunk", doc_id=doc_id)
        return (df if chunk_type is None else df.where(F.col("chunk_type") == chunk_type)).orderBy("chunk_index")

    def _paths(self, name: str):
        """File system, and paths of the table, of a new one beside it, and of the one that it replaces."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at, aside, gone = (jvm.org.apache.hadoop.fs.Path(self.path(n)) for n in (name, f"_new_{name}", f"_old_{name}"))
        return at.getFileSystem(conf), at, aside, gone

    def settle(self, name: str) -> None:
        """Ends a replacement that stopped half-way: where no table stands, the complete new one moves in, else the old one
        comes back. Every read and replacement does so first."""
        fs, at, aside, gone = self._paths(name)
        if not fs.exists(at):
            whole = fs.exists(aside.suffix("/_SUCCESS"))
            if (whole or fs.exists(gone)) and not fs.rename(aside if whole else gone, at) and not fs.exists(at):
                raise OSError(f"{name} can't be put in its place")

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes beside the table, then puts it in its place: df may read the table itself. The old table goes only after
        the new one stands; what a crash leaves is settled by the next read."""
        self.settle(name)
        fs, at, aside, gone = self._paths(name)
        writer = self.shaped(name, df).write.mode("overwrite")
        (writer.partitionBy(PARTITIONS[name]) if name in PARTITIONS else writer).parquet(aside.toString())
        fs.delete(gone, True)
        if fs.exists(at) and not fs.rename(at, gone):
            raise OSError(f"{name} can't be moved aside")
        self.settle(name)
        fs.delete(gone, True)


def write_vectors(df: DataFrame, path: str, dimension: int, mode: str = "append") -> None:
    """id, document_id, content (its first 50,000 signs), embedding, chunk_type, position; a vector of another dimension is an error."""
    fits = F.size("embedding") == dimension
    checked = F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector is not of dimension {dimension}")))
    df.select("id", "document_id", F.substring("content", 1, 50_000).alias("content"), checked.cast("array<float>").alias("embedding"), "chunk_type", "position").write.mode(mode).parquet(path)
