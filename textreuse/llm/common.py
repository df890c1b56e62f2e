"""What the operators share: the folder that driver and executors share, written intermediate tables, batch helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a job at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set on a single machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage: a lost executor costs no more than the stage it ran."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path, self.names = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", set()

    def put(self, df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
        """Writes the table. Its shuffle files are of no use afterwards, so they go with the job."""
        writer, conf = df.write.option("compression", "zstd"), self.spark.conf
        before = conf.get(CLEAN_UP, "false")
        conf.set(CLEAN_UP, "true")
        try:
            (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        finally:
            conf.set(CLEAN_UP, before)
        self.names.add(name)
        return self.get(name, df)

    def free(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def only(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.free(*(self.names - set(names)))

    def get(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(like.schema) if like is not None else reader).parquet(f"{self.path}/{name}")


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def pieces(batch: pa.RecordBatch, name: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, so that what is built from one stays small."""
    size = batch.column(name).cast(pa.large_string()).nbytes
    step = max(1, int(batch.num_rows * most / max(size, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def sliced(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from pieces(b, name, most)


def stored(uri: str, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of a written table, read within a task; for tables that every task passes over in blocks."""
    store, place = fs.FileSystem.from_uri(uri)
    yield from ds.dataset(place, filesystem=store, format="parquet").to_batches(batch_size=rows, batch_readahead=0, fragment_readahead=0, use_threads=False)


def give_back() -> None:
    """Memory that Python and Arrow hold but do not use goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a worker keeps from task to task, by the name of the pass that keeps it.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def drop_kept(but: str | None = None) -> None:
    for name in [x for x in _kept if x != but]:
        del _kept[name]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass that gives its memory back at the end of the task, as a worker lives for many tasks. What passes of another
    name have kept goes at its start."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
