from collections import Counter
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from textreuse.operators import classes
from textreuse.streaming import progress


def test_classes_count_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [("p" if d % 3 else "q", int(d), c, f"t{rng.integers(0, 9)}") for d in range(20) for c in range(int(rng.integers(0, 6)))] + [(None, 1, 0, "t0"), ("p", None, 0, "t0"), ("p", 1, 9, None)]
    df = spark.createDataFrame(rows, "source string, doc_id long, chunk_index int, text_hash string")
    found = classes.text_classes(df)
    full = [r for r in rows if None not in r]
    pairs = Counter((s, t) for s, d, _, t in full for s2, d2, _, t2 in full if (s, t) == (s2, t2) and d < d2)
    assert {(r.source, r.text_hash): r.links for r in found.collect()} == dict(pairs)
    each = Counter((s, d) for s, d, _, t in full for s2, d2, _, t2 in full if (s, t) == (s2, t2) and d != d2)
    assert {(r.source, r.doc_id): r.links for r in classes.document_links(df, found).collect()} == dict(each)
    assert classes.members(df, found).where("representative_document > doc_id").count() == 0
    assert classes.text_classes(df.limit(0)).count() == 0


def test_a_line_of_100_000_documents(spark):
    df = spark.range(100_000).select(F.lit("p").alias("source"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("line").alias("text_hash"))
    assert [tuple(r) for r in classes.text_classes(df).collect()] == [("p", "line", 100_000, 100_000, 100_000 * 99_999 // 2)]
    assert classes.members(df, classes.text_classes(df)).count() == 100_000


def test_progress_ends(spark, tmp_path):
    """Rates, late events, heartbeats, and state that is empty in the end."""
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    schema = "task_id string, ts timestamp, status string, step long, total long, message string"
    batches = [
        [("a", at(0), "running", 0, 10, "go"), ("a", at(20), None, 4, None, None), ("b", at(5), "running", None, None, None)],
        [("a", at(10), None, 1, None, "late"), ("a", at(40), "completed", 10, None, "done"), ("z", at(7200), "running", None, None, None)],
        [("b", at(6), "failed", None, None, "too late"), ("z", at(200_000), "completed", None, None, None)],
        [("y", at(900_000), "completed", None, None, None)],
        [("x", at(2_000_000), "failed", None, None, None)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    files = sorted((tmp_path / "in").glob("*/part-*"))
    source = tmp_path / "stream"
    source.mkdir()
    seen, held = [], []

    def sink(df, number):
        seen.extend(r.asDict() for r in df.collect())

    for f in files:  # one file a run, so that batches are as planned
        (source / f"{f.parent.name}.parquet").write_bytes(f.read_bytes())
        events = spark.readStream.schema(schema).parquet(str(source))
        q = progress.track(events, "1 minute", quiet_seconds=3600).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None)
    a = [r for r in seen if r["task_id"] == "a"]
    assert (a[0]["percent"], a[0]["per_second"], a[0]["seconds_left"], a[0]["status"]) == (40.0, 0.2, 30.0, "running")
    assert (a[1]["step"], a[1]["status"], a[1]["message"], a[1]["seconds_left"]) == (10, "completed", "done", None)
    assert [r["event"] for r in a] == ["progress", "progress", "removed"]
    assert "heartbeat" in {r["event"] for r in seen if r["task_id"] == "b"} and not any(r["status"] == "failed" for r in seen if r["task_id"] == "b")
    assert [r["event"] for r in seen if r["task_id"] == "z"].count("removed") == 1
    assert held[-1] <= 3  # b is unfinished, x and perhaps y are new
