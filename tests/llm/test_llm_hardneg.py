import numpy as np
import pytest
from pyspark.sql import functions as F

from textreuse.llm import hardneg


def brute(rows, every, positives=5, negatives=5, low=80, high=100):
    """All pairs by Python integers. rows: id -> (label, x)."""
    out = []
    for a, (label, x) in rows.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b, other) for b, (other, y) in rows.items() if b != a and len(x) == len(y))
        for p, b, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a, b, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=600, dim=20, big=200):
    """Clusters, copies of one vector, ties, vectors of other lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * big
    rows = {}
    for i in range(n):
        x = (centres[i % 6] * (i % 3 > 0) + rng.normal(size=dim) * big).astype(int)
        if i % 5 == 0:
            x = (centres[0]).astype(int)
        if i % 50 == 7:
            x = x[: i % 3]
        rows[i] = (int(rng.integers(0, 4)) if i % 4 else 1, x.tolist())
    return rows


@pytest.mark.parametrize("seed, shard, block", [(1, 4096, 1024), (2, 30, 16), (3, 7, 3)])
def test_all_hard_negatives(spark, monkeypatch, seed, shard, block):
    monkeypatch.setattr(hardneg, "SHARD", shard)
    monkeypatch.setattr(hardneg, "BLOCK", block)
    rows = vectors(seed)
    df = spark.createDataFrame([(i, g, x) for i, (g, x) in rows.items()], "id long, label int, x array<bigint>").repartition(3)
    df = df.withColumns({"size": F.lit("s"), "part": F.lit(0), "score": F.lit(1), "rank": F.lit("r"), "anchor_id": F.lit(2), "shard": F.lit(1)})
    got = sorted(map(tuple, hardneg.mine(df, F.col("id") % 10 == 0).collect()))
    assert got == brute(rows, 10) and len({r[:2] for r in got}) > 150
    some = sorted(map(tuple, hardneg.mine(df, F.col("id") % 10 == 0, 3, 2, 50, 90).collect()))
    assert some == brute(rows, 10, 3, 2, 50, 90)


def test_large_components_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = {i: (i % 3, (rng.integers(-(2**25), 2**25, 16) + (i % 3) * 2**23).tolist()) for i in range(60)}  # scores beyond 2^53
    odd = [(None, 1, [1] * 16), (100, None, [1] * 16), (101, 1, None), (102, 1, [1] * 15 + [None]), (103, 1, [2**30] * 16), (104, 2, []), (110, 2, []), (120, 1, [])]
    odd += [(0, *rows[0]), (0, rows[0][0] + 1, rows[0][1])]  # repeated, and once more with a greater label
    df = spark.createDataFrame([(i, *r) for i, r in rows.items()] + odd, "id long, label int, x array<bigint>")
    rows |= {i: (g, x) for i, g, x in odd[5:8]}
    got = sorted(map(tuple, hardneg.mine(df, F.col("id") % 10 == 0).collect()))
    assert got == brute(rows, 10) and any(r[0] == 110 for r in got)
    assert hardneg.mine(df.limit(0), F.lit(True)).count() == 0 and hardneg.mine(df, F.lit(False)).count() == 0


def test_quantised(spark):
    rows = [(1, [0.5, -0.001]), (2, [1.0, None]), (3, [float("nan")]), (4, [float("-inf")]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert {r.id: r.x for r in df.select("id", hardneg.quantised(df).alias("x")).collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_the_index_omits_and_prunes():
    """With energy in few dimensions most postings are omitted at a high threshold; the pairs stay the same."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(500, 64)) * (1000 * 0.8 ** np.arange(64))).astype(np.int64)
    index = hardneg.Index(np.arange(500), np.zeros(500, np.int64), x)
    a = x[:40][:, index.dims]
    least = np.full(40, 2_500_000.0)
    i, j, s = index.search(a, least)
    truth = x[:40] @ x.T
    assert sorted(zip(i, j, s, strict=True)) == sorted((p, q, truth[p, q]) for p, q in zip(*np.nonzero(truth >= 2_500_000), strict=True))
    assert index.postings < 0.4 * x.size
    index.postings = 0
    assert len(index.search(a, np.full(40, -np.inf))[0]) == 40 * 500 and index.postings == x.size


def test_no_packed_vectors_go_to_the_driver(spark, tmp_path):
    """Files of vectors that repeat are small enough for a broadcast, the vectors are not."""
    rows = spark.range(300).select("id", F.lit(0).cast("long").alias("label"), F.array(*[F.lit(7).cast("long")] * 64).alias("x"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("floors"))
    hardneg.packed(rows, F.col("part")).write.parquet(f"{tmp_path}/shards")
    hardneg.packed(rows, F.col("part"), "floors").write.parquet(f"{tmp_path}/anchors")
    run = hardneg.searching(True, 5, 80, 100)
    found = hardneg.searched(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("shards", "anchors")), 1, True, run, "anchor_id long, positive_id long, vec_id long, score long")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and found.count() == 1500
