import numpy as np
import pytest
from pyspark.sql import functions as F

from textreuse.operators import graphsearch, semantic


def exact(x, ids, good, q, k, own=None):
    s = np.round(q @ x.T, 9)
    out = []
    for i, row in enumerate(s):
        order = [j for j in np.lexsort((ids, -row)) if good[j] and (own is None or ids[j] != own[i])][:k]
        out.append([int(ids[j]) for j in order])
    return out


@pytest.mark.parametrize("kind", ["noise", "clusters", "equal"])
def test_walk_recall_and_work(kind):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 32))
    if kind == "clusters":
        x = rng.standard_normal((40, 32))[rng.integers(0, 40, 6000)] * 3 + x
    if kind == "equal":
        x[1000:4000] = x[0]
    x = graphsearch.unit_rows(list(x))
    links = graphsearch.linked(x)
    assert max(map(len, links)) <= 2 * graphsearch.LINKS + graphsearch.LINKS // 4 + 1
    ids, q = np.arange(6000), x[:60] if kind != "equal" else x[4000:4060]
    for good in (np.ones(6000, bool), ids % 2 == 0, ids % 97 == 0, ids < 0):
        nodes, scores, looked = graphsearch.walk(x, links, good, q, 10)
        want = exact(x, ids, good, q, 10)
        if not good.any():
            assert (nodes == -1).all() and looked == 0
            continue
        # by similarity, as equal vectors may stand for each other
        least = np.array([np.round(q[i] @ x[w[-1]], 9) for i, w in enumerate(want)])
        recall = (scores >= least[:, None] - 1e-9).mean()
        assert good[nodes[nodes >= 0]].all() and recall >= 0.9, (kind, recall)
        if good.all():
            assert looked < 0.4 * 6000 * len(q)


def test_graph_search_on_spark(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    rows = [(i, x[i].tolist(), i % 3, "extra") for i in range(3000)]
    rows += [(5000, None, 0, ""), (5001, [], 0, ""), (5002, [1.0, None], 0, ""), (5003, [float("nan")] * 16, 0, ""), (5004, [0.0] * 16, 0, ""), (5005, [1.0, 2.0], 0, ""), (5006, [2.0, 4.0], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, size string").repartition(3)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/graph"
    graphsearch.build_graph(df, keep=("label",), rows=1200).write.mode("overwrite").parquet(path)
    g = spark.read.parquet(path)
    assert g.count() == 3003 and g.groupBy("size", "shard").count().where("size = 16").count() == 3
    asked = df.where("vec_id % 50 = 0 or vec_id >= 5000")
    unit, ids = graphsearch.unit_rows(list(x)), np.arange(3000)
    for where, good in ((None, np.ones(3000, bool)), (F.col("label") == 1, ids % 3 == 1)):
        got: dict[int, list] = {}
        for r in graphsearch.graph_search(asked, g, 10, where, itself=False, block=25).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        q = np.arange(0, 3000, 50)
        want = exact(unit, ids, good, unit[q], 10, q)
        assert np.mean([len(set(w) & set(got[i])) / 10 for i, w in zip(q.tolist(), want, strict=True)]) >= 0.9
        assert got[5005] == [5006] and got.get(5006, []) == ([5005] if where is None else [])
        assert len(got[5004]) == 10 and not {5000, 5001, 5002, 5003} & set(got)
    assert graphsearch.graph_search(asked.limit(0), g, 10).count() == graphsearch.graph_search(asked, g.limit(0), 10).count() == 0
    assert graphsearch.build_graph(df.limit(0)).count() == 0


def test_best_of_rows():
    """A block of rows at once: ties to the earlier column, NaN last, fewer columns than asked for."""
    rng = np.random.default_rng(1)
    for n in (1, 3, 4, 50):
        s = rng.integers(0, 6, size=(20, n)).astype(float)
        s[:, 0] = np.nan
        at, to, score = semantic.best_of_rows(s, 4)
        for r in range(20):
            want = sorted(range(n), key=lambda j: (np.isnan(s[r, j]), -s[r, j], j))[:4]
            assert to[at == r].tolist() == want and np.array_equal(score[at == r], s[r, want], equal_nan=True)
