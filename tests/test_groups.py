from pyspark.sql import functions as F

from textreuse.functions import columns as C
from textreuse.operators import align, candidates, groups, jobs, metrics, report, semantic


def matches(spark):
    rows = [(1, 1, 1, 0.90), (1, 1, 2, 0.90), (1, 2, 1, 0.95), (1, 3, 2, 0.88), (1, 3, 3, 0.80)]
    df = spark.createDataFrame(rows, "pair_id int, left_parent int, right_parent int, final_score double")
    return df.withColumns({"left_start": F.col("left_parent"), "right_start": F.col("right_parent"), "semantic_score": F.lit(None).cast("double")})


def keys(df):
    return sorted((r.left_parent, r.right_parent) for r in df.collect())


def test_strategies(spark):
    m = matches(spark)
    assert len(keys(groups.match_strategy(m, "all"))) == 5
    assert keys(groups.best_per_source(m)) == [(1, 1), (2, 1), (3, 2)]
    assert keys(groups.match_strategy(m)) == [(2, 1)]
    assert keys(groups.match_strategy(m, "bidirectional_relaxed")) == [(1, 2), (2, 1), (3, 2)]
    assert keys(groups.greedy_one_to_one(m)) == [(1, 2), (2, 1), (3, 3)]
    s = groups.filter_stats(m).first()
    assert (s.total, s.left_chunks, s.right_chunks, s.stable, s.filtered_out) == (5, 3, 3, 1, 4)


def test_greedy_follows_a_chain_to_its_end(spark):
    """l1-r1 > r1-l2 > l2-r2 > ...: one match a round, 50 of them."""
    rows = [(1, k, k, 1 - 0.01 * k) for k in range(50)] + [(1, k + 1, k, 0.995 - 0.01 * k) for k in range(49)]
    df = spark.createDataFrame(rows, "pair_id int, left_parent int, right_parent int, final_score double")
    df = df.withColumns({"left_start": F.lit(0), "right_start": F.lit(0)})
    got = groups.greedy_one_to_one(df)
    assert got.columns == df.columns and keys(got) == [(k, k) for k in range(50)]
    assert groups.greedy_one_to_one(df.limit(0)).count() == 0


def test_coverage_and_metrics(spark):
    spans = lambda *x: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(z).alias("end")) for a, z in x))
    got = spark.range(1).select(C.coverage(spans((0, 10), (10, 20), (30, 40))), C.coverage(spans((0, 5), (3, 8), (20, 30)))).first()
    assert tuple(got) == (30, 18)
    g = spark.createDataFrame([(1, 0.9, 0.45), (1, 0.8, None)], "pair_id int, final_score double, alignment_ratio double")
    p = spark.createDataFrame([(1,), (2,)], "pair_id int")
    got = {r.pair_id: (r.group_count, r.top_score, r.aggregate_alignment) for r in groups.pair_metrics(p, g).collect()}
    assert got == {1: (2, 0.9, 0.45), 2: (0, 0.0, 0.0)}


def test_span_merge(spark):
    rows = [(0, 10, 0, 10), (5, 20, 30, 45), (21, 25, 50, 54)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, left_start int, left_end int, right_start int, right_end int")
    got = sorted(tuple(r)[1:] for r in groups.merge_overlapping_spans(df, ["k"]).collect())
    assert got == [(0, 20, 0, 45), (21, 25, 50, 54)]


def test_candidate_union_and_topk(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.7)], "l int, r int, semantic_score double")
    m = spark.createDataFrame([(1, 2, 0.5), (2, 2, 0.4)], "l int, r int, minhash_score double")
    got = {(r.l, r.r): (r.rough_method, r.semantic_score, r.minhash_score) for r in candidates.merge_candidates(s, m, ["l", "r"]).collect()}
    assert got == {(1, 1): ("semantic", 0.9, None), (1, 2): ("semantic", 0.7, 0.5), (2, 2): ("minhash", None, 0.4)}
    left = spark.createDataFrame([(1, 1, [1.0, 0.0])], "p int, left_chunk int, left_vec array<double>")
    right = spark.createDataFrame([(1, 1, [0.9, (1 - 0.81) ** 0.5]), (1, 2, [0.8, 0.6])], "p int, right_chunk int, right_vec array<double>")
    assert [round(r.semantic_score, 6) for r in semantic.semantic_candidates(left, right, ["p"], 1, 0.5).collect()] == [0.9]


def test_segments(spark):
    docs = spark.createDataFrame([(1, "x" * 20)], "doc_id int, text string")
    iv = spark.createDataFrame([(1, "A", 0, 10), (1, "B", 5, 15)], "doc_id int, match_key string, start int, end int")
    got = sorted((r.start, r.end, r.matches) for r in report.highlight_segments(docs, iv).collect())
    assert got == [(0, 5, ["A"]), (5, 10, ["A", "B"]), (10, 15, ["B"]), (15, 20, [])]


def test_levels(spark):
    df = spark.createDataFrame([(x,) for x in (0.901, 0.9, 0.85, 0.8, 0.7, 0.69, None)], "s double")
    assert [r[0] for r in df.select(C.score_level(F.col("s"))).collect()] == [">.9", ">=.85", ">=.85", ">=.8", ">=.7", "else", "else"]


def test_pairs_and_deletes(spark):
    docs = spark.createDataFrame([(3, "p"), (1, "p"), (2, "p")], "doc_id int, source string")
    pairs = jobs.document_pairs(docs)
    had = spark.createDataFrame([(2, 1)], "left_document_id int, right_document_id int")
    assert sorted((r.left_document_id, r.right_document_id) for r in jobs.new_pairs(pairs, had).collect()) == [(1, 3), (2, 3)]
    left = jobs.cascade_delete({"documents": docs, "pairs": pairs.withColumn("pair_id", jobs.pair_id())}, spark.createDataFrame([(2,)], "doc_id int"))
    assert [(r.left_document_id, r.right_document_id) for r in left["pairs"].collect()] == [(1, 3)]


def test_metrics(spark):
    df = spark.createDataFrame([("r", "s", 1.0, 100, 25, 1, 3, 1), ("q", "s", 1.0, 0, 0, 1, 0, 0)], "run_id string, stage string, seconds double, before long, after long, api_calls long, cache_hits long, cache_misses long")
    got = {r.run_id: (r.reduction_rate, r.cache_hit_rate) for r in metrics.stage_metrics(df).collect()}
    assert got == {"r": (0.75, 0.75), "q": (0.0, 0.0)}


def test_align(spark):
    same = "a shared stretch of words that is long enough"
    df = spark.createDataFrame([(1, f"left side {same} end", f"{same} other")], "pair_id int, left_text string, right_text string")
    r = align.align_spans(df).first()
    # the blank after the stretch is shared as well, so both sides grow by the next word
    assert f"left side {same} end"[r.left_start : r.left_end].strip() == f"{same} end"
    assert f"{same} other"[r.right_start : r.right_end] == f"{same} other"


def test_overlaps(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 5, 15), (1, 10, 12)], "doc_id int, start int, end int")
    assert sorted((r.start, r.end) for r in report.drop_overlaps(df).collect()) == [(0, 10), (10, 12)]


def test_semantic_blocks_equal_plain_cosines(spark):
    import numpy as np

    v = np.round(np.random.default_rng(1).normal(size=(60, 4)), 1)
    rows = [("p", i, v[i // 2].tolist()) for i in range(120)]  # each vector twice: ties
    rows += [("p", 200, None), ("p", 201, []), ("p", 202, [1.0]), ("p", 203, [1.0, None, 0.0, 0.0]), ("p", 204, [float("nan"), 0.0, 0.0, 0.0]), ("p", 205, [0.0] * 4), (None, 206, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "on string, k long, v array<double>")
    left, right = (df.select("on", df.k.alias(f"{s}_chunk"), df.v.alias(f"{s}_vec")) for s in ("left", "right"))
    for block in (7, 1000):
        found = semantic.semantic_candidates(left, right, ["on"], 3, 0.5, 9, itself=False, block=block).collect()
        got = sorted((r.left_chunk, -r.semantic_score, -r.right_chunk) for r in found)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        want = []
        for i in range(120):
            near = sorted((-round(float(unit[i // 2] @ unit[j // 2]), 9), -j) for j in range(120) if j != i)
            want += [(i, s, j) for s, j in near[:3] if s <= -0.5]
        # 202 has one number and no partner of its length; the zero vector reaches no threshold above 0
        assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in sorted(want)]
        assert np.allclose([b for _, b, _ in got], [b for _, b, _ in sorted(want)])
    assert semantic.semantic_candidates(left.limit(0), right, ["on"]).count() == 0
