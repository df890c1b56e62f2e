import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textreuse.config import MODES
from textreuse.operators import jobs, metrics, semantic
from textreuse.plans import compare

DOCS = "doc_id long, text string, lang string, source string"
LINE = "This is paragraph number {} of a text that is long enough to be compared with others."


def docs(spark):
    rows = [(i, "\n".join(LINE.format(n) for n in ((i % 3), 7, i)), "en", "p") for i in range(5)]
    return spark.createDataFrame(rows, DOCS)


def embedding(size):
    """Made here, so that workers need not import the tests."""
    return lambda texts: semantic.hashed_grams(texts, size)


grams = embedding(64)


def test_modes(spark):
    with pytest.raises(ValueError):
        compare.compare_projects(docs(spark), MODES["fast"])
    found = compare.compare_projects(docs(spark), MODES["fast"].override(semantic=0.999), "all", embedder=grams)
    same = compare.compare_projects(docs(spark), MODES["aggressive"].override(final=0.999), "all")
    key = lambda df: sorted((r.left_document_id, r.right_document_id, r.group_count) for r in df.collect())
    assert key(found) == key(same) and sum(n for *_, n in key(same)) > 9


def test_top_k_holds_per_pair_and_left_chunk(spark):
    config = MODES["pure_semantic"].override(semantic=0.0, final=0.0, top_k=1)
    placed = compare.placed_chunks(docs(spark))
    found = compare.chunk_matches(placed, compare.text_candidates(placed, config, grams)).collect()
    got = {(r.pair_id, r.left_chunk): r.right_chunk for r in found}
    rows = placed.collect()
    unit = {r.text: v / np.linalg.norm(v) for r in rows for v in grams([r.text]).astype(float)}
    best = defaultdict(list)
    for a in rows:
        for b in rows:
            if a.doc_id < b.doc_id:
                best[f"{a.doc_id}-{b.doc_id}", a.chunk_index].append((round(float(unit[a.text] @ unit[b.text]), 9), b.chunk_index))
    assert len(found) == len(got) and got == {k: max(v)[1] for k, v in best.items()}


def test_candidates_are_ranked_before_they_are_scored(spark):
    """The nearest chunk has a low score, the next one a high score: only the nearest is a candidate, so nothing is left."""
    a, near, far = ("This is the left chunk of the pair.", "Here is the nearest chunk by vector.", "There is one that the scorer likes.")
    vectors = {a: [1.0, 0.0], near: [1.0, 0.0], far: [2.0, 1.0]}
    df = spark.createDataFrame([(1, a, "en", "p"), (2, f"{near}\n{far}", "en", "p")], DOCS)
    options = {"strategy": "all", "embedder": lambda texts: np.array([vectors[t] for t in texts]), "scorer": lambda x, y: [0.9 if far in (s, t) else 0.1 for s, t in zip(x, y, strict=True)]}
    one = compare.compare_projects(df, MODES["pure_semantic"].override(semantic=0.7, final=0.5, top_k=1), **options).collect()
    two = compare.compare_projects(df, MODES["pure_semantic"].override(semantic=0.7, final=0.5, top_k=2), **options).collect()
    assert [r.group_count for r in one] == [0] and [r.group_count for r in two] == [1]


def test_minhash_alone_has_no_semantic_score(spark):
    """Both recalls: what the vectors leave out of the top-k comes from MinHash without a semantic score."""
    config = MODES["aggressive"].override(semantic=0.5, final=0.0, top_k=1)
    placed = compare.placed_chunks(docs(spark))
    found = {(r.left_document_id, r.right_document_id, r.left_chunk, r.right_chunk): r for r in compare.chunk_matches(placed, compare.text_candidates(placed, config, grams)).collect()}
    by_vector = [r for r in found.values() if r.semantic_score is not None]
    alone = [r for r in found.values() if r.semantic_score is None]
    places = placed.count()
    assert alone and all(r.minhash_score >= 0.3 for r in alone) and any(r.minhash_score is not None for r in by_vector)
    assert len(by_vector) == len({(r.left_document_id, r.right_document_id, r.left_chunk) for r in by_vector}) <= places * 4


@pytest.mark.parametrize("cells, block", [(1, 1024), (9, 16), (40, 5)])
def test_near_places_against_brute_force(spark, cells, block):
    """All cells and block sizes give every place; with many cells most products are left out."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 12)) * 4
    rows = [("p" if d % 3 else "q", d, c, f"k{rng.integers(0, 150)}") for d in range(24) for c in range(int(rng.integers(1, 14)))]
    x = {f"k{i}": (centres[i % 9] + rng.normal(size=12) * 0.4).tolist() for i in range(150)} | {"k7": [0.0] * 12, "k8": [1.0, 2.0], "k9": [1.0] * 11 + [float("nan")]}
    placed = spark.createDataFrame(rows, "source string, doc_id long, chunk_index int, text_hash string")
    vectors = spark.createDataFrame(list(x.items()), "text_hash string, embedding array<double>")
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in x.items()}
    want = set()
    for s, a, _, left in rows:
        for b in {r[1] for r in rows if r[0] == s and r[1] > a}:
            other = sorted(((round(float(unit[left] @ unit[r[3]]), 9), r[2], r[3]) for r in rows if r[1] == b and len(unit[r[3]]) == len(unit[left]) and "k9" not in (left, r[3])), reverse=True)
            want |= {(s, left, k, b, c, v) for v, c, k in other[:3] if v >= 0.9}
    got = semantic.near_places(placed, vectors, 3, 0.9, cells=cells, block=block).collect()
    first = {}
    for s, d, _, k in rows:
        first[s, k] = min(d, first.get((s, k), d))
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want and len(want) > 100


def test_stages_and_scorer_can_be_passed_in(spark):
    seen = []

    def half(state):
        seen.append(state.candidates.columns)
        return state

    stages = (compare.minhash_recall, half, compare.score_candidates, compare.final_filter)
    config = MODES["aggressive"].override(final=0.6)
    none = compare.compare_projects(docs(spark), config, "all", scorer=lambda a, b: [0.5] * len(a), stages=stages)
    every = compare.compare_projects(docs(spark), config, "all", scorer=lambda a, b: [0.7] * len(a), stages=stages)
    assert seen and none.agg(F.sum("group_count")).first()[0] < every.agg(F.sum("group_count")).first()[0]


def test_sentences_group_to_paragraphs(spark):
    text = "The first sentence of this paragraph is long enough to count. The second one is long enough as well, and differs."
    rows = [(1, text, "en", "p"), (2, text, "en", "p"), (3, "Nothing here is alike in any way to what the others say at all.", "en", "p")]
    got = {(r.left_document_id, r.right_document_id): (r.group_count, r.aggregate_alignment) for r in compare.compare_projects(spark.createDataFrame(rows, DOCS), granularity="sentence").collect()}
    assert got[1, 2][0] == 1 and got[1, 3] == got[2, 3] == (0, 0.0)


def test_failed_embeddings_are_marked(spark):
    good = grams

    def embedder(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no service")
        return good(texts)

    df = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "bad"), ("a", "good")], "text_hash string, text string").repartition(1)
    got = {r.text_hash: (r.embedded, sum(r.embedding)) for r in semantic.embed_chunks(df, embedder, 64, batch=1).collect()}
    assert got["a"][0] and got["a"][1] > 0 and got["b"] == got["c"] == (False, 0.0)


def test_pair_ids_are_the_pairs(spark):
    pairs = spark.createDataFrame([(1, 23), (12, 3)], "left_document_id long, right_document_id long")
    assert pairs.select(jobs.pair_id().alias("x")).distinct().count() == 2


def test_stages_are_captured(spark):
    recorder = metrics.StageRecorder("run")
    config = MODES["aggressive"].override(semantic=0.99, final=0.99)
    compare.compare_projects(docs(spark), config, "all", embedder=grams, recorder=recorder).collect()
    rows = recorder.table(spark).collect()
    assert [r.stage for r in rows] == ["semantic_recall", "minhash_recall", "score_candidates", "final_filter"]
    placed = [(r.doc_id, r.text_hash) for r in compare.placed_chunks(docs(spark)).collect()]
    assert rows[0].before == sum(a[0] < b[0] for a in placed for b in placed)
    assert all(a.after == b.before for a, b in zip(rows, rows[1:], strict=False)) and rows[3].after < rows[3].before
    assert rows[2].api_calls + rows[2].cache_hits == rows[2].after and rows[2].api_calls > 0 and rows[0].run_id == "run"


def test_ranks_of_near_texts_are_those_of_all_places(spark):
    """Only documents with near texts meet their vectors, but the ranks hold among all chunks of the document."""
    rng = np.random.default_rng(5)
    rows = [("p" if d % 3 else "q", d, c, f"k{rng.integers(0, 60)}") for d in range(20) for c in range(int(rng.integers(1, 14)))]
    x = {f"k{i}": (rng.integers(0, 3, size=5) + 0.1).tolist() for i in range(60)} | {"k7": [0.0] * 5, "k8": [1.0, 2.0], "k9": [1.0] * 4 + [float("nan")]}
    placed = spark.createDataFrame(rows, "source string, doc_id long, chunk_index int, text_hash string")
    vectors = spark.createDataFrame(list(x.items()), "text_hash string, embedding array<double>")
    near = {(s, f"k{a}", f"k{b}") for s in "pq" for a, b in rng.integers(0, 60, size=(400, 2))}
    near |= {(s, b, a) for s, a, b in near} | {(s, k, k) for s in "pq" for k in x}
    got = semantic.ranked_places(placed, vectors, spark.createDataFrame(sorted(near), "source string, left string, right string"), 2, 0.9).collect()
    want = {tuple(r) for r in semantic.near_places(placed, vectors, 2, 0.9).collect() if (r.source, r.left, r.right) in near}
    assert len(got) == len(want) > 50 and {tuple(r) for r in got} == want


def test_pairs_are_made_where_they_leave(spark):
    """All pairs with the numbers of some, by blocks of three documents; no shuffle holds a row per pair."""
    docs_ = [(i, "p" if i % 4 else "q") for i in range(30)] + [(None, "p"), (31, None)]
    found = {(s, a, b): (a + b, a / 8) for a, s in docs_ for b, z in docs_ if None not in (a, b, s) and s == z and a < b and (a + b) % 5 == 0}
    rows = [(*k, *v) for k, v in found.items()]
    df = jobs.pairs_with(spark.createDataFrame(docs_, "doc_id long, source string"), spark.createDataFrame(rows, "source string, left_document_id long, right_document_id long, n long, x double"), block=3)
    got = [tuple(r) for r in df.collect()]
    want = {(s, a, b, *found.get((s, a, b), (0, 0.0))) for a, s in docs_ for b, z in docs_ if None not in (a, b, s) and s == z and a < b}
    assert len(got) == len(want) and set(got) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")  # nothing follows the blocks


def test_comparison_by_pairs_is_that_of_projects(spark):
    config = MODES["aggressive"].override(semantic=0.9, final=0.5, top_k=2)
    found = compare.compare_projects(docs(spark), config, "all", embedder=grams)
    columns = ["pair_id", "group_count", "top_score", "aggregate_alignment"]
    got = compare.compare_pairs(docs(spark), config, grams).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, found.select(*columns).collect()))


def test_hashed_grams_by_codes():
    """Grams of several planes, short, empty and missing texts; in one batch and by themselves."""
    texts = ["Abc abc", "", None, "a", "Éé", "\U0001f600\U0001f601\U0001f602 x", "\x00\x00\x00b", "İstanbul", "一二三四"]
    want = np.zeros((len(texts), 64), np.float32)
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for k in range(max(1, len(t) - 2)):
            want[i, int(hashlib.md5(t[k : k + 3].encode()).hexdigest()[:8], 16) % 64] += 1
    got = semantic.hashed_grams(texts, 64)
    assert got.dtype == np.float32 and (got == want).all() and semantic.hashed_grams([], 64).shape == (0, 64)
    assert all((semantic.hashed_grams([t], 64)[0] == w).all() for t, w in zip(texts, want, strict=True))


def test_vectors_of_texts_stand_without_their_places(spark):
    """A row per text, whatever places it has; a wrong number of vectors is a failed batch."""
    df = spark.createDataFrame([("a", "one text"), ("b", "two texts"), ("a", "one text")], "text_hash string, text string")
    got = {r.text_hash: (sum(r.embedding), r.embedded) for r in semantic.embed_texts(df, batch=1).collect()}
    assert got == {"a": (6.0, True), "b": (7.0, True)} and semantic.embed_texts(df).count() == 2
    bad = semantic.embed_texts(df, lambda texts: np.ones((len(texts) + 1, 4)), 4).collect()
    assert [(list(r.embedding), r.embedded) for r in bad] == [([0.0] * 4, False)] * 2
