import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textreuse.llm import neardup, packing


def make(spark, folder):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(2000)]
    say = lambda n: " ".join(rng.choice(words, n))
    passage, item = say(60), say(30)
    texts = {i: say(80) for i in range(200)}
    labels = [(i, 1, 0) for i in range(120)]
    for i in range(20, 50):
        texts[i] += " slur insult"
        labels[i] = (i, 1, 1)
    texts[101] = texts[100]
    texts[111] = f"{texts[111]} {passage}"
    texts[112] = f"{passage} {texts[112]}"
    texts[120] = f"{texts[120]} {item}"
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(300, None, "en", "s", 0), (301, "", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"sha": F.lit("x"), "component_id": F.lit(1)})
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    texts = make(spark, d)
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        ids[name] = {r.doc_id: r for r in docs.collect()}
        assert k == 4 or docs.columns == columns
    assert not ids["quality"].keys() & set(range(20, 50)) and set(range(50, 200)) <= ids["quality"].keys()
    blank = ids["quality"].keys() & {300, 301}  # equal to the SimHash, whether the classifier takes them or not
    assert ids["quality"].keys() - ids["simhash"].keys() == {101} | set(sorted(blank)[1:])
    assert ids["substring"].keys() == ids["simhash"].keys()
    assert ids["substring"][111].text == texts[111] and ids["substring"][112].text == texts[112].split(" ", 60)[60]
    assert ids["substring"][112].n_chars == len(ids["substring"][112].text)
    assert ids["substring"].keys() - ids["decontam"].keys() == {120}
    assert ids["packing"].keys() == ids["decontam"].keys()
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).drop("sequence_id", "offset").collect()), key=str) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()), key=str)
    assert packing.CAPACITY == 4096


def jaccard(a, b):
    a, b = (set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("small", [16, 1])
def test_near_copies_of_08_or_more_go(spark, tmp_path, small):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(3000)]
    texts, links = {}, {}
    for i in range(200):
        t = rng.choice(words, 300)
        texts[i] = " ".join(t)
        for k in rng.choice(300, 1 + i % 8, replace=False):
            t[k] = "changed"
        texts[1000 + i] = " ".join(t)
        links[1000 + i] = jaccard(texts[i], texts[1000 + i])
    near = {k for k, j in links.items() if j >= 0.8}
    assert len(near) > 120 and sum(links[k] < 0.9 for k in near) > 40 and len(near) < 200
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    if small == 16:
        kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, str(tmp_path)).collect()}
    else:
        kept = {r.doc_id for r in neardup.near_duplicates(df, small=small).collect() if r.doc_id == r.component_id}
    assert kept == texts.keys() - near


def test_repeated_and_null_ids(spark, tmp_path):
    """Rows are judged by themselves: a null id or one that another row has spares nothing and condemns nothing."""
    rng = np.random.default_rng(15)
    words = [f"w{i}" for i in range(2000)]
    say = lambda n: " ".join(rng.choice(words, n))
    item, a, b = say(30), say(60), say(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, a), (5, a), (5, b), (None, f"{b} {item}"), (None, say(50)), (-3, f"{say(9)} {item}"), (7, None), (8, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit("x"), "row": F.lit(1), "component_id": F.lit("c")})
    kept = corpus_pipeline.one_of_each_group(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert sorted(map(str, (tuple(r)[:2] for r in kept.collect()))) == sorted(map(str, [(5, a), (5, b), *rows[3:7]]))
    clean = corpus_pipeline.drop_contaminated(spark, df, str(tmp_path))
    assert clean.columns == df.columns
    assert sorted(map(str, (tuple(r)[:2] for r in clean.collect()))) == sorted(map(str, [r for r in rows if item not in (r[1] or "")]))
    for stage in (corpus_pipeline.one_of_each_group, corpus_pipeline.cut_repeats, corpus_pipeline.drop_contaminated, corpus_pipeline.pack):
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_large_buckets_by_their_centres(spark):
    """Two groups of near copies of texts that are alike themselves: their buckets are shared, the groups are not.
    Most copies are nearer to their original than to each other, some of them link to it alone."""
    rng = np.random.default_rng(16)
    base = rng.choice([f"w{i}" for i in range(3000)], 400)
    other = base.copy()
    other[:70] = [f"x{i}" for i in range(70)]
    rows = [(0, " ".join(other)), (1, " ".join(base))]
    for i in range(2, 160):
        t = (base if i % 2 else other).copy()
        for k in rng.choice(400, 3 + i % 8, replace=False):
            t[k] = f"y{i}"
        rows.append((i, " ".join(t)))
    near = [(i, j) for i in range(160) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    assert len(near) < 0.45 * 160 * 159 / 2
    label = list(range(160))
    for _ in range(160):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=4).collect()}
    assert len(set(label)) > 1 and sum(got[i] != label[i] for i in range(160)) == 0


def test_two_texts_that_no_centre_links(spark):
    """Large buckets around a common passage: pairs of near copies among texts that link to nothing else are found."""
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(5000)]
    passage, rows, pairs = " ".join(rng.choice(words, 120)), [], []
    for i in range(120):
        own = list(rng.choice(words, 150))
        rows.append((i, f"{passage} {' '.join(own)}"))
        if i % 6 == 0:  # a near copy at about 0.85, whatever the centres of the passage's buckets are
            for k in rng.choice(150, 4, replace=False):
                own[k] = "changed"
            rows.append((1000 + i, f"{passage} {' '.join(own)}"))
            pairs.append((i, 1000 + i))
    texts = dict(rows)
    assert all(jaccard(texts[i], texts[j]) >= 0.8 for i, j in pairs) and jaccard(texts[1], texts[2]) < 0.5
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=2).collect()}
    assert got == {i: i % 1000 for i in texts}
