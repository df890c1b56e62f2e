from pyspark.sql import functions as F

from textreuse.operators import jobs

ROWS = [(i * 7 % 90, f"p{i % 3}", ("en", "de", None)[i % 5 % 3], "pending" if i == 4 else "completed") for i in range(60)] + [(500, "alone", "en", "pending"), (501, None, "en", "pending")]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, source string, lang string, status string").repartition(3)


def test_places_stand_for_all_pairs(spark):
    pairs = jobs.document_pairs(docs(spark))
    want = {tuple(r) for r in jobs.pair_navigation(pairs.drop("project_id")).select("left_document_id", "right_document_id", "first_right", "previous_right", "next_right").collect()}
    rows = {r.document_id: r for r in jobs.pair_places(docs(spark)).collect()}
    got = set()
    for left, r in rows.items():
        right, n = r.next_document, 0
        while right is not None:
            before = rows[right].previous_document
            got.add((left, right, r.next_document, before if before != left else None, rows[right].next_document))
            right, n = rows[right].next_document, n + 1
        assert n == r.n_after
    assert got == want and len(rows) == len(ROWS) - 1 and sum(r.n_before for r in rows.values()) == len(want)
    assert [r.n for r in jobs.pair_count(docs(spark)).collect()] == [len(want)]


def test_new_and_active_pairs_by_document(spark):
    d = [(i, s, lang) for i, s, lang, _ in ROWS if lang]
    want = {(s, i, sum(x < i and s == t and k != lang for x, t, k in d), sum(x > i and s == t and k != lang for x, t, k in d)) for i, s, lang in d if s}
    assert {tuple(r) for r in jobs.new_pair_places(docs(spark), "lang").collect()} == want
    assert {tuple(r) for r in jobs.has_active_documents(docs(spark)).collect()} == {("p0", False), ("p1", True), ("p2", False)}


def test_a_large_project_makes_no_pairs(spark):
    """200,000 documents of one project have 2e10 pairs; ids repeat at the edge of ranges."""
    d = spark.range(200_000).select((F.col("id") - F.col("id") % 2).alias("doc_id"), F.lit("p").alias("source"))
    r = jobs.pair_places(d).agg(F.sum("n_after"), F.sum("n_before"), F.count("*")).first()
    assert tuple(r) == (2 * 2 * 100_000 * 99_999 // 2,) * 2 + (200_000,) and jobs.pair_count(d).first().n == 2 * 100_000 * 99_999


def test_merged_spans_go_by_ids_and_hot_sentences_by_parts(spark, tmp_path):
    """One sentence in 40 documents: all pairs are there, and no shuffle holds pairs as strings."""
    from textreuse.plans import registry

    line = "The very same sentence stands in each of these documents, word by word."
    rows = [(i, f"{line} {line}\nAnother line of document number {i} that is long enough.", "en", "p") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["merge_overlapping_spans"](spark, str(tmp_path))
    want = {(f"{a}-{b}", 0, len(line), 0, len(line)) for a in range(40) for b in range(a + 1, 40)}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Window") and "pair_id" not in plan[plan.index("Window") :]
