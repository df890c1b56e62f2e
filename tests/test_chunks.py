import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textreuse.operators import chunks as K


def spans(f, text, *a, **k):
    return [(x, z) for x, z in f(text, *a, **k)]


def test_paragraph_bounds():
    assert spans(K.paragraph_spans, "  " + "x" * 19, True) == []
    assert spans(K.paragraph_spans, "  " + "x" * 20 + " ", True) == [(2, 22)]


def test_long_paragraphs():
    assert [z - a for a, z in K.paragraph_spans("x" * 1400, True)] == [700, 350, 350]
    assert all(z - a <= 600 for a, z in K.paragraph_spans("x" * 1400, True, strict=True))
    cut = lambda t: [t[a:z] for a, z in K.paragraph_spans(t, True, 1, 10)]
    assert cut("aaa bbb. ccc ddd. eee fff") == ["aaa bbb.", "ccc ddd.", "eee fff"]
    assert cut("aaaa bbbb cccc dddd") == ["aaaa", "bbbb", "cccc dddd"]


def test_sentences():
    text = "First sentence is here now. Short. Another sentence that is long enough! tail without end punctuation here"
    assert spans(K.sentence_spans, text, False) == [(0, 27), (35, 72), (73, 106)]
    zh = "这是第一个用于测试的句子，长度足够超过二十个字符。短句。这是第二个用于测试的句子，同样长度超过二十个字符！"
    assert spans(K.sentence_spans, zh, False) == [(0, 25), (28, 53)]


def test_numbers_and_short_sentences():
    text = "版本 2.5 的说明文字在这里，已经足够长了，真的足够长。"
    assert len(spans(K.sentence_spans, text, False, protect_numbers=True)) == 1
    joined = "这是一个足够长的句子，长度超过了二十个字符。短句。这是第二个足够长的句子，长度超过了二十个字符。"
    assert len(spans(K.sentence_spans, joined, False, merge_short=True)) == 2
    assert spans(K.sentence_spans, joined, False, merge_short=True)[0][1] == 25


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .;\n\t é。；😀", max_size=300), st.booleans())
def test_offsets_slice_back(text, english):
    for a, z in K.paragraph_spans(text, english, 3, 20):
        assert text[a:z] == text[a:z].strip() and z - a >= 3 and "\n" not in text[a:z]
    found = spans(K.paragraph_spans, text, english, 1, 20)
    assert found == sorted(found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    assert "".join(text.split()) == "".join("".join(text[a:z].split()) for a, z in found)


def test_parents(spark):
    p = spark.createDataFrame([(1, 0, 0, 20), (1, 1, 30, 50)], "doc_id long, chunk_index int, start_pos int, end_pos int")
    s = spark.createDataFrame([(1, 2, 5, 15), (1, 3, 25, 60), (1, 4, 18, 24), (2, 5, 0, 9)], "doc_id long, chunk_index int, start_pos int, end_pos int")
    got = {r.chunk_index: r.parent_index for r in K.assign_parents(p, s).collect()}
    assert got == {2: 0, 3: 1, 4: 1, 5: None}
    got = {r.chunk_index: r.parent_index for r in K.assign_parents(p, s, "centre").collect()}
    assert got == {2: 0, 3: 1, 4: 0, 5: 5}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .;\n é。", max_size=200), st.sampled_from(["start", "centre"]))
def test_parent_is_nearest(text, fallback):
    own = spans(K.paragraph_spans, text, True, 5, 20)
    place = (lambda p: p[0]) if fallback == "start" else sum
    for a, z in spans(K.paragraph_spans, text, True, 1, 9):
        held = [n for n, (x, y) in enumerate(own) if x <= a and z <= y]
        near = sorted(range(len(own)), key=lambda n: (abs(place(own[n]) - place((a, z))), n))
        assert K.parent_of(own, a, z, fallback) == next(iter(held or near), None)


def test_parents_of_texts_equal_those_of_tables(spark):
    rows = [(1, "en", "A short line that is a paragraph.\n" + "A sentence of some length that goes on and on here. " * 30), (2, "en", None), (3, "zh", ""), (None, "zh", "这是一个足够长的句子，长度超过了二十个字符。" * 40)]
    docs = spark.createDataFrame([(i, lang, t, "s") for i, lang, t in rows], "doc_id long, lang string, text string, source string")
    for fallback in ("start", "centre"):
        one = K.sentences_in_paragraphs(docs, fallback, keep=("source",))
        two = K.assign_parents(K.split_paragraphs(docs), K.split_sentences(docs), fallback)
        key = lambda r: (r.doc_id or 0, r.chunk_index, r.parent_index)
        assert sorted(map(key, one.collect())) == sorted(map(key, two.collect()))
        assert {r.source for r in one.collect()} == {"s"} and one.count() > 60


def test_batches_are_cut_into_small_ones():
    b = pa.RecordBatch.from_pydict({"n": list(range(1203))})
    got = list(K.sliced([b, b.slice(0, 0), b.slice(0, 3)], 500))
    assert [x.num_rows for x in got] == [500, 500, 203, 3] and [n for x in got[:3] for n in x.column("n").to_pylist()] == list(range(1203))


def test_sentences_are_sorted_once(spark):
    """By start, what a sentence needs of the next paragraph comes with the paragraph: sentences go through one window."""
    kind = "doc_id long, chunk_index int, start_pos int, end_pos int"
    p, s = spark.createDataFrame([(1, 0, 0, 20), (1, 1, 30, 50)], kind), spark.createDataFrame([(1, 2, 25, 28)], kind)
    plan = lambda fallback: K.assign_parents(p, s, fallback)._jdf.queryExecution().optimizedPlan().toString()
    above = lambda text: text[: text.index("Union")].count("Window [")
    assert (above(plan("start")), above(plan("centre"))) == (1, 2)
