import hashlib
import math
import os
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textreuse.llm import ann, htmltext, quality, urlfilter, warc
from textreuse.llm.common import Scratch

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("share", [warc.HOT_SHARE, 1.0])
def test_warc_round_trip(spark, share, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    big, other = "é" * 600, "y" * 1000
    rows = [(1, "http://a/x y\r\n", big), (5, None, big), (3, "http://b", big), (9, "c", "z" * 999), (8, "d", "z" * 999), (2, "e", None), (4, "f", ""), (6, "g", other), (6, "g", other), (7, "h", other), (None, "i", other), (-3, "j", "neg"), (12, "u" * 100_000, "long " * 2_000_000)]
    df = spark.createDataFrame(rows, PAGES).repartition(3).withColumns({"digest": F.lit(1), "size": F.lit(2)})
    got = sorted(map(tuple, warc.archive(df).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = {1: 5, 3: 5, 6: 7}.get(i)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_selected_ranges(spark):
    scratch = Scratch(spark, "t")
    rows = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(200)]
    index = scratch.put(warc.write(warc.with_types(spark.createDataFrame(rows, PAGES).repartition(2)), f"{scratch.path}/a", archive_bytes=2000), "index")
    assert index.select("archive").distinct().count() > 5
    got = warc.read(index.where("page_id % 7 = 0"), stretch=1000).collect()
    assert {r.page_id for r in got} == set(range(0, 200, 7)) and all(r.payload_bytes == len(f"page {r.page_id} " * 50) for r in got)
    assert list(warc.ranges([(0, 10), (15, 5), (100, 5)], gap=5, most=50)) == [(0, 20, 0, 2), (100, 105, 2, 3)]


ARTICLE = (
    '<html><head><title>no</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>top</header><nav><ul><li><a href=x>menu</a></ul></nav>'
    '<div class="cookie-notice">we use</div><aside>side</aside>{}<form><input><p>form</p></form><div id="comments"><p>{}</p></div><footer>foot</footer></body></html>'
)
LONG = "words of the story that go on for a while, " * 4


@pytest.mark.parametrize(
    "html, text",
    [
        (ARTICLE.format("<article><h1>T &amp; t</h1><p>a&nbsp;<b>b</b>c<br>d <!-- x --></p><div class=ad>ad</div><p>e", LONG), "T & t a bc d e"),
        (ARTICLE.format(f"<div><h2>Head</h2><p>{LONG}</p><p>short</p></div>", LONG), f"Head {LONG.strip()} short"),
        ("<p>one<p>two <i>three</i>four", "one two threefour"),
        (f'<nav><a href="/">m</a><main><p>{LONG}</main>', LONG.strip()),
        ("plain a < b", "plain a < b"),
        ("<article><header><h1>h</h1></header><p>x</p></article><article class='comment'><p>no</p></article>", "h x"),
        ("<p>" + "İ" * 40 + " bir</p><SCRIPT>x()</Script><p>iki üç dört beş altı yedi</p><script>y()</script><p>son</p>", "İ" * 40 + " bir iki üç dört beş altı yedi son"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p><a href=x>another story</a></p></article>", f"{LONG.strip()} {LONG.strip()}"),
        (f"<article><p>{LONG}</p>" + "<p><a href=x>more of this</a></p>" * 4 + "<p>tail</p></article>", LONG.strip()),
        (None, ""),
        ("", ""),
        ("<script>never closed", ""),
        ("<div><p>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


class Article(HTMLParser):
    """Text blocks of the first article, told by nothing but its tags."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "div") else self.handle_data(" " if tag == "br" else "")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("p", "h1", "div"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def given_pages():
    return duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="given tables are absent")
def test_given_pages_against_a_plain_parser():
    for (page,) in given_pages():
        blocks = (" ".join(x.split()) for x in Article(page).blocks)
        assert htmltext.main_text(page) == " ".join(x for x in blocks if x)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="given tables are absent")
def test_the_distribution_decides_on_given_pages():
    pages = [p for (p,) in given_pages()]
    usual = [htmltext.main_text(p) for p in pages]
    for window, surge in ((1, 80), (1, 1e12), (3, 1e12)):
        assert sum(a != htmltext.main_text(p, window, surge) for a, p in zip(usual, pages, strict=True)) > 0


def test_long_pages_take_time_in_proportion():
    for part in ("<nav>", "<div class=ad>", "<span class=ad>x", "<textarea>", "<div></span>", "<p class=ad>a"):
        began = time.process_time()
        htmltext.main_text(part * 20_000)
        assert time.process_time() - began < 8, part
    assert htmltext.main_text(f"<article><p>{'word ' * 1_000_000}</p></article>") == "word " * 999_999 + "word"


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (None, None, None)], PAGES).withColumn("text", F.lit("clash"))
    assert sorted(map(tuple, htmltext.extract(df).collect()), key=str) == [(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0)]
    assert htmltext.extract(spark.createDataFrame([], PAGES)).count() == 0


def judged(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "https://a.example.org/es/1?x#y", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/de/a", "http://x.com/fr/#/de/", "http://com?/de/", "a://b://c/d", "http://x.com/de", "http://É.com/de/é?", "http://x.org", "http://h/a\nb#c"]
    urls += [f"http://h{i}.com/{'de' if i % 3 else 'fr'}/{i}" for i in range(300)]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate([*urls, "http://x.com/de/a"])], PAGES).withColumns({"rule": F.lit(1), "ruled": F.lit("x"), "key": F.lit("k"), "listed": F.lit(True)})
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(df).collect()}
    assert got == {i: judged(u) for i, u in enumerate([*urls, "http://x.com/de/a"])}
    assert urlfilter.judge(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("most_words, most_constant", [(1 << 18, 1 << 21), (16, 1 << 21), (16, 0)])
def test_cascade_is_exact(spark, most_words, most_constant):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    universe = universe.unionByName(spark.createDataFrame([(None, True), ("k1", False)], "key string, listed boolean"))
    cascade = urlfilter.build_cascade(universe, Scratch(spark, "t"), most_words)
    assert cascade.shards == (1 if most_words > 16 else 4) and cascade.depth > 2
    got = cascade.mark(universe, "key", "found", most_constant)
    assert got.where("found <> coalesce(listed and key is not null, false)").count() == 0 and got.count() == 3002


def test_cascade_gives_the_verdict(spark):
    urls = [f"http://h{i}.com/{'de' if i % 3 else 'fr'}/{i}" for i in range(60)] + ["http://x.com/de/" + "long" * 500_000]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    assert urlfilter.judge(df).where("verdict = 'block'").count() == 41
    emptied = urlfilter.judge(df, cascade=urlfilter.EMPTY)
    assert emptied.where("verdict = 'block'").count() == 0 and emptied.where("rule = 'com/de/'").count() == 41


def test_block_list(spark):
    df = spark.createDataFrame([(1, "http://plain.net/a", None), (2, "http://plain.net/b", None), (3, "http://x.org/", None)], PAGES)
    listed = spark.createDataFrame([("plain.net/a",), ("x.org/",), ("elsewhere/",)], "key string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, listed=listed).collect()} == {1: "block", 2: "allow", 3: "allow"}  # a rule allows 3


def vectors(n, dim=16, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = (centres[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, dim))).astype(np.float32)
    x[n // 3 : n // 2] = x[0]  # one vector a sixth of the rows
    return x


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ann(spark, kind):
    x = vectors(900) if kind == "float" else vectors(900).astype(float) + np.random.default_rng(8).normal(size=(900, 16)) * 1e-9
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15 + [None]), (2080, [float("inf")] * 16), (None, x[3].tolist())]
    df = spark.createDataFrame(rows + odd, f"vec_id long, embedding array<{kind}>").withColumns({"list": F.lit(1), "id": F.lit(2), "v": F.lit(3), "row": F.lit("r")})
    got = ann.search(df, lists=8, probes=6, block=100).collect()
    y = x.astype(float)
    hits = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 900, 20))
    for q, found in by.items():
        s = y @ y[q]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(v != q and abs(s[v] - c) < 1e-13 for _, v, c in found)
        assert found == sorted(found, key=lambda t: (-t[2], t[1]))
        s[q] = -np.inf
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(900), -s))[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9
    # what is scored exactly is less than a block, so coarse codes lose some
    few = ann.search(df, lists=8, probes=8, block=100, parts=1, rerank=0.0).collect()
    assert {(r.query_id, r.vec_id) for r in few} != {(r.query_id, r.vec_id) for r in ann.search(df, lists=8, probes=8, block=100, parts=1, rerank=1.0).collect()}
    few = ann.search(df.where("vec_id in (0, 1, 2, 2000)"))
    assert sorted((r.query_id, r.vec_id) for r in few.collect()) == [(0, 1), (0, 2)]
    assert ann.search(df.where("vec_id >= 2000")).count() == 0 and ann.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", ["lengths", "clusters", "noise", "copies"])
def test_ann_loses_nothing_whatever_the_rows(spark, rows):
    """Lengths that differ widely, tight clusters in few directions, plain noise, many equal vectors."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 32))
    if rows == "lengths":
        x *= np.exp(rng.normal(size=(1200, 1)) * 2)
    elif rows == "clusters":
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, 1200)] + (rng.normal(size=(1200, 2)) @ rng.normal(size=(2, 32))) * 0.05
    elif rows == "copies":
        x[rng.random(1200) < 0.3] = x[7]
    x = x.astype(np.float32)
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), lists=24, sample=300, block=200).collect()
    y = x.astype(float)
    want = {}
    for q in range(0, 1200, 20):
        s = (y * y[q]).sum(axis=1)
        s[q] = -np.inf
        want[q] = np.lexsort((np.arange(1200), -s))[:20].tolist()
    found = {q: [None] * 20 for q in want}
    for r in got:
        found[r.query_id][r.rank - 1] = r.vec_id
    assert found == want


def test_ann_of_repeated_ids_and_other_lengths(spark):
    rows = [(0, [0.1, 0.2]), (1, [1.7, 0.0]), (1, [0.3, 0.4]), (2, [1.0, 2.0, 3.0]), (20, [1.0, 1.0, 1.0]), (0, [1.0, 0.0]), (40, [2.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(0, 1, 1, 0.1 * 1.7), (0, 2, 1, 0.1 * 0.3 + 0.2 * 0.4), (0, 3, 0, 0.1), (0, 1, 1, 1.7), (0, 2, 1, 0.3), (0, 3, 0, 0.1), (20, 1, 2, 6.0)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in got) == sorted((q, r, v, round(s, 12)) for q, r, v, s in want)


def rated(n=600, seed=7):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(5, 80))))
        toxic, poor = int(i % 9 == 0), int(i % 5 == 1)
        if toxic:
            w.insert(len(w) // 2, str(rng.choice(["slur", "insult"])))
        if poor:
            w = [x + "%%%" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, 1 - poor, toxic))
    return docs, labels


def test_quality(spark):
    docs, labels = rated()
    held = spark.createDataFrame([(10_000 + i, t) for i, t in rated(300, 8)[0]] + [(1, None), (2, ""), (None, "w1 w2 w3 w4")], "doc_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rates = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, rates)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in quality.score(held, model).collect()}
    assert 1 in got and None in got and all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    wrong = sum((got[10_000 + i].p_tail >= 0.5) != (q == 1 and not t) for i, q, t in rated(300, 8)[1])
    assert wrong <= 6
    kept = quality.select(held.withColumn("p_tail", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "p_tail"] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.p_tail >= 0.5}
    none = quality.classify(df.limit(5), rates.limit(0)).collect()
    assert len(none) == 5 and quality.classify(df.limit(0), rates).count() == 0


def test_quality_against_a_plain_fit(spark):
    """The same penalised likelihood, minimised by another way over every single token; tails by the definition."""
    rng = np.random.default_rng(17)
    x = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(150)]
    truth = rng.normal(size=12) * 2
    z = np.array([truth[r].sum() for r in x])
    grades = (z + rng.logistic(size=150) > -1).astype(int) + (z + rng.logistic(size=150) > 1.5)
    model = quality.fit(x, grades, 3, 20, l1=1e-3, turns=4000)

    def loss(w, theta):
        total = 0.0
        for r, g in zip(x, grades, strict=True):
            s = sum(w[k] for k in r)
            edges = [1.0, *(1 / (1 + math.exp(-(s - t))) for t in theta), 0.0]  # P(grade >= j)
            total -= math.log(edges[g] - edges[g + 1])
        often = [sum(k in r for r in x) for k in range(12)]
        # the penalty is that of columns scaled to one length
        return total / len(x) + 1e-3 * sum(abs(w[k]) * math.sqrt(often[k] / len(x)) * math.sqrt(len(x) / often[k]) for k in range(12))

    w, theta = np.zeros(12), np.array(model.thresholds)
    w[model.buckets] = model.weights
    best = loss(w, theta)
    for _ in range(300):  # no small step in any direction is better
        assert loss(w + rng.normal(size=12) * 0.02, np.sort(theta + rng.normal(size=2) * 0.02)) > best - 1e-6
    for r, tails in zip(x[:20], model.tails(x[:20]), strict=True):
        s = sum(w[k] for k in r)
        assert tails == pytest.approx([1 / (1 + math.exp(-(s - t))) for t in theta], abs=1e-12)


def test_quality_of_repeated_ids_and_clashing_names(spark):
    docs, labels = rated(200)
    df = spark.createDataFrame([*docs, (3, "another text of id three"), (3, None), (4, "w1 " * 300_000)], "doc_id long, text string")
    rates = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clash = df.withColumns({"grade": F.lit("g"), "x": F.lit(1), "p_tail": F.lit(2), "expected_grade": F.lit("e"), "keep": F.lit(0)})
    one = quality.classify(df, rates).collect()
    two = quality.classify(clash.repartition(5).orderBy(F.desc("text")), rates).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 203
