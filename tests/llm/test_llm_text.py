import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textreuse.llm import decontam, katz, substring

DOCS = "doc_id long, text string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(seed=5, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "The", "é-x", "of,"]
    passage = " ".join(rng.choice(words, 45))
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words, int(rng.integers(0, 120))))
        if i % 4 == 0:
            t = f"{t} {passage} {' '.join(rng.choice(words, 9))}"
        if i % 10 == 3:
            t = rows[-1][1]
        if i % 10 == 7:
            t = t + "\n" + t
        rows.append((i, t))
    return [*rows, (100, None), (101, ""), (102, " \t\n"), (103, "x " * 3000), (7, rows[7][1])]


def brute_substring(rows, length=20):
    """Places in the order of doc_id, hash of the words, start; rows equal in both are one."""
    seen, out = {}, []
    tie = lambda t: int.from_bytes(hashlib.sha256(b" ".join((t or "").encode().split())).digest()[:8], "big", signed=True)
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: (r[0], tie(r[1]))):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if seen.setdefault(key, (i, tie(t), k)) != (i, tie(t), k):
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def edited(seed=31, n=60):
    """Near copies, prefixes and suffixes of a few texts, periodic texts, and repeated ids."""
    rng = np.random.default_rng(seed)
    words = [f"v{i}" for i in range(60)]
    bases = [list(rng.choice(words, 120)) for _ in range(4)] + [["p", "q", "r"] * 30, ["z"] * 50]
    rows = []
    for i in range(n):
        w = list(bases[int(rng.integers(len(bases)))])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = str(rng.choice(words))
        a, z = sorted(rng.integers(0, len(w) + 1, 2).tolist())
        rows.append((int(rng.integers(0, 40)), " ".join(w[a:z] if i % 2 else w)))
    return rows


@pytest.mark.parametrize("make", [corpus, edited])
@pytest.mark.parametrize("share", [substring.HOT_SHARE, 1e-9])
def test_substring(spark, make, share, monkeypatch):
    monkeypatch.setattr(substring, "HOT_SHARE", share)
    rows = make()
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"sha": F.lit(1), "kept": F.lit("k"), "n_chars": F.lit(7), "row": F.lit(0)})
    assert sorted(map(tuple, substring.dedup(df).collect())) == brute_substring(rows)


def test_substring_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(33)
    a, b, tail = (" ".join(rng.choice([f"u{i}" for i in range(500)], n)) for n in (40, 40, 25))
    rows = [(1, a), (7, b), (7, f"{a} {tail}"), (9, f"{b} z"), (None, a), (9, f"{b} z")]
    got = sorted(map(tuple, substring.dedup(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    want = brute_substring(rows) + [(None, 40, 0, hashlib.sha256(a.encode()).hexdigest())]
    assert got == sorted(want, key=str) and {r[2] for r in got if r[0] == 7} == {0, 40} and [r[2] for r in got if r[0] == 9] == [40, 40]


def test_texts_without_repeats(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"sha": F.lit(1), "kept": F.lit("k"), "n_chars": F.lit(7), "row": F.lit(0)})
    kept = substring.without_repeats(df)
    assert kept.columns == df.columns
    left = {r.doc_id: r for r in kept.collect()}
    for i, n, gone, sha in brute_substring(rows):
        if n and n == gone:
            assert i not in left
        else:
            assert hashlib.sha256(b" ".join((left[i].text or "").encode().split())).hexdigest() == sha
            assert gone == 0 or left[i].n_chars == len(left[i].text)
    assert left[100].text is None and left[102].text == " \t\n"
    assert substring.dedup(spark.createDataFrame([], DOCS)).count() == 0
    one = substring.dedup(spark.createDataFrame([(None, "a " * 50), (1, "a " * 50)], DOCS)).collect()
    assert {r.doc_id: r.n_removed for r in one} == {None: 0, 1: 49}
    assert kept.dtypes == df.dtypes


def brute_decontam(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    runs = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            runs[tuple(w[k : k + window])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(r) for r in runs}:
            for k in range(len(w) - n + 1):
                if names := runs.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("sizes", [{}, {"most_terms": 1, "block": 7}])
def test_decontam(spark, sizes, monkeypatch):
    rows = [*corpus(), (None, "w1 W2 w3 w1 w2")]
    items = [(1, rows[4][1]), (2, rows[8][1][-200:]), (3, "W1 w2"), (30, "the"), (4, None), (5, ""), (6, "nowhere to be found at all in any of these texts here"), (7, rows[4][1]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("segment", F.lit("clash"))
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(1))
    got = decontam.report(df, tests, **sizes)
    want = brute_decontam(rows, [x for x in items if x[0] is not None])
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted(want, key=str)
    assert decontam.report(spark.createDataFrame([], DOCS), tests).count() == 0
    assert decontam.report(df, tests.limit(0)).where("contaminated").count() == 0


def brute_proximity(rows, items, span, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = defaultdict(set)
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            terms = set(w[k : k + window])
            for i, text in rows:
                x = words(text)
                for end in range(len(x)):
                    if x[end] not in terms:
                        continue
                    for first in range(end, max(-1, end - span), -1):
                        if terms <= set(x[first : end + 1]):
                            out[i, first].add(str(item))
                            break
    return sorted((i, a, sorted(s)) for (i, a), s in out.items())


def test_proximity(spark):
    rng = np.random.default_rng(21)
    rows = [(1, "alpha beta gamma delta"), (2, "delta x gamma y beta alpha z"), (3, "alpha " + "q " * 60 + "beta gamma delta"), (4, None)]
    rows += [(10 + i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 40))))) for i in range(30)]
    items = [(1, "alpha beta gamma delta"), (2, "a b c a"), (3, "h"), (4, "a b c d e f g h a b c"), (5, "absent a")]
    df, tests = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for span in (3, 8, 20):
        assert sorted(map(tuple, decontam.proximity(df, tests, span=span).collect())) == brute_proximity(rows, items, span)
    assert decontam.report(df, tests.where("item_id = 1")).where("contaminated").count() == 1


def brute_katz(docs):
    k = katz.K
    texts = [[*(t or "").encode().lower().split(), b""] for _, t in docs]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    uni, bi = Counter(), Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            uni.update(t)
            bi.update(zip([b"", *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)

    def discounts(by):
        c = [by.get(r, 0) for r in range(k + 2)]
        cut = (k + 1) * c[k + 1] / c[1] if c[1] else 1.0
        out = {}
        for r in range(1, k + 1):
            x = ((r + 1) * c[r + 1] / (r * c[r]) - cut) / (1 - cut) if c[r] and cut < 1 else 0
            out[r] = x if 0 < x < 1 else (r - 0.5) / r
        return out

    d1, d2 = discounts(Counter(uni.values())), discounts(Counter(bi.values()))
    kept = sum(d1.get(c, 1) * c for c in uni.values())
    below = n if n - kept > 1e-9 else n + 1
    p1 = lambda w: d1.get(uni[w], 1) * uni[w] / below if uni[w] else 1 - kept / below
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c
    base = {h: uni[h] + (min(f.values()) > k) for h, f in after.items()}
    alpha = {h: (1 - sum(d2.get(c, 1) * c / base[h] for c in f.values())) / (1 - sum(map(p1, f))) for h, f in after.items()}
    p = lambda h, w: p1(w) if not uni[h] else d2.get(bi[h, w], 1) * bi[h, w] / base[h] if bi[h, w] else alpha[h] * p1(w)
    for h in after:
        assert abs(sum(p(h, w) for w in uni) + alpha[h] * (1 - kept / below) - 1) < 1e-9
    log = math.log10
    return [
        (i, h, len(t), sum(uni[w] > 0 for w in t), n, sum(log((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), sum(log(p(a, b)) for a, b in zip([b"", *t[:-1]], t, strict=True)))
        for (i, _), t, h in zip(docs, texts, held, strict=True)
    ]


@pytest.mark.parametrize("sizes", [{}, {"hot": 60, "chunk_tokens": 300, "bucket_tokens": 900}])
def test_katz(spark, sizes):
    # "bb" is followed by nothing rare: in the smaller size it is dealt to several buckets
    docs = [*corpus(), (None, "the of"), (106, "never seen words the"), *((200 + i, "aa bb " * 20) for i in range(40)), (300, "bb never bb w1"), (None, "bb w2 aa bb")]
    df = spark.createDataFrame(docs, DOCS).repartition(3).withColumn("chunk", F.lit("clash"))
    got = sorted(map(tuple, katz.score(df, **sizes).collect()), key=str)
    want = sorted(brute_katz(docs), key=str)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)
    assert katz.score(spark.createDataFrame([], DOCS)).count() == 0
    alone = katz.score(spark.createDataFrame([(None, "a b")], DOCS)).first()
    assert (alone.train_tokens, alone.n_known, alone.base_score, alone.score) == (0, 0, 0.0, 0.0)
