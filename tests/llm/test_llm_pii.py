import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textreuse.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def fits(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, m.end(), kind, m[0]) for k, (kind, p) in enumerate(PATTERNS.items()) for m in p.finditer(text) if fits(kind, m[0])]
    return sorted(found)


def brute(rows, window=8, support=3, generalise=0.9, remove=0.97):
    """Everything by definition, over dictionaries of whole documents."""
    texts = [t or "" for _, t in rows]
    n, docs_of, context, holding = len(texts), {}, {}, {}
    for d, t in enumerate(texts):
        for w in {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}:
            holding.setdefault(w, set()).add(d)
    free = []
    for d, t in enumerate(texts):
        spans = base(t)
        words = [m for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < z for a, _, z, _, _ in spans)]
        free.append(words)
        seen = set()
        for a, _, _, kind, value in spans:
            c = kind, value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)
            docs_of.setdefault(c, set()).add(d)
            i = sum(m.start() < a for m in words)
            near = [m[0].lower() for m in words[max(0, i - window) : i + window]]
            for w in set(near):
                if (c, w) not in seen:
                    seen.add((c, w))
                    context.setdefault((c, w), []).append(tuple(near))
    level = {}
    for (c, w), near in context.items():
        if len(set(near)) >= support and len(docs_of[c]) < n:
            held = math.log(len(near) * n / (len(docs_of[c]) * len(holding[w]))) / math.log(n / len(docs_of[c]))
            if held >= generalise - 1e-12:
                level[w] = max(level.get(w, 4), 5 if held >= remove else 4)
    out = []
    for (i, _), t, words in zip(rows, texts, free, strict=True):
        spans = base(t)
        name = lambda s: f"{s[3]}:{s[0]}:{s[2]}"
        every = spans + [(m.start(), level[m[0].lower()], m.end(), pii.KINDS[level[m[0].lower()]]) for m in words if m[0].lower() in level]
        out.append((i, *(sum(s[3] == k for s in spans) for k in PATTERNS), hashlib.sha256(",".join(map(name, spans)).encode()).hexdigest(), ",".join(map(name, sorted(every)))))
    return sorted(out, key=str)


def corpus(seed=3, n=300):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("la", "Ko", "mi", "ZÄ", "tu") for b in ("ren", "sol", "vé", "pak", "dim", "gor")]
    say = lambda k: " ".join(rng.choice(words, k))
    rows = []
    for i in range(n):
        t = say(int(rng.integers(3, 40)))
        who = i % 12
        if who < 4:
            mail, name = f"Person.{who}@Mail{who}.example.com", ["Quentin", "Xaviera", "Wolfram", "Ophélie"][who]
            t = f"{say(9)} {name} <{mail}> {say(9)}" if i % 3 else f"{say(4)} {mail}, {say(4)} city{'abcd'[who]}x {name.upper()}"
        if who == 5:
            t += f" {rng.integers(0, 400)}.{rng.integers(0, 300)}.7.{rng.integers(0, 256)} card 4041894974608795 or {rng.integers(10**14, 10**16)} call +1 (017) 555-77{i % 100:02d}"
        if who == 6:
            t = rows[0][1]
        if who == 7 and i % 5 == 0:
            t += " quentin"
        rows.append((i, t))
    odd = ["a@b", "a@b.c", "@x.y", "a@b.c@d.e", "x..@-.-.", "1.2.3.4.5.6.7.8", "1.2.3", "000001.2.3.255", "256.1.1.1", "+1234567890", "++1 (234) 567-8901-", "4111 1111-1111 1111", "4111  1111 1111 1111", "49927398716" * 3, "éa@b.cé Ⅷ İstanbul", "a@b.c.d.", "5" * 3000, "w" * 5000 + "@" + "v" * 10, "1." * 2000, "+1" * 500]
    return [*rows, *((1000 + i, t) for i, t in enumerate(odd)), (7, rows[7][1]), (None, rows[1][1]), (5, None), (6, "")]


@pytest.mark.parametrize("most", [pii.MOST_TERMS, 0])
def test_report(spark, most):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"base": F.lit(1), "all": F.lit("x"), "term": F.lit(0), "_t": F.lit("t"), "spans": F.lit(1)})
    got = sorted(map(tuple, pii.report(df, most_terms=most).collect()), key=str)
    assert got == brute(rows)
    text = " ".join(r[-1] for r in got)
    assert text.count("removed:") > 50 and all(f"{k}:" in text for k in pii.KINDS[:4])


def test_levels(spark):
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limits in ({"generalise": 0.3, "remove": 0.6}, {"support": 1, "window": 2}):
        got = sorted(map(tuple, pii.report(df, **limits).collect()), key=str)
        assert got == brute(rows, **limits)
        assert "generalised:" in (text := " ".join(r[-1] for r in got)) or "removed:" in text


def test_patterns_on_noise():
    rng = np.random.default_rng(11)
    for _ in range(20_000):
        t = "".join(rng.choice(list("aZ0199.5@+-() %_é@\n"), int(rng.integers(0, 40))))
        assert [m[:3] for m in pii.mentions(t)] == [s[:3] for s in base(t)], repr(t)


def test_sanitised_text(spark):
    rows = corpus()
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None and r.doc_id != 7}
    assert "[email]" in got[1] and "Xaviera" not in got[1] and "@" not in got[1] and got[17].count("[phone]") == got[17].count("[card]") == 1
    assert got[11] == rows[11][1] and got[6 + 1000] == "1.2.3"


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "w " * 900_000 + "me@here.org " + "ö" * 100_000)], "doc_id long, text string")
    assert pii.report(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0
    assert pii.report(df).collect()[0].spans == "email:1800000:1800011"
    blank = pii.report(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_email, r.base_sha256, r.spans) for r in blank} == {(i, 0, hashlib.sha256(b"").hexdigest(), "") for i in (1, None)}
