import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textreuse.llm import crosstok

FILES = crosstok.Files(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)


def whole_tokenizers():
    a, b = Tokenizer.from_file(FILES.a), sentencepiece.SentencePieceProcessor(model_file=FILES.b)
    a.encode_special_tokens = True
    signs = crosstok.byte_signs()
    names = {i: t for t, i in a.get_vocab().items()}

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def encode(text):
        """[(id, bytes)] of both, or nothing."""
        if not text:
            return [], []
        x = [(i, bytes(signs[c] for c in names[i])) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        y = [(i, of_b(i)) for i in b.encode(text)]
        fine = all(b"".join(t for _, t in z) == f" {text}".encode() for z in (x, y))
        return (x, y) if fine else ([], [])

    return encode


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(rows):
    encode = whole_tokenizers()
    docs = [(i, *map(spans, encode(t))) for i, t in rows]
    counts = Counter((a, b) for _, x, y in docs for a, p, q in x for b, r, s in y if p < s and r < q)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, x, y in docs:
        links = [(a, b) for a, p, q in x for b, r, s in y if p < s and r < q]
        cuts = sorted({q for _, _, q in x} & {s for _, _, s in y})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(k) for k, _, z in side if last < z <= c) for side in (x, y)))
            last = c
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=str), counts


def corpus(seed=2, n=120):
    rng = random.Random(seed)
    words = ["the", "Café", "naïve", "foo_bar", "don't", "12345", "...", "日本語", "😀", "über", "<|endoftext|>", "</s>", "<0x41>", "x\ty", "\n\nnew", "　", "a b", "\x00", "é", "ﬁ", "\r\n"]
    rows = [(i, "".join(rng.choice([" ", "  ", "", "\n", " "]) + rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    odd = [" ", "  ", "a ", "\n", "a▁b", "▁", "tail  ", "x" * 2000, " " * 300, "\x85 x \x85", "a\n b", "​ ​", "<s>", "\x1c \x1c y"]
    rows += [(1000 + i, t) for i, t in enumerate(odd)]
    return [*rows, (3, rows[3][1]), (3, "another"), (None, "no id"), (5, None), (6, "")]


@pytest.mark.parametrize("most, n", [(crosstok.MOST_PAIRS, 120), (40, 40)])  # all parts at once, and in many ranges
def test_alignment(spark, most, n):
    rows = corpus(n=n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"a": F.lit(1), "b": F.lit("b"), "_row": F.lit(0), "keys": F.lit(2), "n_a": F.lit("x")})
    got = sorted(map(tuple, crosstok.align(df, FILES, most_pairs=most).collect()), key=str)
    assert got == brute(rows)[0]
    assert sum(r[1] > 0 for r in got) > n * 0.8 and any(r[1] == 0 and r[0] == 1004 for r in got)


def test_pair_counts(spark):
    rows = corpus(4, 60)
    got = {(r.a_id, r.b_id): r["count"] for r in crosstok.pair_counts(spark.createDataFrame(rows, "doc_id long, text string"), FILES).collect()}
    assert got == dict(brute(rows)[1])


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "lorem ipsum " * 60_000 + "z" * 20_000)], "doc_id long, text string")
    assert crosstok.align(df.limit(0), FILES).count() == 0 and crosstok.pair_counts(df.limit(0), FILES).count() == 0
    row = crosstok.align(df, FILES).collect()[0]
    encode = whole_tokenizers()
    x, y = encode(df.collect()[0].text)
    assert (row.n_a, row.n_b) == (len(x), len(y)) and row.n_links == len(np.union1d(np.cumsum([len(t) for _, t in x]), np.cumsum([len(t) for _, t in y])))
    none = crosstok.align(spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string"), FILES).collect()
    assert {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "")} and len(none) == 3


def test_units_of_noise_are_those_of_whole_texts():
    rng, encode, both = random.Random(9), whole_tokenizers(), FILES.load()
    signs = " \n\t\r 　\x1c\x85▁ab1'.é😀​  "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(5000)]
    for t, a, b in zip(texts, *both.encode(texts), strict=True):
        x, y = encode(t)
        assert [i for i, _ in x] == np.frombuffer(a, "<u4").tolist() and [i for i, _ in y] == np.frombuffer(b, "<u4").tolist(), repr(t)


def test_perfect_hashing():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 65, 5000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        part = crosstok.part_of(keys)
        made = [(p, *crosstok.Function.build(keys[part == p])) for p in np.unique(part).tolist()]
        f = crosstok.Function([m[0] for m in made], [m[1] for m in made], [m[2] for m in made])
        assert sorted(f.slots(keys).tolist()) == list(range(len(keys)))
        assert 8 * sum(len(m[2]) for m in made) <= 4 * n + 64 * 60 * len(made)
        others = rng.integers(-(1 << 62), 1 << 62, 100)
        assert (f.slots(others) < max(1, len(keys))).all()
