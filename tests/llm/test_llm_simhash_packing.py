import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textreuse.llm import packing, simhash
from textreuse.llm.common import Scratch
from textreuse.llm.components import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"


def union_find(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(60)] + [tuple(map(int, rng.integers(100, 200, 2))) for _ in range(70)] + [(5, 5), (300, 250), (250, 300)]
    got = connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()
    want = union_find(301, links)
    assert {r.node: r.label for r in got} == {i: want[i] for pair in links for i in pair if pair[0] != pair[1] or i in range(61)}


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_of_dense_clusters(spark, hot):
    """Clusters around centres, with bits flipped in one half or both; hot buckets are cut again."""
    rng = np.random.default_rng(2)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 6, dtype=np.uint64):
        for _ in range(60):
            x = int(centre)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.links(df, Scratch(spark, "t"), hot).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3) if i < j]
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 3 for r in found)
    assert union_find(len(fps), [(at[r.u], at[r.v]) for r in found]) == union_find(len(fps), near)
    assert len(found) < 40 * len(fps)


def test_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "A b c d"), (3, "a B\tc\nd"), (9, None), (7, ""), (8, "  "), (1, long), (2, long + " tail"), (4, "only two"), (4, "only two"), (None, "a b c d"), (11, "é ü x")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit(1), "label": F.lit("x"), "component_id": F.lit(None).cast("string")})
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    found = got.collect()
    assert len(found) == len(rows)
    for i, text in rows:
        assert f"{brute_fingerprint(text):016x}" in {r.fingerprint for r in found if r.doc_id == i}
    component = {r.doc_id: r.component_id for r in found}
    assert component[5] == component[3] == component[None] == 3 and component[9] == component[7] == component[8] == 7
    assert component[1] == component[2] == 1 and component[4] == 4
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    texts = ["", None, "a", "Don't 'S stop!!! it's x≠ é́ É <|endoftext|>y <|ENDOFTEXT|>", "ΑΣ İx 한국어 🎉🎉 a.b,c\x85d", "w" * 9000 + " " + "%$# " * 800]
    texts += [" ".join(rng.choice(["the", "Naïve,", "run", "x9", "été."], int(n))) for n in rng.integers(1, 3000, 40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "a"), (None, "b c")]
    df = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("clash"))
    got = packing.pack(df, path).collect()
    want = []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str), key
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 4096
    assert len(by) == best_fit([r.length for r in got])
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def best_fit(lengths, capacity=4096):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in left if x >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(capacity - n)
    return len(left)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(4)
    for capacity in (10, 64):
        for _ in range(30):
            lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 120))).tolist()
            counts = {n: lengths.count(n) for n in set(lengths)}
            rows = packing.plan(counts, capacity).tolist()
            bins = {}
            for i, (n, first, start, each, offset) in enumerate(rows):
                last = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == n else counts[n]
                for k in range(last - first):
                    bins.setdefault(start + k // each, []).append((offset + k % each * n, n))
            assert sum(map(len, bins.values())) == len(lengths) and len(bins) == best_fit(lengths, capacity)
            for x in bins.values():
                x.sort()
                assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= capacity
