"""URL filter: a Bloom filter cascade over a complete key universe, with DataFrame functions only.

Level 1 encodes the listed keys; the keys of the universe that are not listed but pass it are its false positives,
which level 2 encodes; the listed keys that pass level 2 make level 3, and so on until a level lets nothing wrong
through. A key of the universe is listed exactly if the first level that lacks it is an even one. Keys are dealt into
shards by their hash and each shard has its own cascade, so that a level's array stays within `MOST_WORDS`; with more
keys the number of shards grows, never the array. All shards of a level are built by one job, in the executors.

Membership is the verdict of every URL: rules and block list only say which keys are listed. A cascade of a checked size
is one constant array of the plan, in which a URL is looked up by a few array functions, without a join. A larger one
stays a table, and a URL meets the level arrays of its own shard.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: 64-bit words of one level of one shard: 2 MB at most.
MOST_WORDS = 1 << 18
BITS_PER_KEY = 8
PROBES = 4
#: A cascade of at most so many words (16 MB) is a constant of the plan; a larger one is read shard by shard.
MOST_CONSTANT = 1 << 21

#: (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty where the url is null or has no `://`."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)"))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lower, "path": path})


def _fits(host: str, path: str) -> Column:
    on = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return on & F.startswith(F.col("path"), F.lit(path))


def with_rule(parts: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (host + path of the longest that fits; of equally long ones the greater string) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = _fits(host, path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return parts.withColumns({"rule": rule, "ruled": verdict})


def _spot(level: Column, k: Column | int, bits: Column, a: Column, b: Column) -> Column:
    """Bit number of probe k at a level: double hashing, other hashes at each level."""
    first = F.shiftrightunsigned(F.xxhash64(a, b, level), 1) % bits
    stride = F.shiftrightunsigned(F.xxhash64(b, a, level), 1) % bits
    return (first + F.lit(k) * (stride.bitwiseOR(F.lit(1)))) % bits


def _has(words: Column, spot: Column) -> Column:
    return F.getbit(F.get(words, F.shiftright(spot, 6).cast("int")), (spot % 64).cast("int")) == 1


def _passes(words: Column, level: int, a: Column, b: Column) -> Column:
    """Whether all probes of a key are set in the array of a level."""
    bits, ok = F.size(words).cast("long") * 64, F.lit(True)
    for k in range(PROBES):
        ok = ok & _has(words, _spot(F.lit(level).cast("long"), k, bits, a, b))
    return ok


class Cascade:
    """table: (shard, level, words), a row for each level that a shard has; depth: the most levels that any has."""

    def __init__(self, table: DataFrame | None, shards: int, depth: int, words: int):
        self.table, self.shards, self.depth, self.words = table, shards, depth, words

    def shard(self, a: Column) -> Column:
        return F.pmod(a, F.lit(self.shards)).cast("int")

    def _constant(self) -> Column:
        """levels[shard][level][word], folded to a single constant."""
        held: list[list[list[int]]] = [[] for _ in range(self.shards)]
        for r in self.table.orderBy("shard", "level").toLocalIterator():  # at most MOST_CONSTANT words
            held[r["shard"]].append(list(r["words"]))
        return F.from_json(F.lit(json.dumps(held)), "array<array<array<bigint>>>")

    def mark(self, rows: DataFrame, key: str, name: str, most_constant: int = MOST_CONSTANT) -> DataFrame:
        """Adds a boolean column: whether the key is listed, exact for keys of the universe; false for null keys."""
        if not self.depth:
            return rows.withColumn(name, F.lit(False))
        a, b = F.xxhash64(key), F.xxhash64(key, F.lit("b"))
        if self.words <= most_constant:
            return rows.withColumn(name, self._within(F.get(self._constant(), self.shard(a)), a, b) & F.col(key).isNotNull())
        rows = rows.withColumns({"_a": a, "_b": b, "_open": F.lit(True), name: F.lit(False)}).withColumn("_shard", self.shard(F.col("_a")))
        for n in range(self.depth):
            level = self.table.where(F.col("level") == n).select(F.col("shard").alias("_shard"), F.col("words").alias("_words"))
            passed = F.coalesce(_passes(F.col("_words"), n, F.col("_a"), F.col("_b")), F.lit(False))
            ends = F.col("_open") & F.col("_words").isNotNull()  # a shard without this level was decided by those before
            rows = rows.join(level, "_shard", "left").withColumns(
                {name: F.when(ends, passed == F.lit(n % 2 == 0)).otherwise(F.col(name)), "_open": ends & passed}
            ).drop("_words")
        return rows.withColumn(name, F.col(name) & F.col(key).isNotNull()).drop("_a", "_b", "_open", "_shard")

    @staticmethod
    def _within(levels: Column, a: Column, b: Column) -> Column:
        """Goes through a shard's levels until one lacks the key."""
        probes = F.sequence(F.lit(0), F.lit(PROBES - 1))

        def step(state: Column, n: Column) -> Column:
            words = F.get(levels, n)
            bits = F.size(words).cast("long") * 64
            passed = F.forall(probes, lambda k: _has(words, _spot(n.cast("long"), k.cast("long"), bits, a, b)))
            even = n % 2 == 0
            # 0: no level yet, 1 and 2: passed the last one, not listed or listed so far; 3 and 4: decided so
            return F.when(state >= 3, state).when(passed, F.when(even, 2).otherwise(1)).otherwise(F.when(even, 3).otherwise(4))

        count = F.size(levels)
        steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0), step).isin(2, 4)


EMPTY = Cascade(None, 1, 0, 0)


def build_cascade(universe: DataFrame, scratch: Scratch, most_words: int = MOST_WORDS) -> Cascade:
    """universe: (key string, listed boolean). Null keys are left out; a key that is listed in any row is listed."""
    keys = universe.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed"))
    keys = scratch.put(keys.select("listed", F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit("b")).alias("b")), "keys")
    shards = max(1, -(-keys.where("listed").count() * BITS_PER_KEY // (64 * most_words)))
    keys = keys.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    inside, outside, levels, depth, total = keys.where("listed").drop("listed"), keys.where("not listed").drop("listed"), None, 0, 0
    while True:
        # a row per shard, which are few: one for `most_words` words
        sizes = inside.groupBy("shard").agg(F.count("*").alias("n"))
        sizes = scratch.put(sizes.select("shard", F.least(F.ceil(F.col("n") * BITS_PER_KEY / 64), F.lit(most_words)).cast("long").alias("size")), f"sizes-{depth}")
        size = sizes.agg(F.sum("size")).first()[0]
        if size is None:
            return Cascade(levels, shards, depth, total)
        spots = F.array(*(_spot(F.lit(depth).cast("long"), k, F.col("size") * 64, F.col("a"), F.col("b")) for k in range(PROBES)))
        bits = inside.join(F.broadcast(sizes), "shard").select("shard", F.explode(spots).alias("bit"))
        bits = bits.select("shard", F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("word"))
        blank = sizes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("at"), F.lit(0).cast("long").alias("word"))
        filled = bits.unionByName(blank).groupBy("shard", "at").agg(F.expr("bit_or(word)").alias("word"))
        words = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
        level = scratch.put(filled.groupBy("shard").agg(words.alias("words")), f"level-{depth}").withColumn("level", F.lit(depth))
        levels = level if levels is None else levels.unionByName(level)
        passed = outside.join(level.drop("level"), "shard").where(_passes(F.col("words"), depth, F.col("a"), F.col("b"))).drop("words")
        inside, outside = scratch.put(passed, f"passed-{depth}"), inside
        depth, total = depth + 1, total + size


def judge(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, cascade: Cascade | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page.

    listed: keys (column key: host followed by path) of a block list. Listed are the keys that the longest rule blocks,
    and of those that no rule fits the ones of the block list. The key universe is every host and path of the pages, and
    a page is blocked exactly if the cascade (built from them, unless given) has its key. Null urls and urls without
    `://` have empty host and path, fit no rule and are judged like any key, as are urls of any length. Repeated rows are
    judged alike; an empty table gives an empty table.
    """
    ruled = with_rule(with_parts(pages.select("page_id", "url")), rules).withColumn("key", F.concat("host", "path"))
    if cascade is None:
        universe = ruled.select("key", F.coalesce(F.col("ruled") == "block", F.lit(False)).alias("listed"))
        if listed is not None:
            free = ruled.where("ruled is null").select("key").distinct()
            universe = universe.unionByName(free.join(listed.select("key").distinct(), "key", "left_semi").withColumn("listed", F.lit(True)))
        cascade = build_cascade(universe, Scratch(pages.sparkSession, "urlfilter"))
    return cascade.mark(ruled, "key", "member").select("page_id", "host", "path", "rule", F.when(F.col("member"), "block").otherwise("allow").alias("verdict"))
