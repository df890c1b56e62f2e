"""Scalar functions on columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() and str.isspace() know it.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def clean_document(text: Column) -> Column:
    """Lines without trailing white space, at most two blank lines in a row, none at the ends."""
    lines = F.regexp_replace(text, rf"(?m)[\t\x0b\f\r \p{{Z}}\x1c-\x1f\x85]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{4,}", "\n\n\n"), r"\A\n+|\n+\z", "")


def clean_text(text: Column) -> Column:
    """Line ends as LF, runs of blanks and tabs as one blank, stripped."""
    ends = F.regexp_replace(text, r"\r\n?", "\n")
    return strip(F.regexp_replace(ends, r"[ \t]+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def language_class(lang: Column) -> Column:
    """en for English, zh for whatever else, empty and unknown included."""
    return F.when(F.lower(lang) == "en", "en").otherwise("zh")


def guess_language(text: Column) -> Column:
    """Where no language is given: English stop words against CJK signs in the first 2,000 characters."""
    head = F.substring(text, 1, 2000)
    stops = F.size(F.regexp_extract_all(F.lower(head), F.lit(r"(\b(?:the|of|and|to|in|is|that|it|for|with)\b)")))
    cjk = F.length(F.regexp_replace(head, r"[^㐀-鿿]", ""))
    return F.when((stops > 0) & (stops * 10 > cjk), "en").otherwise("zh")


def shingled_text(text: Column) -> Column:
    """The text as its shingles see it: lower case, white space collapsed."""
    return F.lower(F.regexp_replace(text, rf"{SPACE}+", " "))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct lower-case k-grams of the text with white space collapsed, all-blank ones left out; a text of fewer
    than k signs is its own shingle."""
    t = shingled_text(text)
    # a lookahead steps through the text once; it would cut pairs of surrogates, so such texts take the other way
    fast = F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{k}}}))"), F.lit(1))
    slow = F.when(F.length(t) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - k + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(k))))
    grams = F.when(F.rlike(t, F.lit(r"[\x{10000}-\x{10FFFF}]")), slow).otherwise(fast)
    grams = F.array_distinct(F.filter(F.coalesce(grams, F.array().cast("array<string>")), lambda g: F.trim(g) != ""))
    return F.when(F.length(text) < k, F.array(text)).otherwise(grams)


def exact_jaccard(left: Column, right: Column) -> Column:
    """Of two sets; both empty: 1, a missing one: 0."""
    union = F.size(F.array_union(left, right))
    both = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / union)
    return F.when(left.isNull() | right.isNull(), 0.0).otherwise(both)


def estimate_jaccard(left: Column, right: Column) -> Column:
    """Share of equal places of two signatures; 0 where their lengths differ."""
    same = F.aggregate(F.zip_with(left, right, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(left) == F.size(right), same / F.size(left)).otherwise(0.0)


def pass_probability(similarity: Column, rows: int = 3, bands: int = 40) -> Column:
    """Chance that a pair of this similarity shares a band."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(rows)), F.lit(bands))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    n = norm(vector)
    by = F.when(n == 0, 1.0).otherwise(n)
    # inside the function of a transform the norm would be computed again for each element
    return F.zip_with(vector, F.array_repeat(by, F.size(vector)), lambda x, y: x.cast("double") / y)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def cosine(left: Column, right: Column) -> Column:
    n = norm(left) * norm(right)
    return F.when(n == 0, 0.0).otherwise(dot(left, right) / n)


def clamp01(score: Column) -> Column:
    """Within 0 and 1; null and NaN are 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0))))


def final_score(final: Column, cross: Column, semantic: Column, rough: Column) -> Column:
    return F.coalesce(final, cross, semantic, rough)


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def format_score(score: Column) -> Column:
    return F.when(score.isNotNull(), F.format_string("%.3f", score)).otherwise("-")


def score_level(score: Column) -> Column:
    return (
        F.when(score > 0.9, ">.9").when(score >= 0.85, ">=.85").when(score >= 0.8, ">=.8").when(score >= 0.7, ">=.7").otherwise("else")
    )


def coverage(spans: Column) -> Column:
    """Length of the union of intervals (array of struct<start, end>); touching ones merge."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("end"))
    step = lambda a, s: F.struct(
        (a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("sum"), F.greatest(a["end"], s["end"]).alias("end")
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["sum"])


def full_span(left: Column, right: Column) -> Column:
    zero = F.lit(0)
    return F.struct(zero.alias("left_start"), F.length(left).alias("left_end"), zero.alias("right_start"), F.length(right).alias("right_end"))


def moved(span: Column, left: Column, right: Column) -> Column:
    """A span moved by the starts of its chunks."""
    by = {"left_start": left, "left_end": left, "right_start": right, "right_end": right}
    return F.struct(*((span[k] + v).alias(k) for k, v in by.items()))
