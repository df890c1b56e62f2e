"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, crosstok, decontam, hardneg, htmltext, katz, packing, pii, quality, simhash, substring, urlfilter, warc
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


def decontam_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: places where a window of the benchmark stands close together in any order, and their items."""
    found = decontam.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.size(F.array_distinct(F.flatten(F.collect_list("item_ids")))).cast("long")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_places"), items.alias("n_items"))


def op9_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), hardneg.quantised(rows).alias("x"))
    return hardneg.mine(rows, F.col("id") % 100 == 0)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op13_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    files = crosstok.Files(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return crosstok.align(table(spark, sf_dir, "documents"), files)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontam": op2_decontam,
    "decontam_proximity": decontam_proximity,
    "op3_ann": op3_ann,
    "op4_katz": op4_katz,
    "op5_warc": op5_warc,
    "op6_substring": op6_substring,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_htmltext": op9_htmltext,
    "op10_urlfilter": op10_urlfilter,
    "op11_hardneg": op11_hardneg,
    "op12_pii": op12_pii,
    "op13_crosstok": op13_crosstok,
}
ORACLE: dict[str, str] = {
    "op5_warc": """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as size, sha1(coalesce(html, '')) as digest
  from pages
), g as (
  select *, case when size >= 1000 and page_id is not null then max(page_id) over (partition by digest, size) end as last from p
)
select page_id, size as payload_bytes, digest as payload_digest,
  case when last <> page_id then 'revisit' else 'response' end as record_type,
  case when last <> page_id then last end as refers_to
from g
""",
    "op10_urlfilter": """
with rest as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages
), parts as (
  select page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') as path
  from rest
), ruled as (
  select *, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from parts
)
select page_id, host, path, rule,
  case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict
from ruled
""",
    "op11_hardneg": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    cast(coalesce(list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)]), 0) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0
), positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positive p join scored n on p.anchor_id = n.anchor_id and not n.same
where 80 * p.positive_score <= 100 * n.score and n.score <= p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id)
qualify row_number() over w <= 5
""",
}
