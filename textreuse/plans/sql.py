"""DuckDB fragments that the oracles share."""

from __future__ import annotations

from textreuse.config import BANDS, PRIME
from textreuse.operators.minhash import coefficient_pairs

LINES = """
l0 as (select doc_id, source, lang = 'en' as english, string_split(text, chr(10)) as l from documents),
l1 as (select doc_id, source, english, unnest(l) as line, unnest(generate_series(1, len(l))) as i from l0),
l2 as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as pos from l1),
lines as (select doc_id, source, english, i, trim(line, ' ' || chr(9)) as line, pos + length(line) - length(ltrim(line, ' ' || chr(9))) as pos from l2)
"""


def _near(sign: str) -> str:
    n = len(sign)
    return (
        f"list_sort(list_transform(list_filter(generate_series(1, length(rest)), lambda p: substr(rest, p, {n}) = '{sign}'), "
        f"lambda p: {{'d': abs(p - 1 + {n} - length(rest) // 2), 'e': p - 1 + {n}}}))[1].e"
    )


_BLANK = """case when strpos(reverse(substr(rest, 1, length(rest) // 2)), ' ') > 0
  and length(rest) // 2 - strpos(reverse(substr(rest, 1, length(rest) // 2)), ' ') > 0
  then length(rest) // 2 - strpos(reverse(substr(rest, 1, length(rest) // 2)), ' ') + 1 end"""

PARAGRAPHS = (
    LINES
    + f""",
c0(doc_id, source, english, i, k, rest, pos, cut) as (
  select doc_id, source, english, i, 0, line, pos, null::bigint from lines where length(line) >= 20
  union all
  select doc_id, source, english, i, k + 1, ltrim(substr(rest, cut + 1), ' '), pos + cut + length(substr(rest, cut + 1)) - length(ltrim(substr(rest, cut + 1), ' ')), null
  from (select doc_id, source, english, i, k, rest, pos,
    case when english then coalesce({_near(". ")}, {_near("; ")}, {_BLANK}, length(rest) // 2)
    else coalesce({_near("。")}, {_near("；")}, length(rest) // 2) end as cut from c0 where length(rest) > 600)
),
c1 as (select *, lead(pos) over (partition by doc_id, i order by k) as next_pos from c0),
c2 as (select doc_id, source, i, k, pos as start_pos,
  rtrim(case when next_pos is null then rest else substr(rest, 1, (next_pos - pos)::bigint) end, ' ') as text from c1),
paragraphs as (select doc_id, source, row_number() over (partition by doc_id order by start_pos) - 1 as chunk_index,
  start_pos, start_pos + length(text) as end_pos, text, sha256(text) as text_hash from c2 where length(text) >= 20)
"""
)

SENTENCES = """
s0 as (select doc_id, source, english, i, pos, regexp_extract_all(line, '[^.!?。！？；]*[.!?。！？；]|[^.!?。！？；]+') as l from lines where length(line) > 0),
s1 as (select doc_id, source, english, i, pos, unnest(l) as part, unnest(generate_series(1, len(l))) as k from s0),
s2 as (select *, pos + coalesce(sum(length(part)) over (partition by doc_id, i order by k rows between unbounded preceding and 1 preceding), 0)::bigint as p from s1),
s3 as (select doc_id, source, english, trim(part) as text, p + length(part) - length(ltrim(part)) as start_pos from s2),
sentences as (select doc_id, source, row_number() over (partition by doc_id order by start_pos) - 1 as chunk_index,
  start_pos, start_pos + length(text) as end_pos, text, sha256(text) as text_hash from s3 where length(text) >= case when english then 40 else 20 end)
"""


def parents(by: str = "start") -> str:
    far = "abs(s.start_pos - p.start_pos)" if by == "start" else "abs(s.start_pos + s.end_pos - p.start_pos - p.end_pos)"
    return f"""
best as (select doc_id, chunk_index, parent_index from (
  select s.doc_id, s.chunk_index, p.chunk_index as parent_index, row_number() over (partition by s.doc_id, s.chunk_index order by
    case when s.start_pos >= p.start_pos and s.end_pos <= p.end_pos then 0 else 1 end,
    case when s.start_pos >= p.start_pos and s.end_pos <= p.end_pos then 0 else {far} end, p.start_pos) as n
  from sentences s join paragraphs p using (doc_id)) where n = 1)
"""


def shingled(table: str, key: str) -> str:
    """(key, shingle) distinct, of (key, text) rows."""
    return f"""
t0 as (select {key}, text as raw, lower(regexp_replace(text, '\\s+', ' ', 'g')) as t from {table}),
t1 as (select {key}, unnest(case when length(raw) < 3 then [raw] else list_transform(generate_series(1, greatest(len(c) - 2, 1)), lambda i: c[i] || coalesce(c[i + 1], '') || coalesce(c[i + 2], '')) end) as shingle, length(raw) < 3 as short
  from (select *, string_split(t, '') as c from t0)),
grams as (select distinct {key}, shingle from t1 where short or trim(shingle) <> '')
"""


def signed(key: str) -> str:
    """signatures(key, i, v) from grams(key, shingle)."""
    a, b = coefficient_pairs()
    rows = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a, b, strict=True)))
    half = lambda k: f"('0x' || substr(sha256(shingle), {k}, 8))::bigint"
    return f"""
coefficients(i, a, b) as (values {rows}),
vocabulary as (select shingle, (5 * {half(1)} + {half(9)}) % {PRIME} as h from (select distinct shingle from grams)),
hashed as (select shingle, i, ((((a // 65536) * h) % {PRIME}) * 65536 + (a % 65536) * h + b) % {PRIME} as v from vocabulary, coefficients),
signatures as (select {key}, i, min(v) as v from grams join hashed using (shingle) group by {key}, i)
"""


def banded(key: str) -> str:
    return f"bands as (select {key}, i // 3 as band, string_agg(v::varchar, ',' order by i) as band_key from signatures group by {key}, i // 3 having i // 3 < {BANDS})"


SEMANTIC = """
unit as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
normed as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as n from unit),
sem0 as (select l.label, l.vec_id as left_chunk, r.vec_id as right_chunk,
  round(list_dot_product(list_transform(l.v, lambda x: x / l.n), list_transform(r.v, lambda x: x / r.n)), 6) as semantic_score
  from normed l join normed r on l.label = r.label and l.vec_id <> r.vec_id),
sem1 as (select *, row_number() over (partition by label, left_chunk order by semantic_score desc, right_chunk desc) as n from sem0)
"""

STRATEGY = (
    SEMANTIC
    + """,
matches as (select label as pair_id, left_chunk as left_parent, right_chunk as right_parent, semantic_score as final_score,
  left_chunk as left_start, right_chunk as right_start from sem1 where n <= 20 and semantic_score >= 0.1),
ranked as (select *, row_number() over (partition by pair_id, left_parent order by final_score desc, left_start, right_start) as nl,
  row_number() over (partition by pair_id, right_parent order by final_score desc, left_start, right_start) as nr,
  max(final_score) over (partition by pair_id, left_parent) as bl, max(final_score) over (partition by pair_id, right_parent) as br from matches)
"""
)

REUSE = (
    PARAGRAPHS
    + ","
    + SENTENCES
    + ","
    + parents()
    + """,
placed as (select s.*, b.parent_index, p.start_pos as parent_start, p.end_pos - p.start_pos as parent_length
  from sentences s join best b using (doc_id, chunk_index) join paragraphs p on p.doc_id = s.doc_id and p.chunk_index = b.parent_index),
hits as (select l.doc_id || '-' || r.doc_id as pair_id, l.doc_id as left_document_id, r.doc_id as right_document_id, l.parent_index as left_parent, r.parent_index as right_parent,
  l.chunk_index as left_chunk, r.chunk_index as right_chunk, l.parent_start as left_start, r.parent_start as right_start,
  l.parent_length as left_length, r.parent_length as right_length, length(l.text) as size
  from placed l join placed r on l.source = r.source and l.text_hash = r.text_hash and l.doc_id < r.doc_id),
groups as (select pair_id, left_document_id, right_document_id, left_parent, right_parent, 1.0::double as final_score, count(*) as match_count, count(distinct size) as span_count,
  any_value(left_start) as left_start, any_value(right_start) as right_start,
  round(max(size) / greatest(least(any_value(left_length), any_value(right_length)), 1), 4) as alignment_ratio
  from hits group by all)
"""
)


def _sentences(parts: str) -> str:
    """parts: s1(doc_id, source, english, i, pos, part, k) with the text of each part."""
    return f"""
{parts},
s2 as (select *, pos + coalesce(sum(length(part)) over (partition by doc_id, i order by k rows between unbounded preceding and 1 preceding), 0)::bigint as p from s1),
"""


_LAST = """
s3 as (select doc_id, source, english, trim(part, ' ' || chr(9)) as text, p + length(part) - length(ltrim(part, ' ' || chr(9))) as start_pos from {0}),
sentences as (select doc_id, source, row_number() over (partition by doc_id order by start_pos) - 1 as chunk_index,
  start_pos, start_pos + length(text) as end_pos, text, sha256(text) as text_hash from s3 where length(text) >= case when english then 40 else 20 end)
"""

#: A point after a digit, but at the end of a line, is set aside while the line is split.
PROTECTED = (
    _sentences(
        """
s0 as (select doc_id, source, english, i, pos, regexp_replace(regexp_replace(line, '([0-9])[.]', '\\1' || chr(1), 'g'), chr(1) || '$', '.') as line from lines where length(line) > 0),
s1 as (select doc_id, source, english, i, pos, replace(part, chr(1), '.') as part, k from (select doc_id, source, english, i, pos, unnest(l) as part, unnest(generate_series(1, len(l))) as k
  from (select *, regexp_extract_all(line, '[^.!?。！？；]*[.!?。！？；]|[^.!?。！？；]+') as l from s0)))"""
    )
    + _LAST.format("s2")
)

MERGED = (
    _sentences(
        """
s0 as (select doc_id, source, english, i, pos, regexp_extract_all(line, '[^.!?。！？；]*[.!?。！？；]|[^.!?。！？；]+') as l from lines where length(line) > 0),
s1 as (select doc_id, source, english, i, pos, unnest(l) as part, unnest(generate_series(1, len(l))) as k, len(l) as n from s0)"""
    )
    + """
m0 as (select *, case when contains(trim(part), ' ') then len(list_filter(regexp_split_to_array(part, '\\s+'), lambda x: x <> '')) else len(regexp_extract_all(part, '[㐀-鿿]|[^\\s㐀-鿿]+')) end as size from s2),
m1 as (select *, sum(case when k = 1 or k = n or size >= 4 or contains(part, '！') or contains(part, '？') then 1 else 0 end) over (partition by doc_id, i order by k) as island from m0),
m2 as (select doc_id, any_value(source) as source, any_value(english) as english, i, string_agg(part, '' order by k) as part, min(p) as p from m1 group by doc_id, i, island),
"""
    + _LAST.format("m2")
)


def embedded(table: str) -> str:
    """cells(text_hash, cell, n): counts of the hashed character grams of table(text_hash, text)."""
    return f"""
e0 as (select text_hash, string_split(lower(text), '') as c from {table}),
e1 as (select text_hash, unnest(list_transform(generate_series(1, greatest(len(c) - 2, 1)), lambda i: c[i] || coalesce(c[i + 1], '') || coalesce(c[i + 2], ''))) as g from e0),
e2 as (select g, ('0x' || substr(md5(g), 1, 8))::bigint % 256 as cell from (select distinct g from e1)),
cells as (select text_hash, cell, count(*) as n from e1 join e2 using (g) group by text_hash, cell)"""


def _metrics(found: str) -> str:
    """found: rows (source, left_document_id, right_document_id, left_parent, right_parent, score, left_size, right_size, left_length, right_length)."""
    return f"""
found as ({found}),
g as (select left_document_id, right_document_id, left_parent, right_parent, round(max(score), 4) as score,
  round(least(max(left_size), max(right_size)) / greatest(least(any_value(left_length), any_value(right_length)), 1), 4) as ratio, any_value(left_start) as left_start, any_value(right_start) as right_start from found group by all)"""


def _out(groups: str) -> str:
    return f"""
m as (select left_document_id, right_document_id, count(*) as group_count, max(score) as top_score, sum(ratio) as total from {groups} group by all)
select l.doc_id || '-' || r.doc_id as pair_id, l.doc_id as left_document_id, r.doc_id as right_document_id, coalesce(group_count, 0) as group_count, round(coalesce(top_score, 0.0), 4) as top_score,
  round(coalesce(total, 0.0), 4) as aggregate_alignment
from documents l join documents r on l.source = r.source and l.doc_id < r.doc_id left join m on m.left_document_id = l.doc_id and m.right_document_id = r.doc_id"""


_AS_PARAGRAPHS = "compared as materialized (select doc_id, source, chunk_index, text_hash, text, chunk_index as parent_index, start_pos as parent_start, end_pos - start_pos as parent_length from paragraphs)"
_AS_SENTENCES = f"""{SENTENCES}, {parents()}, compared as materialized (
  select s.doc_id, s.source, s.chunk_index, s.text_hash, s.text, b.parent_index, p.start_pos as parent_start, p.end_pos - p.start_pos as parent_length
    from sentences s join best b using (doc_id, chunk_index) join paragraphs p on p.doc_id = s.doc_id and p.chunk_index = b.parent_index
  union all select doc_id, source, chunk_index, text_hash, text, chunk_index, start_pos, end_pos - start_pos from paragraphs where doc_id not in (select doc_id from best where parent_index is not null))"""
_TEXTS = "texts as materialized (select text_hash, any_value(text) as text from compared group by text_hash), here as (select distinct source, text_hash from compared)"


_MINHASH = """
    placed_bands as (select source, text_hash, band, band_key from bands join here using (text_hash)),
    pairs as materialized (select distinct l.source, l.text_hash as a, r.text_hash as b from placed_bands l join placed_bands r on l.source = r.source and l.band = r.band and l.band_key = r.band_key and l.text_hash < r.text_hash),
    sigs as materialized (select text_hash, list(v order by i) as s from signatures group by text_hash),
    near as materialized (select p.* from pairs p join sigs x on x.text_hash = a join sigs y on y.text_hash = b where list_sum(list_transform(generate_series(1, 120), lambda k: case when x.s[k] = y.s[k] then 1 else 0 end)) / 120 >= {estimate}),
    alike as (select * from near union all select source, b, a from near union all select source, text_hash, text_hash from here),"""

_SEMANTIC = """
    v as (select text_hash, list_transform(list(coalesce(n, 0) order by c.cell), lambda x: x::double) as v from (select t.text_hash, r.cell from texts t, (select unnest(generate_series(0, 255)) as cell) r) c left join cells using (text_hash, cell) group by text_hash),
    unit as materialized (select text_hash, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from v),
    first as (select source, text_hash, min(doc_id) as doc_id from compared group by source, text_hash),
    cosines as (select x.source, x.text_hash as a, r.doc_id as right_doc, r.chunk_index as right_chunk, r.text_hash as b, round(list_dot_product(u.v, w.v), 9) as s
      from first x join unit u on u.text_hash = x.text_hash join compared r on r.source = x.source and r.doc_id > x.doc_id join unit w on w.text_hash = r.text_hash),
    best_of as materialized (select * from (select * from cosines qualify row_number() over (partition by source, a, right_doc order by s desc, right_chunk desc) <= {k}) where s >= {threshold}),"""


_BY_MINHASH = """select l.source, l.doc_id as left_doc, l.chunk_index as left_chunk, m.a, r.doc_id as right_doc, r.chunk_index as right_chunk, m.b
      from compared l join alike m on m.source = l.source and m.a = l.text_hash join scored s on s.a = least(m.a, m.b) and s.b = greatest(m.a, m.b)
      join compared r on r.source = l.source and r.text_hash = m.b where l.doc_id < r.doc_id"""
_BY_VECTORS = """select l.source, l.doc_id as left_doc, l.chunk_index as left_chunk, m.a, m.right_doc, m.right_chunk, m.b
      from best_of m join scored s on s.a = least(m.a, m.b) and s.b = greatest(m.a, m.b) join compared l on l.source = m.source and l.text_hash = m.a and l.doc_id < m.right_doc"""


def comparison(final: float, minhash: float | None = None, semantic: float | None = None, k: int = 50, granularity: str = "paragraph", stable: bool = False) -> str:
    """Candidates by MinHash (estimate) and by vectors (cosine, the k best of each left chunk and right document, ranked
    before anything else), then Jaccard of shingles, groups of paragraphs and the strategy."""
    paragraphs = granularity == "paragraph"
    signatures = f"{signed('text_hash')}, {banded('text_hash')}," + _MINHASH.format(estimate=minhash) if minhash is not None else ""
    vectors = f"{embedded('texts')}," + _SEMANTIC.format(threshold=semantic, k=k) if semantic is not None else ""
    both = ((minhash, "alike", _BY_MINHASH), (semantic, "best_of", _BY_VECTORS))
    asked = " union ".join(f"select distinct least(a, b) as a, greatest(a, b) as b from {t}" for x, t, _ in both if x is not None)
    found = " union ".join(q for x, _, q in both if x is not None)
    strategy = """
ranked as (select *, row_number() over (partition by left_document_id, right_document_id, left_parent order by score desc, left_start, right_start) as nl,
  row_number() over (partition by left_document_id, right_document_id, right_parent order by score desc, left_start, right_start) as nr from g),
kept as (select * from ranked where nl = 1 and nr = 1),"""
    matches = """select l.source, l.doc_id as left_document_id, r.doc_id as right_document_id, l.parent_index as left_parent, r.parent_index as right_parent, score, length(l.text) as left_size, length(r.text) as right_size,
  l.parent_length as left_length, r.parent_length as right_length, l.parent_start as left_start, r.parent_start as right_start
  from union_of c join scored s on s.a = least(c.a, c.b) and s.b = greatest(c.a, c.b) join compared l on l.doc_id = c.left_doc and l.chunk_index = c.left_chunk join compared r on r.doc_id = c.right_doc and r.chunk_index = c.right_chunk"""
    return f"""with recursive {PARAGRAPHS}, {_AS_PARAGRAPHS if paragraphs else _AS_SENTENCES}, {_TEXTS}, {shingled("texts", "text_hash")}, {signatures} {vectors}
    sets as materialized (select text_hash, list(shingle) as g, count(*) as n from grams group by text_hash),
    asked as ({asked}),
    jac as (select p.*, len(list_intersect(x.g, y.g)) as k, x.n as xn, y.n as yn from asked p join sets x on x.text_hash = a join sets y on y.text_hash = b),
    scored as materialized (select a, b, k / (xn + yn - k) as score from jac where k / (xn + yn - k) >= {final}),
    union_of as ({found}), {_metrics(matches)}, {strategy if stable else ""} {_out("kept" if stable else "g")}"""


def captured(final: float, minhash: float) -> str:
    """Rows before and after the stages of a comparison by MinHash: a pair of texts counts both ways round, a text once by
    itself."""
    whole = comparison(final, minhash=minhash)
    return whole[: whole.index("    union_of as (")] + f"""
    chunks_of as (select source, doc_id, count(*) as n from compared group by all),
    possible as (select sum(n) as n from (select cast((sum(n) * sum(n) - sum(n * n)) / 2 as bigint) as n from chunks_of group by source)),
    found as (select count(*) as n from alike), asked_for as (select count(*) as n from (select distinct a, b from near)),
    kept as (select count(*) as n from alike m join scored s on s.a = least(m.a, m.b) and s.b = greatest(m.a, m.b))
    select 0 as step, 'minhash_recall' as stage, p.n::bigint as before, f.n as after, 0::bigint as api_calls, 0::bigint as cache_hits, round(1 - f.n / p.n, 6) as reduction_rate from possible p, found f
    union all select 1, 'score_candidates', f.n, f.n, a.n, f.n - a.n, 0.0 from found f, asked_for a
    union all select 2, 'final_filter', f.n, k.n, 0, 0, round(1 - k.n / f.n, 6) from found f, kept k"""
