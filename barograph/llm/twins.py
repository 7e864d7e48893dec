"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from barograph.llm.licenses import RULES, SENTENCES

EXACT = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

MIX = """
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         md5(coalesce(doc_id::varchar, '')) as tie from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from rows group by source),
ordered as (
  select *, 2.0::double * source_size as most,
         coalesce(sum(2.0::double * source_size) over before, 0) as filled,
         sum(weight) over () - coalesce(sum(weight) over before, 0) as weight_left,
         1.5::double * sum(source_size) over () as budget
  from sources
  window before as (order by 2.0::double * source_size / weight, source nulls last
                    rows between unbounded preceding and 1 preceding)),
levels as (select *, (budget - filled) / weight_left as level from ordered),
opened as (select min_by(level, filled) as open_level from levels where level * weight <= most),
goals as (
  select source, source_size,
         case when level * weight <= most then open_level * weight else most end as target,
         case when source_size > 0
              then (case when level * weight <= most then open_level * weight else most end) / source_size else 0 end as rate,
         ('0x' || substr(md5('0/' || coalesce(source, '/none')), 1, 8))::bigint / 4294967296.0::double as shift
  from levels left join opened on true),
ranked as (
  select doc_id, size, source_size, target, rate, shift,
         row_number() over (partition by rows.source order by size desc, tie, doc_id) - 1 as rank
  from rows join goals on rows.source is not distinct from goals.source),
drawn as (
  select *, (floor((rank + 1) * rate + shift) - floor(rank * rate + shift))::bigint as copies from ranked)
select doc_id, size::bigint as size, source_size, target, (copies * size)::bigint as taken, copies from drawn
"""


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OVERLAP = f"""
with docs as (select row_number() over () as row, doc_id,
                     regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
items as (select coalesce(item_id::varchar, '') as item,
                 regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
cut as (select item, ws, unnest(range(greatest(1, len(ws) - 9))) as i from items where len(ws) > 0),
strings as (select distinct item, least(10, len(ws)) as m, array_to_string(ws[i + 1 : i + 10], ' ') as s from cut),
places as (select row, ws, m, unnest(range(len(ws) - m + 1)) as i
           from docs, (select distinct m from strings) where len(ws) >= m),
hits as (select row, i, m, item from (select row, i, m, array_to_string(ws[i + 1 : i + m], ' ') as s from places)
         join strings using (m, s)),
covered as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + m)) as p from hits) group by row),
listed as (select row, count(*) as n_items, string_agg(item, ',' order by item) as names
           from (select distinct row, item from hits) group by row)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (row) left join listed using (row)
"""

NEAR = f"""
with recursive docs as (select doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
cut as (select doc_id, ws, unnest(range(greatest(1, len(ws) - 1))) as i from docs where len(ws) > 0),
shingles as (select distinct doc_id, array_to_string(ws[i + 1 : i + 2], ' ') as s from cut),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b using (s)
           where a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
          where 100 * k >= 80 * (x.n + y.n - k)),
reached(a, b) as (select doc_id, doc_id from docs union select reached.a, links.b from reached join links on reached.b = links.a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, low as component_id, doc_id = low as kept
from docs left join sizes using (doc_id) join (select a as doc_id, min(b) as low from reached group by a) using (doc_id)
"""


def _licence_sql() -> str:
    names = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    left, hits = "' ' || coalesce(string_agg(id, '  ' order by n), '') || ' '", []
    stages, last = [f"marked0 as (select doc_id, row, max(n_all) as n_sentences, "
                    f"coalesce(string_agg(id, ',' order by n), '') as sentence_ids, {left} as m from hits group by all)"], 0
    for k, (sequence, name) in enumerate(RULES):
        mark = " " + "  ".join(sequence) + " "
        hits.append(f"h{k}")
        stages.append(f"marked{k + 1} as (select * exclude (m), case when contains(m, '{mark}') then '{name}' end as h{k}, "
                      f"replace(m, '{mark}', ' / ') as m from marked{k})")
        last = k + 1
    listed = ", ".join(hits)
    return f"""
with known(sentence, id) as (values {names}),
docs as (select doc_id, row_number() over () as row, regexp_split_to_array(
           regexp_replace(coalesce(text, ''), '([.!?;])[ \\t]+', '\\1' || chr(10), 'g'), '[\\n\\r]+') as pieces
         from documents),
cut as (select doc_id, row, list_filter(pieces, lambda s: length(trim(s)) > 0) as pieces from docs),
numbered as (select doc_id, row, len(pieces) as n_all, unnest(case when len(pieces) > 0 then pieces else [null] end) as s,
                    unnest(case when len(pieces) > 0 then range(len(pieces)) else [0] end) as n from cut),
clean as (select doc_id, row, n_all, n, trim(regexp_replace(
            translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) as sentence from numbered),
named as (select * replace (regexp_replace(sentence, 'neither the name of (?:[^ ]+ ){{1,20}}?nor the names of its contributors',
            'neither the name of the copyright holder nor the names of its contributors') as sentence) from clean),
hits as (select doc_id, row, n_all, n, id from named left join known using (sentence)),
{", ".join(stages)}
select doc_id, n_sentences::bigint as n_sentences, sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{listed}], lambda x: x is not null))), ',') as licences
from marked{last}
"""


NEGATIVES = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
         list_transform(embedding, lambda x: floor(256.0::double * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from vectors a join vectors b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id,
       row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""


TWINS = {"op4_decontamination": OVERLAP, "op5_near_dedup": NEAR, "op6_exact_dedup": EXACT, "op9_license_scan": _licence_sql(), "op10_mixing": MIX,
         "op11_hard_negatives": NEGATIVES}
