"""SQL with the same results as the queries, for those that SQL can express."""

from __future__ import annotations

_P5 = """
with t as (
  select distinct text_id, sent_no, tok_no, freq, journal from relfreq_reviews where trim(freq, ' ') <> ''
), e as (
  select 'relfreq_reviews' as src_table, lower(trim(freq, ' ')) as term, text_id as record, 1 as n from t
  union all
  select 'chunk', unnest(map_keys(unigram_counts)), chunk_key, unnest(map_values(unigram_counts)) from chunk
), c as (
  select src_table, term, cast(sum(coalesce(n, 0)) as bigint) as occurrences, count(distinct record) as records from e group by all
), s as (
  select 'relfreq_reviews' as src_table, count(distinct text_id) as total from relfreq_reviews
  union all select 'chunk', count(*) from chunk
), m as (
  select src_table, term, occurrences, records,
    case when records < 3 then 'rare' when records > 0.25 * total then 'common' end as mark
  from c join s using (src_table)
)
"""

_P1 = r"""
with recursive b as (select distinct id, file_name, author_viaf from ger_texts_meta where id is not null),
k as (
  select id, 'n:' || replace(replace(replace(lower(split_part(file_name, '_', 1) || '_' || split_part(file_name, '_', 2)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue') as k from b where file_name is not null
  union
  select id, 'v:' || v from (
    select id, regexp_replace(regexp_replace(trim(unnest(string_split_regex(author_viaf, '[;|/,&+]'))), '\.0+$', ''), '[^0-9]', '', 'g') as v from b
  ) where length(v) >= 3 and replace(v, v[1], '') <> ''
),
e as (select distinct x.id as a, y.id as b from k x join k y using (k)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
g as (select a as id, min(b) as group_id from r group by a)
select group_id, id from g where id > group_id
"""

_P2 = """
with v as (
  select distinct 'doc2vec_chunk_embedding' as f, chunk_key as k, list_transform(doc2vec_chunk_embedding, lambda x: x::double) as v from chunk where doc2vec_chunk_embedding is not null
  union
  select distinct 'average_sentence_embedding', chunk_key, list_transform(average_sentence_embedding, lambda x: x::double) from chunk_features where average_sentence_embedding is not null
), u as (select * from v where len(list_filter(v, lambda x: isnan(x))) = 0),
n as (
  select f, a.k as a, b.k as b, row_number() over (partition by f, a.k order by list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.k) as r
  from u a join u b using (f) where a.k <> b.k
)
select distinct f as vec_field, least(a, b) as key_a, greatest(a, b) as key_b from n where r <= 5
"""

#: The SQL of p1_found and p2_found compares all pairs, which is meant for the small tables of the check only.
ORACLE = {
    "p1_found": _P1,
    "p2_found": _P2,
    "p4_found": """
select distinct 'raw_docs' as src_table, raw_id as item_key from raw_docs
where length(doc) > (select max_size from size_limits where src_table = 'raw_docs')
union
select distinct 'chunk', chunk_key from chunk
where len(sbert_sentence_embeddings) > (select max_size from size_limits where src_table = 'chunk')
""",
    "p5_counts": _P5 + "select * from m",
    "p5_found": _P5 + "select src_table, term, mark from m where mark is not null",
}
