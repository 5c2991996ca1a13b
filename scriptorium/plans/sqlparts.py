"""SQL pieces that the checks share: the text steps written out for DuckDB."""

from __future__ import annotations

from scriptorium.functions import text as tx
from scriptorium.operators import corpus

SIZE = 5


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return ", ".join(map(quoted, words))


def transliterated(x: str) -> str:
    for a, b in tx.SEVERAL.items():
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return f"translate({x}, {quoted(tx.ALL_FROM)}, {quoted(tx.ALL_TO)})"


def normalised(x: str) -> str:
    return f"trim(regexp_replace({transliterated(f'lower({x})')}, '[^a-zA-Z]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


_clean = "replace(replace(replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' '), '   ', ' '), '  ', ' ')"
_cut = rf"string_split(regexp_replace({_clean}, '([.!?]) +', '\1' || chr(10), 'g'), chr(10))"
_sents = f"list_filter(list_transform({_cut}, lambda s: trim(s)), lambda s: length(s) >= 4)"

DOCS = f"d0 as (select doc_id, lang, source, genre, pub_year, {_sents} as sentences from documents where text is not null)"
SENTENCES = DOCS + ", sent as (select doc_id, unnest(generate_series(1, len(sentences))) - 1 as sent_idx, unnest(sentences) as sentence from d0)"
CHUNKS = DOCS + f""", c0 as (
  select doc_id, lang, genre, sentences, unnest(range(0, greatest(1, len(sentences) // {SIZE}))) as chunk_id from d0 where len(sentences) > 0
), chunks as (
  select doc_id, lang, genre, cast(chunk_id as integer) as chunk_id, sentences[chunk_id * {SIZE} + 1 : chunk_id * {SIZE} + {SIZE}] as sentences from c0
)"""
TOKENS = CHUNKS + f", tk as (select doc_id, genre, chunk_id, sentences, list_transform(sentences, lambda s: {words(normalised('s'))}) as toks from chunks)"


def grams(n: int) -> str:
    """CTEs up to g<n> (doc_id, chunk_id, gram, cnt)."""
    if n == 1:
        each = "flatten(toks)"
    else:
        bos, eos = (f"[{', '.join([quoted(m)] * (n - 1))}]" for m in ("<BOS>", "<EOS>"))
        each = f"flatten(list_transform(toks, lambda t: list_concat({bos}, t, {eos})))"
        parts = " || ' ' || ".join(f"f[i + {k}]" if k else "f[i]" for k in range(n))
        return f"p{n} as (select doc_id, chunk_id, {each} as f from tk), q{n} as (select doc_id, chunk_id, unnest(list_transform(range(1, len(f) - {n - 2}), lambda i: {parts})) as gram from p{n}), g{n} as (select doc_id, chunk_id, gram, count(*) as cnt from q{n} group by all)"
    return f"q1 as (select doc_id, chunk_id, unnest({each}) as gram from tk), g1 as (select doc_id, chunk_id, gram, count(*) as cnt from q1 group by all)"


def tag(w: str) -> str:
    return f"""case when {w} in ({listed(corpus.DETERMINERS)}) then 'DET' when {w} in ({listed(corpus.PRONOUNS)}) then 'PRON'
 when {w} in ({listed(corpus.ADPOSITIONS)}) then 'ADP' when {w} in ({listed(corpus.CONJUNCTIONS)}) then 'CONJ'
 when regexp_matches({w}, 'ly$') then 'ADV' when regexp_matches({w}, '(ed|ing|te|ten|ait)$') then 'VERB'
 when regexp_matches({w}, '(ful|ous|ig|lich|igen|lichen|ique)$') then 'ADJ' else 'NOUN' end"""


def entropy(c: str = "cnt") -> str:
    return f"ln(sum({c})::double) - sum({c}::double * ln({c}::double)) / sum({c})::double"


def count_of(t: str, pattern: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, {quoted(pattern)}, '', 'g')))"


def ratio(a: str, b: str) -> str:
    return f"({a})::double / nullif(({b})::double, 0)"


EMB = "e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"
CENT = EMB + """, m as (
  select label, i, avg(x) as m, count(*) as n from (select label, unnest(v) as x, unnest(generate_series(1, len(v))) as i from e) group by all
), cent as (select label, max(n) as n, list(m order by i) as c from m group by label)"""


def distance(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"

#: Greedy packing of sentences into paragraphs of at most 60 words, CTEs up to p (doc_id, para_id, paragraph).
PACKED = """s as (select doc_id, unnest(generate_series(1, len(sentences))) as i, unnest(sentences) as x from d0),
n as (select doc_id, i, x, len(list_filter(string_split(x, ' '), lambda w: w <> '')) as k from s), o as (select doc_id, row_number() over (partition by doc_id order by i) as i, x, k from n where k <= 60),
r(doc_id, i, para, k, x) as (select doc_id, i, 0, k, x from o where i = 1 union all
 select o.doc_id, o.i, case when r.k + o.k <= 60 or r.k = 0 then r.para else r.para + 1 end, case when r.k + o.k <= 60 or r.k = 0 then r.k + o.k else o.k end, o.x from r join o on o.doc_id = r.doc_id and o.i = r.i + 1),
p as (select doc_id, para::int as para_id, array_to_string(list(x order by i), ' ') as paragraph from r group by all)"""
