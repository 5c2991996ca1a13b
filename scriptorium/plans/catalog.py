"""All queries of the core by name, and SQL with the same results for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions import vectors as vx
from scriptorium.operators import chunks, corpus, describe, features, folds, geometry, labels, metrics, models, ngrams, sentiment, stylometry
from scriptorium.plans import sqlparts as sq
from scriptorium.session import materialize, spread, table

SIZE, KEYS = sq.SIZE, ["doc_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# A small polarity lexicon for the checks; real ones are given by the caller.
POLARITY = {"warmth": 0.6, "wit": 0.8, "grace": 0.9, "truth": 0.7, "tedium": -0.8, "coldness": -0.5, "vexation": -0.7, "anmuth": 0.9, "witz": 0.8, "langeweile": -0.8, "verdruss": -0.7, "esprit": 0.8, "ennui": -0.8, "froideur": -0.5}
LEXICON = {"warmth": 0.31, "garden": 0.12, "tower": -0.05, "tedium": -0.42, "witz": 0.27, "garten": 0.11, "turm": -0.06, "ennui": -0.37, "jardin": 0.1, "grace": 0.33}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "genre", "pub_year"))


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_rows(docs(spark, d), KEYS, SIZE)


def counts(spark: SparkSession, d: str, n: int) -> DataFrame:
    return ngrams.chunk_counts(doc_chunks(spark, d), KEYS, n)


# Sentences and chunks


@query(f"with {sq.SENTENCES} select doc_id, sent_idx::integer as sent_idx, sentence from sent")
def sentence_split(spark, d):
    return chunks.sentence_rows(docs(spark, d), "doc_id")


@query(f"with {sq.CHUNKS} select doc_id, chunk_id, len(sentences)::bigint as n_sentences, array_to_string(sentences, ' ') as raw_text from chunks")
def chunk_assign(spark, d):
    return doc_chunks(spark, d).select("doc_id", "chunk_id", F.size("sentences").cast("bigint").alias("n_sentences"), chunks.raw_text().alias("raw_text"))


@query(f"""with {sq.DOCS}, w as (select doc_id, sentences, unnest(range(0, greatest(0, floor((len(sentences) - 6) / 3.0)::bigint) + 1)) as win_id from d0 where len(sentences) > 0)
select doc_id, win_id::integer as win_id, len(sentences[win_id * 3 + 1 : win_id * 3 + 6])::bigint as n_sentences, sentences[win_id * 3 + 1] as first_sentence from w""")
def hopping_chunks(spark, d):
    h = chunks.hopping_rows(docs(spark, d), KEYS, 6, 3)
    return h.select("doc_id", "win_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.col("sentences")[0].alias("first_sentence"))


@query(f"with {sq.SENTENCES} select doc_id, sent_idx::integer as sent_idx, {sq.normalised('sentence')} as norm from sent")
def normalised_sentences(spark, d):
    return chunks.sentence_rows(docs(spark, d), "doc_id").select("doc_id", "sent_idx", tx.normalised(F.col("sentence")).alias("norm"))


@query(f"with recursive {sq.DOCS}, {sq.PACKED} select doc_id, para_id, paragraph from p")
def packed_paragraphs(spark, d):
    return chunks.packed_paragraphs(docs(spark, d), KEYS, 60, keep_open=True)


# n-grams


def _gram_query(n: int):
    def f(spark, d):
        return counts(spark, d, n)

    f.__name__ = ("unigram_counts", "bigram_counts", "trigram_counts")[n - 1]
    query(f"with {sq.TOKENS}, {sq.grams(n)} select * from g{n}")(f)


for _n in (1, 2, 3):
    _gram_query(_n)


@query(f"with {sq.CHUNKS}, x as (select doc_id, chunk_id, unnest(string_split({sq.transliterated('''array_to_string(sentences, ' ')''')}, '')) as ch from chunks) select doc_id, chunk_id, ch, count(*) as cnt from x where ch <> '' group by all")
def char_counts(spark, d):
    return ngrams.char_counts(doc_chunks(spark, d), KEYS)


@query(f"with {sq.TOKENS}, {sq.grams(2)} select doc_id, gram, sum(cnt)::bigint as cnt from g2 group by all")
def book_bigram_counts(spark, d):
    return ngrams.book_counts(counts(spark, d, 2), KEYS)


@query(f"with {sq.TOKENS}, {sq.grams(1)} select gram, sum(cnt)::bigint as cnt from g1 group by all")
def corpus_unigram_counts(spark, d):
    return ngrams.corpus_counts(counts(spark, d, 1))


@query(f"with {sq.TOKENS}, {sq.grams(2)} select gram, sum(cnt)::bigint as cnt from g2 group by all order by cnt desc, gram limit 2000")
def corpus_top_bigrams(spark, d):
    return ngrams.top(ngrams.corpus_counts(counts(spark, d, 2)), 2000)


@query(f"with {sq.TOKENS}, {sq.grams(3)}, t as (select gram, sum(cnt) as n from g3 group by all order by n desc, gram limit 2000) select doc_id, gram, sum(cnt)::bigint as cnt from g3 semi join t using (gram) group by all")
def book_top_trigrams(spark, d):
    c = counts(spark, d, 3)
    return ngrams.book_counts(ngrams.restricted(c, ngrams.top(ngrams.corpus_counts(c), 2000)), KEYS)


@query(f"with {sq.TOKENS}, {sq.grams(1)}, df as (select gram, count(distinct doc_id) as df from g1 group by all), n as (select count(*) as n from documents) select gram, df from df, n where df between round_even(0.05 * n, 0) and round_even(0.5 * n, 0)")
def doc_frequency_filter(spark, d):
    return ngrams.vocabulary(counts(spark, d, 1), "doc_id", n_docs=docs(spark, d).agg(F.count(F.lit(1))), min_percent=5, max_percent=50)


@query(f"with {sq.TOKENS}, w as (select unnest(flatten(toks)) as word from tk) select word, count(*) as cnt, round(count(*)::double / (select count(*) from w), 9) as freq from w group by word")
def relative_frequency(spark, d):
    words = chunks.with_tokens(doc_chunks(spark, d)).select(F.explode(F.flatten("toks")).alias("word"))
    return ngrams.relative_frequency(words).withColumn("freq", F.round("freq", 9))


# Features of chunks


@query(f"""with {sq.CHUNKS}, x as (select doc_id, chunk_id, {sq.transliterated("array_to_string(sentences, ' ')")} as t from chunks)
select doc_id, chunk_id, length(t)::bigint as text_length,
""" + ",\n".join(f"round({sq.ratio(sq.count_of('t', p), 'length(t)')}, 6) as {n}" for n, p in (
    ("ratio_of_punctuation_marks", tx.PUNCTUATION), ("ratio_of_digits", "[0-9]"), ("ratio_of_whitespaces", " "), ("ratio_of_exclamation_marks", "!"), ("ratio_of_question_marks", r"\?"), ("ratio_of_commas", ",")))
    + f", round({sq.ratio(sq.count_of('t', '[A-Z]'), sq.count_of('t', '[A-Za-z]'))}, 6) as ratio_of_uppercase_letters from x")
def char_ratios(spark, d):
    f = stylometry.char_features(doc_chunks(spark, d), KEYS)
    return r6(f, *(c for c in f.columns if c.startswith("ratio")))


@query(f"""with {sq.TOKENS}, x as (select doc_id, chunk_id, list_transform(toks, lambda t: len(t)) as n, list_transform(string_split(array_to_string(sentences, ' '), chr(10)), lambda p: length(p)) as p from tk)
select doc_id, chunk_id, round(list_sum(n)::double / len(n), 6) as average_number_of_words_in_sentence, list_max(n)::bigint as maximum_number_of_words_in_sentence, round(list_sum(p)::double / len(p), 6) as average_paragraph_length from x""")
def sentence_lengths(spark, d):
    return r6(stylometry.sentence_features(doc_chunks(spark, d), KEYS), "average_number_of_words_in_sentence", "average_paragraph_length")


@query(f"""with {sq.TOKENS}, {sq.grams(1)} select doc_id, chunk_id, count(*) as types, sum(cnt)::bigint as tokens, round(count(*)::double / sum(cnt), 6) as type_token_ratio,
round(avg(length(gram) * cnt), 6) as average_word_length, round({sq.entropy()}, 6) as unigram_entropy from g1 group by all""")
def unigram_entropy(spark, d):
    return r6(stylometry.word_features(counts(spark, d, 1), KEYS), "type_token_ratio", "average_word_length", "unigram_entropy")


def _unique_query(n: int, name: str):
    def f(spark, d):
        return r6(stylometry.unique_ratio(counts(spark, d, n), KEYS, name), name)

    f.__name__ = name
    query(f"with {sq.TOKENS}, {sq.grams(n)} select doc_id, chunk_id, round(count(*)::double / sum(cnt), 6) as {name} from g{n} group by all")(f)


def _conditional_query(n: int, name: str):
    def f(spark, d):
        return r6(stylometry.conditional_entropy(counts(spark, d, n), KEYS, n, name), name)

    f.__name__ = name
    left = "split_part(gram, ' ', 1)" + (" || ' ' || split_part(gram, ' ', 2)" if n == 3 else "")
    query(f"with {sq.TOKENS}, {sq.grams(n)}, h as (select doc_id, chunk_id, {left} as ctx, {sq.entropy()} as h from g{n} group by all) select doc_id, chunk_id, round(avg(h), 6) as {name} from h group by all")(f)


for _n, _name in ((2, "bigram"), (3, "trigram")):
    _unique_query(_n, f"ratio_of_unique_{_name}s")
    _conditional_query(_n, f"{_name}_entropy")


@query(f"""with {sq.TOKENS}, x as (select doc_id, chunk_id, len(sentences) as s, list_transform(flatten(toks), lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')))) as syl from tk)
select doc_id, chunk_id, round(206.835::double - 1.015::double * ({sq.ratio('len(syl)', 's')}) - 84.6::double * ({sq.ratio('list_sum(syl)', 'len(syl)')}), 6) as flesch_reading_ease_score,
round(0.4::double * (({sq.ratio('len(syl)', 's')}) + 100 * ({sq.ratio('len(list_filter(syl, lambda x: x >= 3))', 'len(syl)')})), 6) as gunning_fog from x""")
def readability(spark, d):
    return r6(stylometry.readability(doc_chunks(spark, d), KEYS), "flesch_reading_ease_score", "gunning_fog")


# Whole corpus


def _distance_query(name: str, n: int, vocabulary_sql: str, vocabulary):
    def f(spark, d):
        c = materialize(counts(spark, d, n), "counts")  # read for vocabulary, totals and sums
        return r6(corpus.distance_from_corpus(doc_chunks(spark, d), c, vocabulary(spark, d, c), KEYS, name), name)

    f.__name__ = name
    query(f"""with {sq.TOKENS}, {sq.grams(n)}, df as (select gram, count(distinct doc_id) as df, sum(cnt) as n from g{n} group by all), v as ({vocabulary_sql}),
u as (select * from g{n} semi join v using (gram)), t as (select gram, sum(cnt)::double as t from u group by gram), w as (select sum(t * t) as tt from t),
s as (select doc_id, chunk_id, sum(t * cnt) as tc, sum(cnt::double * cnt) as cc from u join t using (gram) group by all)
select c.doc_id, c.chunk_id, round(1 - (tc - cc) / nullif(sqrt(greatest(tt - 2 * tc + cc, 0)) * sqrt(cc), 0), 6) as {name}
from chunks c left join s on c.doc_id = s.doc_id and c.chunk_id = s.chunk_id cross join w""")(f)


_distance_query("unigram_distance", 1, "select gram from df where df >= 2", lambda spark, d, c: ngrams.vocabulary(c, "doc_id", min_docs=2))
_distance_query(
    "unigram_distance_limited", 1, "select gram from df, (select count(*) as docs from documents) where df between round_even(0.05 * docs, 0) and round_even(0.5 * docs, 0)",
    lambda spark, d, c: ngrams.vocabulary(c, "doc_id", n_docs=docs(spark, d).agg(F.count(F.lit(1))), min_percent=5, max_percent=50),
)
for _n, _name in ((2, "bigram"), (3, "trigram")):
    _distance_query(
        f"{_name}_distance", _n, "select gram from (select * from df order by n desc, gram limit 2000) where df >= 2",
        lambda spark, d, c: ngrams.vocabulary(ngrams.restricted(c, ngrams.top(ngrams.corpus_counts(c), 2000)), "doc_id", min_docs=2),
    )

_TAGS = f"{sq.TOKENS}, tg as (select doc_id, chunk_id, list_transform(toks, lambda s: list_transform(s, lambda w: {sq.tag('w')})) as tags from tk)"
_SHARES = "c as (select doc_id, chunk_id, gram, count(*) as cnt from q group by all), top as (select gram, sum(cnt) as n from c group by gram order by n desc, gram limit 100) select doc_id, chunk_id, gram, round(cnt::double / sum(cnt) over (partition by doc_id, chunk_id), 6) as share from c semi join top using (gram)"


def _tagged(spark, d):
    return corpus.with_tags(chunks.with_tokens(doc_chunks(spark, d)))


def _tag_query(n: int, name: str):
    def f(spark, d):
        return r6(ngrams.selected_shares(corpus.tag_counts(_tagged(spark, d), KEYS, n), KEYS, 100), "share")

    f.__name__ = f"pos_{name}_distribution"
    if n == 1:
        each = "unnest(flatten(tags))"
    else:
        bos, eos = (f"[{', '.join([sq.quoted(m)] * (n - 1))}]" for m in ("BOS", "EOS"))
        parts = " || '_' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
        each = f"unnest(flatten(list_transform(list_transform(tags, lambda s: list_concat({bos}, s, {eos})), lambda t: list_transform(range(1, len(t) - {n - 2}), lambda i: {parts}))))"
    query(f"with {_TAGS}, q as (select doc_id, chunk_id, {each} as gram from tg), {_SHARES}")(f)


for _n, _name in ((1, "unigram"), (2, "bigram"), (3, "trigram")):
    _tag_query(_n, _name)


@query(rf"""with {_TAGS}, l as (select doc_id, chunk_id, list_transform(list_filter(tags, lambda t: len(t) > 0), lambda t: array_to_string(t, ' ') || ' ') as ls from tg),
q as (select doc_id, chunk_id, unnest(flatten(list_transform(ls, lambda s: list_concat(list_transform(regexp_extract_all(s, '(?:DET )?(?:ADJ )*(?:NOUN )+'), lambda p: 'NP->' || replace(trim(p), ' ', '_')),
['S->' || replace(trim(regexp_replace(s, '(?:DET )?(?:ADJ )*(?:NOUN )+', 'NP ', 'g')), ' ', '_')])))) as gram from l), {_SHARES}""")
def production_distribution(spark, d):
    return r6(ngrams.selected_shares(corpus.production_counts(_tagged(spark, d), KEYS), KEYS, 100), "share")


# Geometry of embeddings


def _emb(spark, d):
    return table(spark, d, "embeddings")


@query(f"with {sq.CENT} select label, n::bigint as n, list_transform(c, lambda x: round(x, 6)) as centroid from cent")
def centroid(spark, d):
    return geometry.centroids(_emb(spark, d), "label", "embedding").select("label", "n", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"with {sq.CENT} select label, round(avg({sq.distance('v', 'c')}), 6) as intra_textual_variance from e join cent using (label) group by label")
def intra_variance(spark, d):
    return r6(geometry.spread(_emb(spark, d), "label", "embedding"), "intra_textual_variance")


@query(f"with {sq.EMB}, s as (select label, {sq.distance('v', 'lag(v) over (partition by label order by vec_id)')} as s from e) select label, round(coalesce(avg(s), 0), 6) as stepwise_distance from s group by label".replace(
    sq.distance("v", "lag(v) over (partition by label order by vec_id)"), sq.distance("v", "p")).replace("from e)", "from (select *, lag(v) over (partition by label order by vec_id) as p from e) where p is not null)"))
def stepwise_distance(spark, d):
    return r6(geometry.stepwise(_emb(spark, d), "label", "vec_id", "embedding"), "stepwise_distance")


@query(f"""with {sq.CENT}, k as (select cent.label, n, e.label as owner, row_number() over (partition by cent.label order by {sq.distance('v', 'c')}, vec_id) as r from cent, e)
select label, round(avg(case when owner = label then 0.0 else 1.0 end::double), 6) as overlap_score from k where r <= n group by label""")
def overlap_score(spark, d):
    return r6(geometry.overlap(_emb(spark, d), "label", "vec_id", "embedding"), "overlap_score")


@query(f"with {sq.CENT} select a.label, round(min({sq.distance('a.c', 'b.c')}), 6) as outlier_score from cent a join cent b on a.label <> b.label group by a.label")
def outlier_score(spark, d):
    return r6(geometry.outlier(_emb(spark, d), "label", "embedding"), "outlier_score")


# Feature tables


def _chunk_table(spark, d):
    return features.suffixed(stylometry.all_features(doc_chunks(spark, d), KEYS, ["characters", "words"]), ["doc_id", "chunk_id"], "_chunk")


def _book_table(spark, d):
    whole = chunks.chunk_rows(docs(spark, d), KEYS, None)
    return features.suffixed(stylometry.all_features(whole, KEYS, ["characters", "words"]).drop("chunk_id"), KEYS, "_fulltext")


_FT = f"""{sq.TOKENS}, {sq.grams(1)}, wc as (select doc_id, chunk_id, {sq.entropy()} as unigram_entropy_chunk from g1 group by all),
cc as (select doc_id, chunk_id, length({sq.transliterated("array_to_string(sentences, ' ')")})::bigint as text_length_chunk from chunks),
ct as (select * from cc left join wc using (doc_id, chunk_id)),
b1 as (select doc_id, unnest(flatten(list_transform(sentences, lambda s: {sq.words(sq.normalised('s'))}))) as w from d0 where len(sentences) > 0),
b2 as (select doc_id, w, count(*) as cnt from b1 group by all), b3 as (select doc_id, {sq.entropy()} as unigram_entropy_fulltext from b2 group by all),
b4 as (select doc_id, length({sq.transliterated("array_to_string(sentences, ' ')")})::bigint as text_length_fulltext from d0 where len(sentences) > 0),
bt as (select * from b4 left join b3 using (doc_id))"""


#: Queries that make the feature groups of a chunk, in the order of the registry, and their features.
_GROUPS_OF = {
    "char_ratios": ["ratio_of_punctuation_marks", "ratio_of_digits", "ratio_of_whitespaces", "ratio_of_exclamation_marks", "ratio_of_question_marks", "ratio_of_commas", "ratio_of_uppercase_letters", "text_length"],
    "sentence_lengths": ["average_number_of_words_in_sentence", "maximum_number_of_words_in_sentence", "average_paragraph_length"],
    "unigram_entropy": ["types", "tokens", "type_token_ratio", "average_word_length", "unigram_entropy"],
    "ratio_of_unique_bigrams": ["ratio_of_unique_bigrams"], "ratio_of_unique_trigrams": ["ratio_of_unique_trigrams"], "bigram_entropy": ["bigram_entropy"], "trigram_entropy": ["trigram_entropy"],
    "readability": ["flesch_reading_ease_score", "gunning_fog"],
}
_WHOLE_TEXT = f"{sq.DOCS}, chunks as (select doc_id, lang, genre, 0::int as chunk_id, sentences from d0 where len(sentences) > 0)"


def _all_features_sql(suffix: str, whole: bool) -> str:
    """The SQL of all groups side by side, over chunks or whole texts."""
    part = {n: ORACLE[n].replace(sq.CHUNKS, _WHOLE_TEXT) if whole else ORACLE[n] for n in _GROUPS_OF}
    columns = ", ".join(f"{n}.{c} as {c}{suffix}" for n, cs in _GROUPS_OF.items() for c in cs)
    base = f"(with {_WHOLE_TEXT if whole else sq.CHUNKS} select doc_id, chunk_id from chunks)"
    joins = " ".join(f"left join ({q}) {n} on {n}.doc_id = b.doc_id and {n}.chunk_id = b.chunk_id" for n, q in part.items())
    return f"select b.doc_id, {'' if whole else 'b.chunk_id, '}{columns} from {base} b {joins}"


def _rounded_features(df: DataFrame) -> DataFrame:
    return r6(df, *(f.name for f in df.schema if f.dataType.typeName() == "double"))


@query(_all_features_sql("_chunk", False))
def chunk_features(spark, d):
    return _rounded_features(features.suffixed(stylometry.all_features(doc_chunks(spark, d), KEYS), ["doc_id", "chunk_id"], "_chunk"))


@query(_all_features_sql("_fulltext", True))
def book_features(spark, d):
    whole = chunks.chunk_rows(docs(spark, d), KEYS, None)
    return _rounded_features(features.suffixed(stylometry.all_features(whole, KEYS).drop("chunk_id"), KEYS, "_fulltext"))


@query(f"""with {_FT}, m as (select doc_id, avg(text_length_chunk) as text_length_chunk, avg(unigram_entropy_chunk) as unigram_entropy_chunk from ct group by doc_id)
select doc_id, text_length_fulltext, round(unigram_entropy_fulltext, 6) as unigram_entropy_fulltext, round(text_length_chunk, 6) as text_length_chunk, round(unigram_entropy_chunk, 6) as unigram_entropy_chunk from bt join m using (doc_id)""")
def baac(spark, d):
    t = features.book_and_averaged_chunks(_book_table(spark, d), _chunk_table(spark, d), "doc_id")
    return r6(t.select("doc_id", "text_length_fulltext", "unigram_entropy_fulltext", "text_length_chunk", "unigram_entropy_chunk"), "unigram_entropy_fulltext", "text_length_chunk", "unigram_entropy_chunk")


@query(f"""with {_FT} select doc_id, chunk_id, text_length_chunk, round(unigram_entropy_chunk, 6) as unigram_entropy_chunk, text_length_fulltext, round(unigram_entropy_fulltext, 6) as unigram_entropy_fulltext from ct full join bt using (doc_id)""")
def cacb(spark, d):
    t = features.chunks_and_copied_book(_chunk_table(spark, d), _book_table(spark, d), "doc_id")
    return r6(t.select("doc_id", "chunk_id", "text_length_chunk", "unigram_entropy_chunk", "text_length_fulltext", "unigram_entropy_fulltext"), "unigram_entropy_chunk", "unigram_entropy_fulltext")


@query("select 'pub_year' as \"column\", bool_or(pub_year is null) as missing from documents union all select 'lang', bool_or(lang is null) from documents union all select 'doc_id', bool_or(doc_id is null) from documents")
def missing_values(spark, d):
    return features.any_missing(docs(spark, d).select("pub_year", "lang", "doc_id"))


# Sentiment of reviews


def _lexicon(spark, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(values.items()), "word string, score double")


def _values(values: dict[str, float]) -> str:
    return "(values " + ", ".join(f"({sq.quoted(w)}, {s}::double)" for w, s in sorted(values.items())) + ")"


def _reviews(spark, d):
    return docs(spark, d).where("genre = 'review'")


_RW = f"{sq.SENTENCES}, rs as (select doc_id, sent_idx, {sq.words(sq.normalised('sentence'))} as ws from sent semi join (select doc_id from documents where genre = 'review') using (doc_id)), rw as (select doc_id, sent_idx, unnest(ws) as word from rs)"


#: Mean of sentences, summed as whole numbers.
_WHOLE = "sum(round(coalesce(s, 0) * 1000000000000.0::double)::hugeint)::double / (count(*) * 1000000000000.0::double)"


@query(f"""with {_RW}, lex(word, score) as {_values(LEXICON)}, s as (select doc_id, sent_idx, sum(round(score * 1000000)::bigint)::double / (count(*) * 1000000)::double as s from rw join lex using (word) group by all)
select doc_id, round({_WHOLE}, 6) as sentiscore_average from rs left join s using (doc_id, sent_idx) group by doc_id""")
def lexicon_score(spark, d):
    words = sentiment.sentence_words(_reviews(spark, d), "doc_id")
    return r6(sentiment.lexicon_scores(words, _lexicon(spark, LEXICON), "doc_id"), "sentiscore_average")


@query(f"""with {_RW}, pol(word, p) as {_values(POLARITY)}, lex(word, score) as {_values(LEXICON)},
s as (select doc_id, sent_idx, sum(round(coalesce(p, 0) * case when score is null then 1.0 else 1.5 end::double * 1000000)::bigint)::double / (count(*) * 1000000)::double as s from rw left join pol using (word) left join lex using (word) group by all)
select doc_id, round({_WHOLE}, 6) as sentiment_polarity from rs left join s using (doc_id, sent_idx) group by doc_id""")
def boosted_polarity(spark, d):
    words = sentiment.sentence_words(_reviews(spark, d), "doc_id")
    return r6(sentiment.polarity_scores(words, _lexicon(spark, POLARITY), _lexicon(spark, LEXICON), "doc_id"), "sentiment_polarity")


_FREQ = f"{sq.TOKENS}, w as (select genre, unnest(flatten(toks)) as word from tk), a as (select word, count(*)::double / (select count(*) from w where genre = 'review') as freq from w where genre = 'review' group by word), b as (select word, count(*)::double / (select count(*) from w where genre = 'prose') as freq from w where genre = 'prose' group by word)"


@query(f"with {_FREQ} select word, round(a.freq - coalesce(b.freq, 0), 9) as diff from a left join b using (word) where a.freq - coalesce(b.freq, 0) > 0")
def review_typical_words(spark, d):
    def freq(genre):
        part = chunks.chunk_rows(docs(spark, d).where(F.col("genre") == genre), KEYS, SIZE)
        return ngrams.relative_frequency(chunks.with_tokens(part).select(F.explode(F.flatten("toks")).alias("word")))

    return sentiment.typical_words(freq("review"), freq("prose")).withColumn("diff", F.round("diff", 9))


@query("with w as (select lower(trim(freq, ' ')) as word from relfreq_reviews where trim(freq, ' ') <> '') select word, count(*) as cnt from w group by word order by cnt desc, word limit 10000")
def top_words(spark, d):
    w = table(spark, d, "relfreq_reviews").select(F.lower(F.btrim("freq", F.lit(" "))).alias("word")).where("word <> ''")
    return ngrams.top(w.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")), 10000, "word")


# The plain tagger's function words, as stop words.
STOPWORDS = [*corpus.DETERMINERS, *corpus.PRONOUNS, *corpus.ADPOSITIONS, *corpus.CONJUNCTIONS]


@query(rf"""with w as (select unnest(regexp_extract_all(lower(replace(text, chr(10), ' ')), '(\p{{L}}+)')) as word from documents where genre = 'review' and text is not null)
select word, count(*) as cnt from w where word not in ({sq.listed(STOPWORDS)}) group by word""")
def content_words(spark, d):
    return sentiment.without_stopwords(sentiment.alpha_words(_reviews(spark, d), "doc_id"), stopwords=STOPWORDS).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


_SCORES = "sc as (select event_id, value - 50 as score from events where value is not null)"


@query(f"""with {_SCORES}, q as (select quantile_cont(score::double, 0.25) filter (where score > 0) as qp, quantile_cont(-score::double, 0.25) filter (where score < 0) as qn from sc)
select event_id, round(score, 6) as score, case when score > 0.5 * qp then 'positive' when score < -0.25 * qn then 'negative' else 'not_classified' end as classified from sc, q""")
def quartile_classing(spark, d):
    s = table(spark, d, "events").where("value is not null").select("event_id", (F.col("value") - 50).alias("score"))
    return r6(sentiment.quartile_classes(s, "event_id", "score", 0.5, 0.25), "score")


@query(f"with {_SCORES}, p as (select event_id from sc where score > 20), n as (select event_id from sc where score > 35) select event_id from p anti join n using (event_id)")
def exclusive_rows(spark, d):
    s = table(spark, d, "events").where("value is not null").select("event_id", (F.col("value") - 50).alias("score"))
    return sentiment.exclusive(s.where("score > 20"), s.where("score > 35"), "event_id").select("event_id")


_LAB = "lb as (select event_id, case when event_type = 'click' then 1 else 0 end as class, round(value) - 50 as score from events where value is not null)"


def _gold(spark, d):
    return table(spark, d, "events").where("value is not null").select("event_id", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("class"), (F.round("value") - 50).alias("score"))


@query(f"with {_LAB} select sum((class = 1 and score > 0)::int)::bigint as tp, sum((class = 1 and not score > 0)::int)::bigint as fn, sum((class <> 1 and score < 0)::int)::bigint as tn, sum((class <> 1 and not score < 0)::int)::bigint as fp from lb")
def confusion_counts(spark, d):
    return sentiment.confusion(_gold(spark, d), "class", "score")


@query(f"with {_LAB}, c as (select sum((class = 1 and score > 0)::int) as tp, sum((class = 1 and not score > 0)::int) as fn, sum((class <> 1 and score < 0)::int) as tn, sum((class <> 1 and not score < 0)::int) as fp from lb) select round(tp::double / nullif(tp + fn, 0), 6) as recall, round(tp::double / nullif(tp + fp, 0), 6) as precision, round((tp + tn)::double / nullif(tp + fn + tn + fp, 0), 6) as accuracy from c")
def precision_recall(spark, d):
    return r6(sentiment.rates(sentiment.confusion(_gold(spark, d), "class", "score")), "recall", "precision", "accuracy")


def _english(spark, d):
    """English documents (doc_id, genre, words), however the language is written."""
    t = docs(spark, d).where("text is not null").select("doc_id", "genre", "lang", tx.tokens(tx.normalised(F.col("text"))).alias("words"))
    return t.where(tx.is_english(F.col("lang"), F.col("words"))).select("doc_id", "genre", "words")


def _english_vectors(spark, d):
    rows = materialize(_english(spark, d), "english")  # training reads it more than once
    return rows, materialize(_plain_vectors(sentiment.word_vectors(rows, size=300, min_count=5).getVectors()), "word-vectors")


@query()
def word2vec_neighbours(spark, d):
    return sentiment.similar_words(_english_vectors(spark, d)[1], ["garden", "tower", "letter"], 5)


def _plain_vectors(v: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return v.select("word", vector_to_array("vector").alias("vector"))


def _evaluative(rows: DataFrame) -> DataFrame:
    """(word): the 10,000 commonest adjectives and nouns of reviews that are typical of them, without stop words."""
    words = rows.select("genre", F.explode("words").alias("word"))
    freq = lambda genre: ngrams.relative_frequency(words.where(F.col("genre") == genre).select("word"))
    typical = sentiment.typical_words(freq("review"), freq("prose"))
    tagged = words.where("genre = 'review'").where(corpus.tag_of(F.col("word")).isin("ADJ", "NOUN"))
    counts = sentiment.without_stopwords(tagged).join(typical.select("word"), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return ngrams.top(counts, 10000, "word").select("word")


@query()
def affinity_clusters(spark, d):
    rows, vectors = _english_vectors(spark, d)
    seeds = sentiment.seeds_and_neighbours(vectors, [*sentiment.POSITIVE, *sentiment.NEGATIVE, *POLARITY], 2)
    chosen = seeds.join(_evaluative(rows), "word", "left_semi").orderBy("word").toPandas()  # at most three times the seeds given
    return sentiment.cluster_words(spark.createDataFrame(sentiment.affinity_clusters(chosen), "word string, cluster bigint, exemplar string"))


# Labels and data sets

_CLS = "rv as (select text_id, journal, case when text_id % 5 = 0 then 'positive' when text_id % 3 = 0 then 'negative' else 'not_classified' end as classified, (text_id % 17) / 17.0::double as polarity, (text_id % 11) / 11.0::double as lexicon, 'book_' || (text_id % 97) as file_name from (select distinct text_id, journal from reviews))"


def _classed(spark, d):
    t = table(spark, d, "reviews").select("text_id", "journal").distinct()
    i = F.col("text_id")
    cls = F.when(i % 5 == 0, "positive").when(i % 3 == 0, "negative").otherwise("not_classified")
    return t.select("text_id", "journal", cls.alias("classified"), ((i % 17) / F.lit(17.0)).alias("polarity"), ((i % 11) / F.lit(11.0)).alias("lexicon"), F.concat(F.lit("book_"), i % 97).alias("file_name"))


@query(f"""with {_CLS}, u as (select * from rv qualify max((classified = 'positive')::int) over (partition by journal) + max((classified = 'negative')::int) over (partition by journal) < 2 or journal is null),
c as (select file_name, classified, count(*) as n from rv group by all) select file_name, arg_max(classified, (n, classified)) as classified from c group by file_name""")
def labels_majority(spark, d):
    return labels.majority(_classed(spark, d), "file_name", "classified")


@query(f"with {_CLS} select text_id, file_name, classified from rv qualify max((classified = 'positive')::int) over (partition by file_name) + max((classified = 'negative')::int) over (partition by file_name) < 2")
def labels_undisputed(spark, d):
    return labels.undisputed(_classed(spark, d), "file_name", "classified").select("text_id", "file_name", "classified")


@query(f"with {_CLS} select file_name, round(avg(case classified when 'positive' then polarity when 'negative' then lexicon else (polarity + lexicon) / 2 end), 6) as y from rv group by file_name")
def labels_combined(spark, d):
    return r6(labels.label_table("combined", reviews=_classed(spark, d)), "y")


@query(f"with {_CLS} select text_id, file_name, round(avg(polarity) over (partition by file_name), 6) as y from rv")
def labels_mean(spark, d):
    return r6(labels.group_mean(_classed(spark, d), "file_name", "polarity", "y").select("text_id", "file_name", "y"), "y")


@query("select distinct file_name, case when sum_libraries is null or sum_libraries <> 0 then 1 else 0 end as y from ger_texts_circulating_libs")
def labels_library(spark, d):
    return labels.label_table("library", libraries=table(spark, d, "ger_texts_circulating_libs")).distinct()


_META = "mt as (select distinct id, file_name, pub_year from ger_texts_meta), lb as (select file_name, max(sum_libraries) as y from ger_texts_circulating_libs where sum_libraries is not null group by file_name)"


def _meta(spark, d):
    return table(spark, d, "ger_texts_meta").select("id", "file_name", "pub_year").distinct()


def _library_counts(spark, d):
    return table(spark, d, "ger_texts_circulating_libs").where("sum_libraries is not null").groupBy("file_name").agg(F.max("sum_libraries").alias("y"))


@query(f"with {_META} select id, mt.file_name, y from mt join lb using (file_name)")
def dataset_inner(spark, d):
    return labels.labelled(_meta(spark, d), _library_counts(spark, d), "file_name").select("id", "file_name", "y")


@query(f"with {_META} select id, mt.file_name, coalesce(y, 0) as y from mt left join lb using (file_name)")
def dataset_left_fill(spark, d):
    return labels.labelled_or_zero(_meta(spark, d), _library_counts(spark, d), "file_name").select("id", "file_name", "y")


@query(f"with {_META} select id, mt.file_name, coalesce(y, 0) as y from mt left join lb using (file_name) where pub_year >= 1785 and pub_year <= 1901")
def dataset_year_filter(spark, d):
    kept = labels.within_years(_meta(spark, d), "pub_year", 1785, 1901)
    return labels.labelled_or_zero(kept, _library_counts(spark, d), "file_name").select("id", "file_name", "y")


@query(f"with {_META} select id, file_name from mt anti join lb using (file_name)")
def unlabelled_rows(spark, d):
    return labels.unlabelled(_meta(spark, d), _library_counts(spark, d), "file_name").select("id", "file_name")


@query("""with a as (select distinct text_id, journal, pub_year from reviews where text_id % 2 = 0), b as (select distinct text_id, journal, pub_year from reviews where text_id % 3 = 0)
select coalesce(a.text_id, b.text_id) as text_id, case when a.text_id is null then b.journal else a.journal end as journal, a.pub_year as pub_year, b.pub_year as pub_year_right from a full join b on a.text_id = b.text_id and a.journal is not distinct from b.journal""")
def null_safe_outer_join(spark, d):
    r = table(spark, d, "reviews").select("text_id", "journal", "pub_year").distinct()
    return labels.null_safe_outer(r.where("text_id % 2 = 0"), r.where("text_id % 3 = 0"), ["text_id", "journal"])


@query("select distinct on (author_viaf) author_viaf, id, file_name from (select distinct id, file_name, author_viaf from ger_texts_meta where author_viaf is not null) order by author_viaf, id, file_name")
def first_per_author(spark, d):
    m = table(spark, d, "ger_texts_meta").where("author_viaf is not null").select("author_viaf", "id", "file_name").distinct()
    return labels.first_rows(m, ["author_viaf"], [F.col("id"), F.col("file_name")])


@query(r"select distinct text_id, textfile, regexp_extract(textfile, '^(\d{5})_(\d{4})_([^_]+)_', 1)::int as parsed_id, regexp_extract(textfile, '^(\d{5})_(\d{4})_([^_]+)_', 2)::int as parsed_year, regexp_extract(textfile, '^(\d{5})_(\d{4})_([^_]+)_', 3) as parsed_journal from reviews where regexp_matches(textfile, '^(\d{5})_(\d{4})_([^_]+)_')")
def review_name_parts(spark, d):
    i, y, j = tx.review_key(F.col("textfile"))
    r = table(spark, d, "reviews").select("text_id", "textfile", i.alias("parsed_id"), y.alias("parsed_year"), j.alias("parsed_journal")).distinct()
    return r.where("parsed_id is not null")


# Descriptive series


@query("""with a as (select pub_year as year, count(*) as books from ger_texts_meta where pub_year is not null group by all), b as (select pub_year as year, count(*) as listed from ger_texts_circulating_libs where pub_year is not null group by all),
y as (select unnest(range(1688, 1914))::int as year) select year, coalesce(books, 0) as books, coalesce(listed, 0) as listed from y full join a using (year) full join b using (year)""")
def year_histogram_spine(spark, d):
    def by_year(name):
        return describe.value_counts(table(spark, d, name), "pub_year").withColumnRenamed("pub_year", "year")

    return describe.year_series(spark, 1688, 1913, {"books": by_year("ger_texts_meta"), "listed": by_year("ger_texts_circulating_libs")})


@query("select journal, count(*) as n from reviews where journal is not null group by journal")
def journal_counts(spark, d):
    return describe.value_counts(table(spark, d, "reviews"), "journal")


@query("with a as (select distinct author_viaf from ger_texts_meta where author_viaf is not null), b as (select distinct author_viaf, 1 as h from ger_texts_circulating_libs where author_viaf is not null) select count(h) as matched, count(*) as total, round(100.0::double * count(h) / nullif(count(*), 0), 6) as percentage from a left join b using (author_viaf)")
def distinct_ratio(spark, d):
    return r6(describe.distinct_ratio(table(spark, d, "ger_texts_meta"), table(spark, d, "ger_texts_circulating_libs"), "author_viaf"), "percentage")


@query("select round(sum(pub_year)::double / count(*), 6) as mean from reviews where journal is not null")
def era_mean(spark, d):
    return r6(describe.mean_with_gaps(table(spark, d, "reviews").where("journal is not null"), "pub_year"), "mean")


@query("select round(100 * avg(case when binary_flag = 1 then 1.0 else 0.0 end::double), 6) as percentage from ger_texts_circulating_libs")
def library_share(spark, d):
    return r6(describe.share(table(spark, d, "ger_texts_circulating_libs").withColumn("f", F.col("binary_flag") == 1), "f"), "percentage")


@query("""with x as (select value::double as x from events where value is not null and not isnan(value)), e as (select min(x) as lo, max(x) as hi from x)
select least(30, floor((x - lo) / ((hi - lo) / 30.0::double)) + 1)::int as bin, count(*) as n from x, e group by bin""")
def histogram30(spark, d):
    return describe.histogram(table(spark, d, "events"), "value", 30)


# Scores

_PRED = "pr as (select o_orderkey as row_id, (o_orderkey % 5)::int as fold, (o_orderkey % 3)::int as y_true, case when o_orderkey % 7 < 4 then (o_orderkey % 3)::int else (o_orderkey % 4)::int end as y_pred from orders)"
_REG = "rg as (select (o_orderkey % 5)::int as fold, o_totalprice as y_true, o_totalprice * (1 + (o_orderkey % 13 - 6) / 10.0::double) as y_pred from orders)"


def _predicted(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("row_id"), (k % 5).cast("int").alias("fold"), (k % 3).cast("int").alias("y_true"), F.when(k % 7 < 4, k % 3).otherwise(k % 4).cast("int").alias("y_pred"))


@query(f"with {_PRED} select coalesce(y_true::varchar, 'All') as y_true, coalesce(y_pred::varchar, 'All') as y_pred, count(*) as n from pr group by cube (y_true, y_pred)")
def crosstab_margins(spark, d):
    return metrics.confusion_table(_predicted(spark, d))


_REPORT = f"""{_PRED}, t as (select y_true::varchar as class, count(*) as support, sum((y_true = y_pred)::int) as tp from pr group by all), p as (select y_pred::varchar as class, count(*) as said from pr group by all),
rp as (select class, coalesce(tp::double / nullif(said, 0), 0) as precision, coalesce(tp::double / nullif(support, 0), 0) as recall, coalesce(2 * tp::double / (coalesce(said, 0) + coalesce(support, 0)), 0) as f1, coalesce(support, 0) as support from t full join p using (class))"""


@query(f"with {_REPORT} select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from rp")
def class_report(spark, d):
    return r6(metrics.class_report(_predicted(spark, d)), "precision", "recall", "f1")


@query(f"with {_REPORT} select round((select avg((y_true = y_pred)::int) from pr), 6) as accuracy, round(avg(recall) filter (where support > 0), 6) as balanced_accuracy, round(avg(f1), 6) as f1_macro, round(sum(f1 * support) / sum(support), 6) as f1_weighted from rp")
def f1_scores(spark, d):
    return r6(metrics.class_scores(_predicted(spark, d)), "accuracy", "balanced_accuracy", "f1_macro", "f1_weighted")


@query(f"with {_REG} select fold, count(*) as n, round(corr(y_true, y_pred), 6) as corr, round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 6) as r2, round(sqrt(sum((y_true - y_pred) ** 2) / count(*)), 4) as rmse, round(avg(abs(y_true - y_pred)), 4) as mae from rg group by fold")
def regression_metrics(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select((k % 5).cast("int").alias("fold"), F.col("o_totalprice").alias("y_true"), (F.col("o_totalprice") * (1 + (k % 13 - 6) / F.lit(10.0))).alias("y_pred"))
    s = metrics.regression_scores(r, ["fold"]).drop("corr_pvalue")
    return r6(s, "corr", "r2").withColumns({c: F.round(c, 4) for c in ("rmse", "mae")})


_CV = "cv as (select (l_partkey % 40)::int as combo_id, (l_suppkey % 5)::int as fold, avg(l_discount) as metric, avg(l_tax) / 4 as pvalue from lineitem group by 1, 2)"


def _cv(spark, d):
    t = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).cast("int").alias("combo_id"), (F.col("l_suppkey") % 5).cast("int").alias("fold"))
    return t.agg(F.avg("l_discount").alias("metric"), (F.avg("l_tax") / 4).alias("pvalue"))


@query(f"with {_CV} select combo_id, round(case when bool_or(pvalue is null or pvalue = 0) then null else count(*) / sum(1 / pvalue) end, 6) as harmonic_pvalue from cv group by combo_id")
def harmonic_p(spark, d):
    return r6(metrics.harmonic_p_values(_cv(spark, d), ["combo_id"]), "harmonic_pvalue")


@query(f"with {_CV}, s as (select fold, combo_id, round(metric, 9) as metric, round(pvalue, 9) as p from cv) select fold, combo_id from s qualify row_number() over (partition by fold order by case when p < 0.0099 then 1 else 0 end desc, metric desc, combo_id) = 1")
def refit_choice(spark, d):
    s = _cv(spark, d).select("fold", "combo_id", F.round("metric", 9).alias("metric"), F.round("pvalue", 9).alias("p"))
    return metrics.refit_choice(s, ["fold"], "metric", "p", 0.0099).select("fold", "combo_id")


@query(f"""with {_CV}, s as (select fold, combo_id, round(metric, 9) as metric, round(pvalue, 9) as p from cv), v as (select *, max((p < 0.0099)::int) over (partition by fold) as sig from s),
w as (select fold, combo_id, case when sig = 1 then case when p < 0.0099 then metric end else -p end as v from v) select fold, combo_id from w qualify v = max(v) over (partition by fold)""")
def best_model(spark, d):
    s = _cv(spark, d).select("fold", "combo_id", F.round("metric", 9).alias("metric"), F.round("pvalue", 9).alias("p"))
    return metrics.evaluation_choice(s, ["fold"], "metric", "p", 0.0099).select("fold", "combo_id")


@query(f"with {_CV}, b as (select combo_id % 4 as level, fold, max(metric) as m from cv group by all) select level, round(avg(m), 6) as mean_inner_score from b group by level order by mean_inner_score desc, level limit 1")
def best_feature_level(spark, d):
    b = _cv(spark, d).withColumn("level", F.col("combo_id") % 4)
    return r6(metrics.best_feature_level(b, "level", "fold", "metric"), "mean_inner_score")


_DRAW = "('0x' || substr(md5(row_id || '|8|{}'), 1, 8))::bigint / 4294967296.0::double"


@query(f"""with {_REG}, c as (select fold, count(*) as n, corr(y_true, y_pred) as r from rg group by fold),
k as (select fold, unnest(range(0, (n - 2) // 2)) as k, r from c), s as (select fold, sum(pow(1 - r * r, k) * exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0))) as s from k group by fold)
select fold, round(r, 6) as corr, round(1 - abs(r) * s, 4) as corr_pvalue from c join s using (fold) where n % 2 = 0""".replace(
    "o_totalprice * (1 + (o_orderkey % 13 - 6) / 10.0::double) as y_pred", "(o_orderkey * 7919 % 101)::double as y_pred").replace("o_orderkey % 5)::int as fold", "o_orderkey % 50)::int as fold"))
def correlation_pvalues(spark, d):
    """Of folds with an even number of rows, for which the check has a closed form."""
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select((k % 50).cast("int").alias("fold"), F.col("o_totalprice").alias("y_true"), (k * 7919 % 101).cast("double").alias("y_pred"))
    return metrics.regression_scores(r, ["fold"]).where("n % 2 = 0").select("fold", F.round("corr", 6).alias("corr"), F.round("corr_pvalue", 4).alias("corr_pvalue"))


_BASE = f"""{_PRED}, cs as (select list(c order by n desc, c) as cs, list(n order by n desc, c) as ns from (select y_true as c, count(*) as n from pr group by all)),
ub as (select cs, ns, list_transform(range(1, len(cs) + 1), lambda i: list_sum(list_transform(cs[1:i], lambda x: 1.0::double / len(cs)))) as u, list_transform(range(1, len(cs) + 1), lambda i: list_sum(list_transform(ns[1:i], lambda x: x::double / list_sum(ns)))) as f from cs),
dr as (select *, {_DRAW.format(1)} as d1, {_DRAW.format(2)} as d2, {_DRAW.format(3)} as d3, {_DRAW.format(4)} as d4 from pr, ub),
bl as (select row_id, fold, y_true, y_pred, 0 as all_zero, cs[least(len(list_filter(u, lambda b: b <= d1)) + 1, len(cs))] as uniform, cs[least(len(list_filter(f, lambda b: b <= d2)) + 1, len(cs))] as by_frequency,
cs[least(1 + (d3 >= 0.5)::int + (d3 >= 1.0)::int, len(cs))] as two_largest, cs[least(1 + (d4 >= 0.5)::int + (d4 >= 0.75)::int + (d4 >= 1.0)::int, len(cs))] as three_largest from dr)"""


@query(f"with {_BASE} select * from bl")
def random_baselines(spark, d):
    return metrics.baselines(_predicted(spark, d))


@query(f"with {_PRED}, s as (select y_true, count(*) as n from pr group by all), k as (select sum(n) as a, count(*) as k from s) select row_id, y_true, round(a::double / (k * n), 6) as weight from pr join s using (y_true), k")
def class_weights(spark, d):
    return r6(folds.balanced_weights(_predicted(spark, d).select("row_id", "y_true"), "y_true").select("row_id", "y_true", "weight"), "weight")


# Folds and models


@query("select distinct id, split_part(file_name, '_', 1) || '_' || split_part(file_name, '_', 2) as author from ger_texts_meta")
def author_groups(spark, d):
    return _meta(spark, d).select("id", folds.author_group(F.col("file_name")).alias("author")).distinct()


_GROUPS = "mt as (select distinct id, file_name, pub_year from ger_texts_meta where file_name is not null), lb as (select file_name, max(sum_libraries) as y from ger_texts_circulating_libs where sum_libraries is not null group by file_name), am as (select split_part(file_name, '_', 1) || '_' || split_part(file_name, '_', 2) as author, case when coalesce(y, 0) > 0 then 1 else 0 end as y from mt left join lb using (file_name))"


def _authored(spark, d):
    m = labels.labelled_or_zero(_meta(spark, d).where("file_name is not null"), _library_counts(spark, d), "file_name").withColumn("y", F.when(F.col("y") > 0, 1).otherwise(0))
    return m.withColumn("author", folds.author_group(F.col("file_name")))


@query(f"""with recursive {_GROUPS}, g as (select author, count(*) as n from am group by author), o as (select author, n, row_number() over (order by n desc, 'all=' || n, md5(author || '|')) as i from g),
r(i, author, f, load) as (select 0::bigint, ''::varchar, 0::bigint, [0, 0, 0, 0, 0]::bigint[] union all
 select o.i, o.author, list_position(load, list_min(load)) - 1, list_transform(range(1, 6), lambda k: load[k] + case when k = list_position(load, list_min(load)) then o.n else 0 end) from r join o on o.i = r.i + 1)
select author, f::int as fold from r where i > 0""")
def group_kfold(spark, d):
    return folds.group_folds(_authored(spark, d), "author", 5)


@query(f"""with recursive {_GROUPS}, g as (select author, count(*) filter (where y = 0) as a, count(*) filter (where y = 1) as b from am group by author), t as (select sum(a)::double as ta, sum(b)::double as tb from g),
o as (select author, a, b, row_number() over (order by round(abs(a - b) / 2.0::double, 9) desc, case when a = 0 then '1=' || b when b = 0 then '0=' || a else '0=' || a || chr(10) || '1=' || b end, md5(author || '|')) as i from g),
r(i, author, f, la, lb) as (select 0::bigint, ''::varchar, 0::bigint, [0, 0, 0, 0, 0]::bigint[], [0, 0, 0, 0, 0]::bigint[] union all
 select i, author, f, list_transform(range(1, 6), lambda k: la[k] + case when k = f + 1 then a else 0 end), list_transform(range(1, 6), lambda k: lb[k] + case when k = f + 1 then b else 0 end) from (
  select o.i, o.author, o.a, o.b, la, lb, list_sort(list_transform(range(1, 6), lambda k: {{'s': round((list_stddev_pop(list_transform(range(1, 6), lambda j: (la[j] + case when j = k then o.a else 0 end)::double / ta)) + list_stddev_pop(list_transform(range(1, 6), lambda j: (lb[j] + case when j = k then o.b else 0 end)::double / tb))) / 2, 9), 'l': la[k] + lb[k], 'k': k}}))[1].k - 1 as f
  from r join o on o.i = r.i + 1 cross join t))
select author, f::int as fold from r where i > 0""")
def stratified_group_kfold(spark, d):
    return folds.group_folds(_authored(spark, d), "author", 5, "y")


@query("""with l as (select distinct l_orderkey * 10 + l_linenumber as row_id, l_returnflag from lineitem), s as (select l_returnflag, count(*) as n from l group by all), r as (select *, row_number() over (partition by l_returnflag order by md5(row_id || '|8')) as r, max(n) over () as m from l join s using (l_returnflag))
select l_returnflag, row_id, (m // n + case when r <= m % n then 1 else 0 end)::bigint as copies from r""")
def upsampled_rows(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")).distinct()
    return folds.upsampled(li, "l_returnflag", "row_id").groupBy("l_returnflag", "row_id").agg(F.count(F.lit(1)).alias("copies"))


@query()
def nested_cv(spark, d):
    whole = chunks.chunk_rows(docs(spark, d), KEYS, None)
    f = features.suffixed(stylometry.all_features(whole, KEYS).drop("chunk_id"), KEYS, "_fulltext").join(docs(spark, d).select("doc_id", "source", F.when(F.col("genre") == "review", 1).otherwise(0).alias("y")), "doc_id").where("source is not null").na.drop()
    columns = [c for c in f.columns if c.endswith("_fulltext")]
    pred, _ = models.nested(f, "doc_id", "source", columns, "binary")
    return pred


@query(f"with {sq.EMB} select a.vec_id, round(list_sum(list_transform(list_zip(v, c), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(c, lambda x: x * x)))), 6) as cosine from (select e.vec_id, e.v, m.c from e, (select v as c from e where vec_id = 0) m) a")
def cosine_to_first(spark, d):
    e = _emb(spark, d)
    first = e.where("vec_id = 0").select(F.col("embedding").alias("c"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"))  # first is one row
