"""Queries of the life of a review, from its words to classes, labels and data sets, of what evaluates models, and of the small
steps between; with SQL that gives the same results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import chunks, corpus, features, folds, labels, metrics, ngrams, sentiment, stylometry
from scriptorium.plans import catalog
from scriptorium.plans import sqlparts as sq
from scriptorium.plans.catalog import KEYS, LEXICON, POLARITY, doc_chunks, query, r6
from scriptorium.plans.embeddings import _renamed
from scriptorium.session import materialize, table

# The life of a review

_ONCE = "select text_id as doc_id, max(textfile) as textfile, max(journal) as source, max(lang) as lang, 'review' as genre, max(pub_year) as pub_year, max(reviews_txt) as text from reviews group by text_id"


def _reviews(spark, d):
    r = table(spark, d, "reviews").groupBy("text_id").agg(*(F.max(c).alias(c) for c in ("textfile", "journal", "pub_year", "lang", "reviews_txt")))  # redelivered rows are equal
    return r.withColumnRenamed("reviews_txt", "text")


_SCORED = f"""documents as ({_ONCE}), {sq.SENTENCES}, rs as (select doc_id, sent_idx, {sq.words(sq.normalised('sentence'))} as ws from sent), rw as (select doc_id, sent_idx, unnest(ws) as word from rs),
lex(word, score) as {catalog._values(LEXICON)}, pol(word, p) as {catalog._values(POLARITY)},
a as (select doc_id, sent_idx, sum(round(score * 1000000)::bigint)::double / (count(*) * 1000000)::double as s from rw join lex using (word) group by all),
b as (select doc_id, sent_idx, sum(round(coalesce(p, 0) * case when score is null then 1.0 else 1.5 end::double * 1000000)::bigint)::double / (count(*) * 1000000)::double as s from rw left join pol using (word) left join lex using (word) group by all),
a1 as (select doc_id, {catalog._WHOLE} as sentiscore from rs left join a using (doc_id, sent_idx) group by doc_id), b1 as (select doc_id, {catalog._WHOLE} as polarity from rs left join b using (doc_id, sent_idx) group by doc_id),
sc as (select doc_id as text_id, textfile, source as journal, round(sentiscore, 9) as sentiscore_average, round(polarity, 9) as sentiment_polarity from documents join a1 using (doc_id) join b1 using (doc_id)),
qt as (select quantile_cont(sentiment_polarity, 0.25) filter (where sentiment_polarity > 0) as qp, quantile_cont(sentiscore_average, 0.25) filter (where sentiscore_average < 0) as qn from sc),
fl as (select sc.*, coalesce(sentiment_polarity > 0 and sentiment_polarity > 0.5::double * qp, false) as p, coalesce(sentiscore_average < 0 and sentiscore_average < 0.5::double * qn, false) as n from sc, qt),
cl as (select text_id, textfile, journal, sentiscore_average, sentiment_polarity, case when p and not n then 'positive' when n and not p then 'negative' else 'not_classified' end as classified,
 case when p and not n then sentiment_polarity when n and not p then sentiscore_average else 0.0 end as sentiment, substr(textfile, length(regexp_extract(textfile, '^[^_]*_[^_]*_[^_]*_')) + 1) as title from fl)"""


def _scores(spark, d):
    r = _reviews(spark, d)
    words = materialize(sentiment.sentence_words(r, "text_id"), "words")
    lexicon, polarity = catalog._lexicon(spark, LEXICON), catalog._lexicon(spark, POLARITY)
    a, b = sentiment.lexicon_scores(words, lexicon, "text_id"), sentiment.polarity_scores(words, polarity, lexicon, "text_id")
    s = r.select("text_id", "textfile", "journal").join(a, "text_id").join(b, "text_id")
    return s.withColumns({c: F.round(c, 9) for c in ("sentiscore_average", "sentiment_polarity")})


def _classes(spark, d):
    s = materialize(_scores(spark, d), "scores")
    c = sentiment.classified(s, "text_id", "sentiment_polarity", "sentiscore_average")
    return c.join(s.select("text_id", "textfile", "journal", F.regexp_replace("textfile", "^[^_]*_[^_]*_[^_]*_", "").alias("title")), "text_id")


@query(f"with {_SCORED} select * from sc")
def review_scores(spark, d):
    return _scores(spark, d)


@query(f"with {_SCORED} select text_id, textfile, journal, sentiscore_average, sentiment_polarity, classified, sentiment from cl")
def review_classes(spark, d):
    return _classes(spark, d).select("text_id", "textfile", "journal", "sentiscore_average", "sentiment_polarity", "classified", "sentiment")


def _of_titles(spark, d):
    return _classes(spark, d).select(F.col("title").alias("file_name"), "classified", F.col("sentiment_polarity").alias("polarity"), F.col("sentiscore_average").alias("lexicon"))


_TITLES = f"{_SCORED}, tt as (select title as file_name, classified, sentiment_polarity as polarity, sentiscore_average as lexicon from cl)"
_UNDISPUTED = "ud as (select * from tt qualify max((classified = 'positive')::int) over (partition by file_name) + max((classified = 'negative')::int) over (partition by file_name) < 2)"
_KINDS = {
    "polarity": f"with {_TITLES} select file_name, round(avg(polarity), 6) as y from tt group by file_name",
    "lexicon": f"with {_TITLES} select file_name, round(avg(lexicon), 6) as y from tt group by file_name",
    "combined": f"with {_TITLES} select file_name, round(avg(case classified when 'positive' then polarity when 'negative' then lexicon else (polarity + lexicon) / 2 end), 6) as y from tt group by file_name",
    "multiclass": f"with {_TITLES}, {_UNDISPUTED}, c as (select file_name, classified, count(*) as n from ud group by all) select file_name, case arg_max(classified, (n, classified)) when 'negative' then 1 when 'not_classified' then 2 else 3 end as y from c group by file_name",
    "binary": f"with {_TITLES} select distinct file_name, 1 as y from tt",
}


def _label_query(kind: str) -> None:
    @query(_KINDS[kind])
    def f(spark, d):
        y = labels.label_table(kind, reviews=_of_titles(spark, d))
        return r6(y, "y") if kind in ("polarity", "lexicon", "combined") else y

    _renamed(f, f"label_{kind}")


for _kind in _KINDS:
    _label_query(_kind)


@query("select file_name, max(sum_libraries)::double as y from ger_texts_circulating_libs where sum_libraries is not null group by file_name")
def label_canon(spark, d):
    m3 = table(spark, d, "ger_texts_circulating_libs").where("sum_libraries is not null").groupBy("file_name").agg(F.max("sum_libraries").cast("double").alias("m3"))
    return labels.label_table("canon", canon=m3)


_BOOKS = "bk as (select file_name, count(*) as n_chunks, avg(ttr) as ttr from (select distinct on (chunk_key) chunk_key, file_name, type_token_ratio_chunk as ttr from chunk_features order by chunk_key) group by file_name)"


def _books(spark, d):
    c = table(spark, d, "chunk_features").dropDuplicates(["chunk_key"])
    return c.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg("type_token_ratio_chunk"), 6).alias("ttr"))


@query(f"""with {_BOOKS}, lb as (select file_name, max(case when sum_libraries is null or sum_libraries <> 0 then 1 else 0 end) as y from ger_texts_circulating_libs group by file_name), yr as (select file_name, max(pub_year) as pub_year from ger_texts_meta group by file_name)
select file_name, n_chunks, round(ttr, 6) as ttr, coalesce(y, 0) as y from bk left join lb using (file_name) left join yr using (file_name) where pub_year <= 1901""")
def dataset_library(spark, d):
    """The library task: German books up to the last catalogue."""
    y = labels.label_table("library", libraries=table(spark, d, "ger_texts_circulating_libs")).groupBy("file_name").agg(F.max("y").alias("y"))
    years = table(spark, d, "ger_texts_meta").groupBy("file_name").agg(F.max("pub_year").alias("pub_year"))
    return labels.dataset(_books(spark, d), y, "library", "ger", years)


_TITLED = _BOOKS.replace("bk as", "b0 as") + ", bk as (select file_name, n_chunks, ttr, split_part(file_name, '_', 3) as title from b0)"


def _titled(spark, d):
    return _books(spark, d).withColumn("title", F.coalesce(F.get(F.split("file_name", "_"), F.lit(2)), F.lit("")))


@query(f"with {_TITLES}, {_TITLED}, y as (select file_name as title, avg(case classified when 'positive' then polarity when 'negative' then lexicon else (polarity + lexicon) / 2 end) as y from tt group by file_name) select file_name, title, n_chunks, round(ttr, 6) as ttr, round(y, 6) as y from bk join y using (title)")
def dataset_regression(spark, d):
    """Books with the score of the reviews of their title."""
    y = labels.label_table("combined", reviews=_of_titles(spark, d)).withColumnRenamed("file_name", "title")
    return r6(labels.dataset(_titled(spark, d), y, "regression", "ger", key="title"), "y").select("file_name", "title", "n_chunks", "ttr", "y")


@query(f"with {_TITLES}, {_TITLED}, y as (select distinct file_name as title, 1 as y from tt), yr as (select split_part(file_name, '_', 3) as title, max(pub_year) as pub_year from ger_texts_meta where file_name is not null group by 1) select file_name, title, n_chunks, round(ttr, 6) as ttr, coalesce(y, 0) as y from bk left join y using (title) left join yr using (title) where pub_year between 1785 and 1915")
def dataset_reviewed(spark, d):
    """Books of the years that journals were searched for, 1 where a review has their title."""
    y = labels.label_table("binary", reviews=_of_titles(spark, d)).withColumnRenamed("file_name", "title")
    m = table(spark, d, "ger_texts_meta").where("file_name is not null").groupBy(F.coalesce(F.get(F.split("file_name", "_"), F.lit(2)), F.lit("")).alias("title")).agg(F.max("pub_year").alias("pub_year"))
    return labels.dataset(_titled(spark, d), y, "binary", "ger", m, key="title").select("file_name", "title", "n_chunks", "ttr", "y")


_ALIASED = " ".join(f"when {sq.quoted(a)} then {sq.quoted(b)}" for a, b in labels.AUTHOR_ALIASES.items())
_RENAMED = " ".join(f"when {sq.quoted(a)} then {sq.quoted(b)}" for a, b in labels.BOOK_ALIASES.items())
_NAMES = [*labels.BOOK_ALIASES, *labels.BOOK_ALIASES.values(), *(f"{a}_Title_1800" for a in labels.AUTHOR_ALIASES)]


@query(f"""with f as (select distinct file_name from ger_texts_meta where file_name is not null union select unnest([{sq.listed(_NAMES)}])), a as (select file_name, split_part(file_name, '_', 1) || '_' || split_part(file_name, '_', 2) as a from f)
select file_name, case file_name {_RENAMED} else file_name end as book, case a {_ALIASED} else a end as author from a""")
def aliased_names(spark, d):
    """Books and the names that sources write in two ways, with the name and author they go by."""
    f = table(spark, d, "ger_texts_meta").where("file_name is not null").select("file_name").union(spark.createDataFrame([(n,) for n in _NAMES], "file_name string")).distinct()
    return f.select("file_name", labels.renamed_values(F.col("file_name"), labels.BOOK_ALIASES).alias("book"), folds.author_group(F.col("file_name"), labels.AUTHOR_ALIASES).alias("author"))


_SEEDS = sorted({*sentiment.POSITIVE, *sentiment.NEGATIVE, *POLARITY})
_TOP = "top as (select word, count(*) as cnt from (select lower(trim(freq, ' ')) as word from relfreq_reviews where trim(freq, ' ') <> '') group by word order by cnt desc, word limit 10000)"


@query(f"with {_TOP}, s as (select distinct unnest([{sq.listed(_SEEDS)}]) as word) select word, cnt from s join top using (word)")
def seeds_among_top_words(spark, d):
    w = table(spark, d, "relfreq_reviews").select(F.lower(F.btrim("freq", F.lit(" "))).alias("word")).where("word <> ''")
    top = ngrams.top(w.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")), 10000, "word")
    one = lambda ws: spark.createDataFrame([(x,) for x in ws], "word string")
    seeds = one(sentiment.POSITIVE).union(one(sentiment.NEGATIVE)).union(one([*POLARITY])).distinct()
    return seeds.join(top, "word")


@query(f"""with {sq.EMB}, nn as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as l from e), p as (select v, l from nn where vec_id in (1, 2)), q as (select v, l from nn where vec_id in (3))
select w.vec_id::varchar as word, round((select sum(list_sum(list_transform(list_zip(w.v, p.v), lambda z: z[1] * z[2])) / (w.l * p.l)) from p) / 2 - (select sum(list_sum(list_transform(list_zip(w.v, q.v), lambda z: z[1] * z[2])) / (w.l * q.l)) from q), 6) as score from nn w""")
def vector_lexicon(spark, d):
    """Words scored by their nearness to centroids: here vectors 1 and 2 against vector 3."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").cast("array<double>").alias("vector"))
    at = {r.word: r.vector for r in v.where(F.col("word").isin("1", "2", "3")).collect()}
    return r6(sentiment.lexicon(v, [at["1"], at["2"]], [at["3"]]), "score")


@query(f"with {sq.TOKENS}, w as (select doc_id, unnest(flatten(toks)) as word from tk) select doc_id, word, count(*) as cnt from w where {sq.tag('word')} in ('ADJ', 'NOUN') group by all")
def nouns_and_adjectives(spark, d):
    w = chunks.with_tokens(doc_chunks(spark, d)).select("doc_id", F.explode(F.flatten("toks")).alias("word"))
    return w.where(corpus.tag_of(F.col("word")).isin("ADJ", "NOUN")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("cnt"))


@query(r"with w as (select distinct text_id, sent_no, tok_no, freq, journal from relfreq_reviews) select text_id, lower(freq) as word, count(*) as cnt from w where regexp_matches(freq, '^\p{L}+$') group by all")
def alphabetic_tokens(spark, d):
    w = table(spark, d, "relfreq_reviews").select("text_id", "sent_no", "tok_no", "freq", "journal").distinct()
    return w.where(F.col("freq").rlike(r"^\p{L}+$")).groupBy("text_id", F.lower("freq").alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


# Evaluation


@query(f"with {catalog._REG}, e as (select fold, least(min(y_true), min(y_pred)) as least, greatest(max(y_true), max(y_pred)) as greatest from rg group by fold) select fold, round(least, 4) as least, round(greatest, 4) as greatest, round((select max(greatest(abs(least), abs(greatest))) from e), 4) as \"limit\" from e")
def axis_limits(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select((k % 5).cast("int").alias("fold"), F.col("o_totalprice").alias("y_true"), (F.col("o_totalprice") * (1 + (k % 13 - 6) / F.lit(10.0))).alias("y_pred"))
    return metrics.axis_limits(r, ["fold"]).withColumns({c: F.round(c, 4) for c in ("least", "greatest", "limit")})


_LONG = " union all ".join(f"select '{b}' as baseline, y_true, {b} as y_pred from bl" for b in metrics.BASELINES)


@query(f"""with {catalog._BASE}, lg as ({_LONG}), t as (select baseline, y_true as class, count(*) as support, sum((y_true = y_pred)::int) as tp from lg group by all), p as (select baseline, y_pred as class, count(*) as said from lg group by all),
rp as (select baseline, coalesce(tp::double / nullif(support, 0), 0) as recall, coalesce(2 * tp::double / (coalesce(said, 0) + coalesce(support, 0)), 0) as f1, coalesce(support, 0) as support from t full join p using (baseline, class)),
ac as (select baseline, avg((y_true = y_pred)::int) as accuracy from lg group by all)
select baseline, round(max(accuracy), 6) as accuracy, round(avg(recall) filter (where support > 0), 6) as balanced_accuracy, round(avg(f1), 6) as f1_macro, round(sum(f1 * support) / sum(support), 6) as f1_weighted from rp join ac using (baseline) group by baseline""")
def baseline_scores(spark, d):
    b = metrics.baseline_scores(metrics.baselines(catalog._predicted(spark, d)))
    return r6(b, "accuracy", "balanced_accuracy", "f1_macro", "f1_weighted")


@query(f"with {catalog._REPORT} select 'f1_macro' as metric, round_even(avg(f1), 3) as value from rp union all select 'f1_weighted', round_even(sum(f1 * support) / sum(support), 3) from rp")
def task_scores(spark, d):
    return metrics.scored(catalog._predicted(spark, d), "multiclass")


@query(f"with {catalog._PRED}, c as (select y_true, count(*) as n from pr group by all) select y_true, unnest(generate_series(1, n)) as copy from c")
def labels_from_counts(spark, d):
    c = catalog._predicted(spark, d).groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))
    rows = metrics.from_counts(c, "y_true")
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("y_true").orderBy("y_true")).cast("bigint"))


@query(f"with {catalog._PRED} select a.fold, a.row_id, y_true, y_pred from (select fold, row_id, y_true from pr where row_id % 2 = 0) a full join (select fold, row_id, y_pred from pr where row_id % 3 = 0) b using (fold, row_id)".replace("a.fold, a.row_id", "fold, row_id"))
def positional_join(spark, d):
    p = catalog._predicted(spark, d)
    return metrics.positional(p.where("row_id % 2 = 0").select("fold", "row_id", "y_true"), p.where("row_id % 3 = 0").select("fold", "row_id", "y_pred"), ["fold", "row_id"])


_FOLDS = "fr as (select (o_orderkey % 5)::int as fold, o_custkey as k from orders)"


@query(f"""with {_FOLDS}, f as (select distinct fold from fr)
select f.fold, 'test' as part, count(*) as n_rows, count(distinct k) as n_keys from f join fr using (fold) group by f.fold
union all select f.fold, 'train', count(*), count(distinct k) from f join fr on fr.fold <> f.fold group by f.fold""")
def fold_shapes(spark, d):
    t = table(spark, d, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("fold"), F.col("o_custkey").alias("k"))
    return labels.fold_shapes(t, "fold", "k")


# Feature tables


@query(f"with {sq.TOKENS}, {sq.grams(1)}, g as (select doc_id, chunk_id, round(count(*)::double / sum(cnt), 6) as type_token_ratio from g1 group by all), {sq.grams(2).replace('q2 as', 'q2 as')}, h as (select doc_id, chunk_id, round(count(*)::double / sum(cnt), 6) as ratio_of_unique_bigrams from g2 group by all) select * from g join h using (doc_id, chunk_id)")
def joined_features(spark, d):
    """Feature frames of one grain joined on their keys, each key once."""
    c = doc_chunks(spark, d)
    a = stylometry.unique_ratio(ngrams.chunk_counts(c, KEYS, 1), KEYS, "type_token_ratio")
    b = stylometry.unique_ratio(ngrams.chunk_counts(c, KEYS, 2), KEYS, "ratio_of_unique_bigrams")
    return r6(features.joined([a, b], [*KEYS, "chunk_id"], checked=True), "type_token_ratio", "ratio_of_unique_bigrams")


@query("select chunk_key, file_name, chunk_id, round(type_token_ratio_chunk, 6) as type_token_ratio_chunk from (select distinct on (chunk_key) * from chunk_features order by chunk_key)")
def features_without_families(spark, d):
    t = table(spark, d, "chunk_features").dropDuplicates(["chunk_key"])
    return r6(features.without(t, ["average_sentence_embedding", "word_length"], keep=("chunk_key",)), "type_token_ratio_chunk")


_TAGSET = ["ADJ", "ADP", "ADV", "CONJ", "DET", "NOUN", "PRON", "VERB"]


@query(f"""with {catalog._TAGS}, q as (select doc_id, chunk_id, unnest(flatten(tags)) as gram from tg) select doc_id, chunk_id, """ + ", ".join(f"round(count(*) filter (where gram = '{t}')::double / count(*), 6) as pos_unigram_{t}" for t in _TAGSET) + " from q group by all")
def pos_wide(spark, d):
    """Shares of tags, a column for each."""
    s = ngrams.selected_shares(corpus.tag_counts(catalog._tagged(spark, d), KEYS, 1), KEYS, 100)
    w = ngrams.wide(s, KEYS, _TAGSET, "pos_unigram")
    return r6(w, *(f"pos_unigram_{t}" for t in _TAGSET))


@query(f"with {sq.CHUNKS} select doc_id, list(chunk_id order by chunk_id) as chunk_ids from chunks group by doc_id")
def chunks_of_documents(spark, d):
    return ngrams.chunk_lists(doc_chunks(spark, d), "doc_id")


@query(f"with {sq.CHUNKS}, n as (select doc_id, count(*) as n from chunks group by doc_id) select doc_id, (sum(n) over (order by doc_id) - n)::bigint as first, n from n")
def chunk_offsets(spark, d):
    return ngrams.offsets(doc_chunks(spark, d), "doc_id")


@query("select file_name, pub_year, null::bigint as sum_libraries from ger_texts_meta union all select file_name, pub_year, sum_libraries from ger_texts_circulating_libs")
def united_rows(spark, d):
    a, b = table(spark, d, "ger_texts_meta").select("file_name", "pub_year"), table(spark, d, "ger_texts_circulating_libs").select("file_name", "pub_year", F.col("sum_libraries").cast("bigint").alias("sum_libraries"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select * from " + catalog._values(LEXICON) + " t(word, score)")
def frame_of_dictionary(spark, d):
    return labels.frame_of(spark, LEXICON, "word", "score")

