"""Queries that write tables through the sinks and give what the readers read back, and SQL over the tables written."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.plans.catalog import query
from scriptorium.session import scratch, table
from scriptorium.sources import readers, sinks


@query("select file_name, max(sum_libraries) as sum_libraries, max(pub_year) as pub_year, max(binary_flag) as \"binary\", max(author_viaf) as author_viaf from ger_texts_circulating_libs where file_name is not null group by file_name")
def separated_libraries(spark, d):
    t = table(spark, d, "ger_texts_circulating_libs").where("file_name is not null").groupBy("file_name")
    t = t.agg(F.max("sum_libraries").alias("sum_libraries"), F.max("pub_year").alias("pub_year"), F.max("binary_flag").alias("binary"), F.max("author_viaf").alias("author_viaf"))
    path = scratch(spark, "libraries")
    sinks.classes(t, path)
    return readers.separated(spark, path, "libraries")


@query("select file_name, avg(type_token_ratio_chunk) as type_token_ratio_chunk, avg(average_word_length_chunk) as average_word_length_chunk from (select distinct on (chunk_key) * from chunk_features order by chunk_key) group by file_name")
def feature_file(spark, d):
    t = table(spark, d, "chunk_features").dropDuplicates(["chunk_key"]).groupBy("file_name").agg(F.avg("type_token_ratio_chunk").alias("type_token_ratio_chunk"), F.avg("average_word_length_chunk").alias("average_word_length_chunk"))
    path = scratch(spark, "features")
    sinks.features(t, path)
    return readers.features(spark, path)


@query(r"select text_id, regexp_replace(trim(textfile), '\s+', ' ', 'g') as line from (select distinct text_id, textfile from reviews where textfile is not null)")
def cached_lines(spark, d):
    t = table(spark, d, "reviews").where("textfile is not null").select("text_id", "textfile").distinct()
    path = scratch(spark, "lines")
    sinks.lines(t.select(F.concat_ws("\t", F.col("text_id").cast("string"), tx.stripped(F.regexp_replace("textfile", r"\s+", " "))).alias("l")), "l", path)
    parts = F.split("line", "\t")
    return readers.lines(spark, path).where("line <> ''").select(parts[0].cast("bigint").alias("text_id"), parts[1].alias("line"))


@query("select chunk_key, list_transform(doc2vec_chunk_embedding, lambda x: case when isnan(x) then null else x::double end) as v from chunk where doc2vec_chunk_embedding is not null")
def cached_vectors(spark, d):
    path = scratch(spark, "vectors")
    sinks.vectors(table(spark, d, "chunk").where("doc2vec_chunk_embedding is not null").select("chunk_key", F.col("doc2vec_chunk_embedding").alias("v")), path)
    clean = F.transform("v", lambda x: F.when(F.isnan(x), None).otherwise(x.cast("double")))
    return readers.vectors(spark, path).select("chunk_key", clean.alias("v"))


@query("select (o_orderkey % 5)::int as fold, o_orderkey as row_id, (o_orderkey % 3)::double as y_true, (o_orderkey % 4)::double as y_pred from orders")
def fold_predictions(spark, d):
    k = F.col("o_orderkey")
    path = scratch(spark, "predictions")
    sinks.predictions(table(spark, d, "orders").select((k % 5).cast("int").alias("fold"), k.alias("row_id"), (k % 3).cast("double").alias("y_true"), (k % 4).cast("double").alias("y_pred")), path)
    return spark.read.schema(readers.SCHEMAS["predictions"]).parquet(path).select("fold", "row_id", "y_true", "y_pred")


@query("select 3 as fold, 'book' as features, 'c' || (p_partkey % 40) as combo_id, 'trees' as model, 'p' as params, (p_partkey % 5)::int as split, round(avg(p_retailprice), 6) as metric, null::double as pvalue from part group by 3, 6")
def cv_results_file(spark, d):
    k = F.col("p_partkey")
    t = table(spark, d, "part").groupBy(F.concat(F.lit("c"), k % 40).alias("combo_id"), (k % 5).cast("int").alias("split")).agg(F.round(F.avg("p_retailprice"), 6).alias("metric"))
    path = scratch(spark, "cv")
    sinks.results(t.select("combo_id", F.lit("trees").alias("model"), F.lit("p").alias("params"), "split", "metric", F.lit(None).cast("double").alias("pvalue")), path, {"fold": 3, "features": "book"})
    return readers.separated(spark, path, "cv_results", sep=",", null="NaN")


@query(r"select text_id::varchar as key, len(t)::int as n_sentences, list_sum(list_transform(t, lambda x: len(x)))::bigint as n_words from (select text_id, list(ws order by sent_no) as t from (select text_id, sent_no, list(freq order by tok_no) as ws from (select distinct text_id, sent_no, tok_no, min(freq) as freq from relfreq_reviews where trim(freq, ' ') <> '' group by all) group by all) group by text_id)")
def cached_token_lists(spark, d):
    t = table(spark, d, "relfreq_reviews").where("trim(freq) <> ''").groupBy("text_id", "sent_no", "tok_no").agg(F.min("freq").alias("freq"))
    by_sentence = t.groupBy("text_id", "sent_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "freq"))), lambda x: x["freq"]).alias("ws"))  # a sentence's words
    by_review = by_sentence.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "ws"))), lambda x: x["ws"]).alias("tokens"))  # a review's sentences
    path = scratch(spark, "tokens")
    sinks.token_lists(by_review, "text_id", "tokens", path)
    words = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda s, x: s + F.size(x))
    return readers.token_lists(spark, path).select("key", F.size("tokens").alias("n_sentences"), words.alias("n_words"))
