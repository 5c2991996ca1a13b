"""Queries of embedding features on the tables of chunks and of sentence vectors, and SQL with the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import vectors as vx
from scriptorium.operators import chunks, encoders, geometry
from scriptorium.plans import sqlparts as sq
from scriptorium.plans.catalog import KEYS, doc_chunks, docs, query, r6
from scriptorium.session import table

_rounded = "list_transform({}, lambda x: round(x, 5))"


def _doc2vec(spark, d):
    c = table(spark, d, "chunk")
    return c.select("chunk_key", "file_name", "chunk_id", F.struct("chunk_id", "chunk_key").alias("place"), F.col("doc2vec_chunk_embedding").alias("v"))


def _sbert(spark, d):
    c = table(spark, d, "chunk_features").dropDuplicates(["chunk_key"])
    return c.select("chunk_key", "file_name", "chunk_id", F.struct("chunk_id", "chunk_key").alias("place"), F.col("average_sentence_embedding").alias("v"))


def _source(name: str) -> str:
    """The CTE e (chunk_key, label, chunk_id, v) of complete vectors, and their centroids."""
    t, c = ("chunk", "doc2vec_chunk_embedding") if name == "doc2vec" else ("chunk_features", "average_sentence_embedding")
    return f"""e as (select distinct on (chunk_key) chunk_key, file_name as label, chunk_id, list_transform({c}, lambda x: x::double) as v from {t} where {c} is not null and len(list_filter({c}, lambda x: isnan(x) or x is null)) = 0 order by chunk_key),
m as (select label, i, avg(x) as m, count(*) as n from (select label, unnest(v) as x, unnest(generate_series(1, len(v))) as i from e) group by all), cent as (select label, max(n) as n, list(m order by i) as c from m group by label)"""


def _pairs(name: str, source) -> None:
    e = _source(name)

    @query(f"with {e} select label as file_name, round(avg({sq.distance('v', 'c')}), 6) as {name}_intra_textual_variance from e join cent using (label) group by label")
    def variance(spark, d):
        return r6(geometry.spread(source(spark, d), "file_name", "v", f"{name}_intra_textual_variance"), f"{name}_intra_textual_variance")

    @query(f"with {e}, s as (select label, {sq.distance('v', 'p')} as s from (select *, lag(v) over (partition by label order by chunk_id, chunk_key) as p from e) where p is not null) select label as file_name, round(coalesce(avg(s), 0), 6) as {name}_stepwise_distance from (select distinct label from e) left join s using (label) group by label")
    def steps(spark, d):
        return r6(geometry.stepwise(source(spark, d), "file_name", "place", "v", f"{name}_stepwise_distance"), f"{name}_stepwise_distance")

    @query(f"""with {e}, k as (select cent.label, n, e.label as owner, row_number() over (partition by cent.label order by {sq.distance('v', 'c')}, chunk_key) as r from cent, e)
select label as file_name, round(avg(case when owner = label then 0.0 else 1.0 end::double), 6) as overlap_score_{name} from k where r <= n group by label""")
    def overlap(spark, d):
        return r6(geometry.overlap(source(spark, d), "file_name", "chunk_key", "v", f"overlap_score_{name}"), f"overlap_score_{name}")

    @query(f"with {e} select a.label as file_name, round(min({sq.distance('a.c', 'b.c')}), 6) as outlier_score_{name} from cent a join cent b on a.label <> b.label group by a.label")
    def outlier(spark, d):
        return r6(geometry.outlier(source(spark, d), "file_name", "v", f"outlier_score_{name}"), f"outlier_score_{name}")

    for f, n in ((variance, f"{name}_intra_textual_variance"), (steps, f"{name}_stepwise_distance"), (overlap, f"overlap_score_{name}"), (outlier, f"outlier_score_{name}")):
        _renamed(f, n)


def _renamed(f, name: str) -> None:
    """Registers a query of a factory under its own name."""
    from scriptorium.plans.catalog import ORACLE, QUERIES

    QUERIES[name] = QUERIES.pop(f.__name__)
    if f.__name__ in ORACLE:
        ORACLE[name] = ORACLE.pop(f.__name__)


_pairs("doc2vec", _doc2vec)
_pairs("sbert", _sbert)

_SENTENCE_VECTORS = "sv as (select chunk_key, unnest(generate_series(1, len(sbert_sentence_embeddings))) - 1 as sent_idx, unnest(sbert_sentence_embeddings) as v from chunk)"


def _sentence_vectors(spark, d):
    c = table(spark, d, "chunk").select("chunk_key", F.posexplode("sbert_sentence_embeddings").alias("sent_idx", "v"))
    return c.where(vx.complete(F.col("v")))


@query(f"""with {_SENTENCE_VECTORS}, m as (select chunk_key, i, avg(x::double) as m from (select chunk_key, unnest(v) as x, unnest(generate_series(1, len(v))) as i from sv where len(list_filter(v, lambda x: isnan(x) or x is null)) = 0) group by all)
select chunk_key, {_rounded.format('list(m order by i)')} as average_sentence_embedding from m group by chunk_key""")
def average_sentence_embedding(spark, d):
    c = geometry.centroids(_sentence_vectors(spark, d), "chunk_key", "v")
    return c.select("chunk_key", F.transform("centroid", lambda x: F.round(x, 5)).alias("average_sentence_embedding"))


@query("select chunk_key, unnest(generate_series(1, len(doc2vec_chunk_embedding)))::int as place, unnest(doc2vec_chunk_embedding)::double as doc2vec_chunk_embedding from chunk where len(list_filter(doc2vec_chunk_embedding, lambda x: isnan(x))) = 0")
def doc2vec_chunk_embedding(spark, d):
    c = table(spark, d, "chunk").where(vx.complete(F.col("doc2vec_chunk_embedding")))
    return c.select("chunk_key", F.posexplode(vx.doubles(F.col("doc2vec_chunk_embedding"))).alias("p", "doc2vec_chunk_embedding")).select("chunk_key", (F.col("p") + 1).alias("place"), "doc2vec_chunk_embedding")


@query("""with f as (select distinct on (chunk_key) chunk_key, average_sentence_embedding as v from chunk_features order by chunk_key)
select chunk_key, file_name, len(sbert_sentence_embeddings)::int as n_sentences, len(v)::int as length, len(sbert_sentence_embeddings[1])::int as sentence_length from chunk left join f using (chunk_key) where sbert_sentence_embeddings is not null""")
def sentence_alignment(spark, d):
    """Chunks, their sentence vectors and their mean, put side by side by key."""
    f = table(spark, d, "chunk_features").dropDuplicates(["chunk_key"]).select("chunk_key", F.size("average_sentence_embedding").alias("length"), F.col("average_sentence_embedding").isNull().alias("none"))
    c = table(spark, d, "chunk").where("sbert_sentence_embeddings is not null")
    first = F.get("sbert_sentence_embeddings", F.lit(0))
    return c.join(f, "chunk_key", "left").select(
        "chunk_key", "file_name", F.size("sbert_sentence_embeddings").alias("n_sentences"), F.when(~F.col("none"), F.col("length")).alias("length"), F.when(first.isNotNull(), F.size(first)).alias("sentence_length")
    )


_HEX = "('0x' || substr(md5({}), {}, 1))::int"


@query(f"""with {sq.TOKENS}, t as (select doc_id, chunk_id, unnest(generate_series(1, len(toks))) - 1 as sent_idx, unnest(toks) as ws from tk),
w as (select doc_id, chunk_id, sent_idx, {_HEX.format('w', 1)} as a, case when {_HEX.format('w', 2)} % 2 = 0 then 1 else -1 end as s from (select doc_id, chunk_id, sent_idx, unnest(ws) as w from t)),
c as (select doc_id, chunk_id, sent_idx, a, sum(s)::double as x from w group by all), z as (select doc_id, chunk_id, sent_idx, sqrt(sum(x * x)) as z from c group by all),
p as (select t.doc_id, t.chunk_id, t.sent_idx, i, coalesce(x / nullif(z, 0), 0) as x from t cross join (select unnest(range(0, 16)) as i) left join c on c.doc_id = t.doc_id and c.chunk_id = t.chunk_id and c.sent_idx = t.sent_idx and a = i left join z on z.doc_id = t.doc_id and z.chunk_id = t.chunk_id and z.sent_idx = t.sent_idx)
select doc_id, chunk_id::int as chunk_id, sent_idx::int as sent_idx, list(round(x, 5) order by i) as vector from p group by all""")
def encoded_sentences(spark, d):
    v = encoders.sentence_vectors(doc_chunks(spark, d), KEYS)
    return v.withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 5)))


@query()
def chunk_vectorizer(spark, d):
    return encoders.chunk_vectorizer(doc_chunks(spark, d), KEYS)


@query(f"with {sq.CHUNKS} select doc_id, chunk_id, row_number() over (order by md5(doc_id || '|' || chunk_id || '|42'))::int as place from chunks")
def shuffled_chunks(spark, d):
    """The order in which chunks are given to training."""
    from pyspark.sql import Window

    s = encoders.shuffled(doc_chunks(spark, d).select("doc_id", "chunk_id"), KEYS)
    # ranks within the first byte of the hash after the number of rows before it, so that no task ranks all rows
    s = s.withColumn("b", F.substring("place", 1, 2))
    before = s.groupBy("b").count().select("b", (F.sum("count").over(Window.orderBy("b")) - F.col("count")).alias("before"))  # 256 rows
    ranked = s.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("place"))).join(F.broadcast(before), "b")
    return ranked.select("doc_id", "chunk_id", (F.col("r") + F.col("before")).cast("int").alias("place"))


@query(f"with recursive {sq.DOCS}, {sq.PACKED}, b as (select doc_id, para_id, list_filter(string_split(paragraph, ' '), lambda w: w <> '') as w from p) select doc_id, para_id, len(w)::int as n_tokens, list_concat(w, list_transform(range(len(w), 60), lambda i: '[PAD]')) as tokens from b")
def token_batches(spark, d):
    return chunks.token_batches(docs(spark, d), KEYS, 60, pad=True)
