"""The queries of the training-data operators: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import leakage, names, neighbours, pieces, pii, scans, sentences, splits, term_counts, tokenizer
from scriptorium.session import materialize, shared_folder, table

#: Where the public vocabularies lie; every executor has them there.
TOKENIZERS = "/opt/tokenizers"


def p1_grouped(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_books(table(spark, d, "ger_texts_meta"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.later_members(p1_grouped(spark, d))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_splits(p1_grouped(spark, d), table(spark, d, "split_plan"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    parts = (("chunk", "doc2vec_chunk_embedding"), ("chunk_features", "average_sentence_embedding"))
    return neighbours.vector_table([(table(spark, d, t), "chunk_key", c) for t, c in parts])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_pairs(_vectors(spark, d))


def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest keys of every vector whose key is divisible by 100, by greedy search."""
    vectors = _vectors(spark, d)
    index = neighbours.neighbour_graph(vectors)
    return neighbours.search_keys(index, vectors.where("key % 100 = 0"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_clusters(table(spark, d, "ger_texts_circulating_libs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(p3_clusters(spark, d))


def _spans(spark: SparkSession, d: str, name: str, key: str, content: str) -> DataFrame:
    limit, overlap = pieces.limits_of(table(spark, d, "size_limits"), name)
    return pieces.piece_spans(table(spark, d, name), key, content, name, limit, overlap)


def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d, "raw_docs", "raw_id", "doc").unionByName(_spans(spark, d, "chunk", "chunk_key", "sbert_sentence_embeddings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(p4_spans(spark, d))


def p4_text_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.with_content(_spans(spark, d, "raw_docs", "raw_id", "doc"), table(spark, d, "raw_docs"), "raw_id", "doc")


def p4_vector_pieces(spark: SparkSession, d: str) -> DataFrame:
    name, key, content = "chunk", "chunk_key", "sbert_sentence_embeddings"
    return pieces.with_content(_spans(spark, d, name, key, content), table(spark, d, name), key, content)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all terms, read from the state after two deliveries. The first brings half of the records, of which some have
    only every other part yet and some come with a copy under a key that no table has; the second brings the other half,
    those records' whole form in place of the former one, and takes the copies back."""
    tokens, chunks = table(spark, d, "relfreq_reviews"), table(spark, d, "chunk")
    terms = materialize(term_counts.token_terms(tokens).unionByName(term_counts.map_terms(chunks)), "terms")
    turn = F.pmod(F.xxhash64("src_table", "record"), F.lit(32))
    first, changed = turn < 16, turn == 3
    early = terms.where(changed & (F.col("part") % 2 == 0))
    copies = terms.where(turn == 5).withColumn("record", -1 - F.col("record"))
    store = term_counts.TermCounts(spark, f"{shared_folder(spark)}/term-counts-{uuid.uuid4().hex}")
    store.apply(terms.where(first & ~changed).unionByName(early).unionByName(copies))
    counts = store.apply(terms.where(~first | changed), early.unionByName(copies))
    totals = tokens.agg(F.lit("relfreq_reviews").alias("src_table"), F.countDistinct("text_id").alias("total")).unionByName(
        chunks.agg(F.lit("chunk").alias("src_table"), F.count(F.lit(1)).alias("total"))
    )
    return term_counts.marked(counts, totals)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_counts(spark, d).where("mark is not null").select("src_table", "term", "mark")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Bodies and reviews: (src_table, item_key, lang, origin, text)."""
    parts = (("raw_docs", "raw_id", "doc"), ("reviews", "text_id", "reviews_txt"))
    a, b = (table(spark, d, t).select(F.lit(t).alias("src_table"), F.col(k).cast("bigint").alias("item_key"), "lang", "origin", F.col(c).alias("text")) for t, k, c in parts)
    return a.unionByName(b)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return sentences.sentences(texts, texts.where("origin = 'keyed'")).select("src_table", "item_key", "sent_end").distinct()


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return sentences.sentences(texts, texts).distinct()


def _scans(spark: SparkSession, d: str) -> DataFrame:
    """Bodies and reviews with what a running header may repeat: (src_table, item_key, lang, origin, name, journal, text)."""
    a = table(spark, d, "raw_docs").select(F.lit("raw_docs").alias("src_table"), F.col("raw_id").cast("bigint").alias("item_key"), "lang", "origin", F.col("file_name").alias("name"), F.lit(None).cast("string").alias("journal"), F.col("doc").alias("text"))
    b = table(spark, d, "reviews").select(F.lit("reviews").alias("src_table"), F.col("text_id").cast("bigint").alias("item_key"), "lang", "origin", F.col("textfile").alias("name"), "journal", F.col("reviews_txt").alias("text"))
    return a.unionByName(b)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.line_problems(_scans(spark, d))


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_scans(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, d, "documents"), "text", ["doc_id"], f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_passages"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(table(spark, d, "documents"))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p2_found, p2_search, p3_clusters, p3_found, p4_found, p4_spans, p4_text_pieces, p4_vector_pieces, p5_counts, p5_found, p6_found, p6_sentences, p7_found, p7_paragraphs, p8_ids, p9_found, p9_leaks, p10_found, p10_masked,
    )
}
