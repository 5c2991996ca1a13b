from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import chunks, corpus, ngrams, stylometry


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, extra string")


def chunk(spark, sentences, size=None):
    return spark.createDataFrame([(1, 0, sentences)], "doc_id bigint, chunk_id int, sentences array<string>")


def counted(df):
    return {r.gram: r.cnt for r in df.collect()}


def test_cross_sentence_bigrams(spark):
    got = counted(ngrams.chunk_counts(chunk(spark, ["a b", "c"]), ["doc_id"], 2))
    assert got == {"<BOS> a": 1, "a b": 1, "b <EOS>": 1, "<EOS> <BOS>": 1, "<BOS> c": 1, "c <EOS>": 1}


def test_empty_normalised_sentence(spark):
    got = counted(ngrams.chunk_counts(chunk(spark, ["a", "123"]), ["doc_id"], 2))
    assert got == {"<BOS> a": 1, "a <EOS>": 1, "<EOS> <BOS>": 1, "<BOS> <EOS>": 1}


def test_trigrams_against_counter(spark):
    from collections import Counter

    sents = [["a", "b"], ["c"]]
    flat = [w for s in sents for w in ["<BOS>", "<BOS>", *s, "<EOS>", "<EOS>"]]
    want = Counter(" ".join(flat[i : i + 3]) for i in range(len(flat) - 2))
    assert counted(ngrams.chunk_counts(chunk(spark, ["a b", "c"]), ["doc_id"], 3)) == dict(want)


def test_tag_grams_stay_in_sentences(spark):
    t = spark.createDataFrame([(1, 0, [["N"], ["V"]])], "doc_id bigint, chunk_id int, tags array<array<string>>")
    assert counted(corpus.tag_counts(t, ["doc_id"], 2)) == {"BOS_N": 1, "N_EOS": 1, "BOS_V": 1, "V_EOS": 1}


def test_chunk_rule(spark):
    seven = " ".join(f"Sentence {i} ends." for i in range(7))
    d = docs(spark, [(1, seven, "x"), (2, "Only one here. And two.", None), (3, "", None), (4, None, None), (5, "abc", None)])
    got = {(r.doc_id, r.chunk_id): len(r.sentences) for r in chunks.chunk_rows(d, ["doc_id"], 3).collect()}
    assert got == {(1, 0): 3, (1, 1): 3, (2, 0): 2}


def test_sentence_length(spark):
    got = [r.sentence for r in chunks.sentence_rows(docs(spark, [(1, "abc. abcd. ab", None)]), "doc_id").collect()]
    assert got == ["abc.", "abcd."]


def test_packed_paragraphs(spark):
    text = "One two three. Four five. Six seven eight nine. Ten."
    p = chunks.packed_paragraphs(docs(spark, [(1, text, None)]), ["doc_id"], 5)
    assert [r.paragraph for r in p.orderBy("para_id").collect()] == ["One two three. Four five."]
    p = chunks.packed_paragraphs(docs(spark, [(1, text, None)]), ["doc_id"], 5, keep_open=True)
    assert [r.paragraph for r in p.orderBy("para_id").collect()] == ["One two three. Four five.", "Six seven eight nine. Ten."]


def test_word_features(spark):
    c = spark.createDataFrame([(1, 0, "aa", 3), (1, 0, "b", 1)], "doc_id bigint, chunk_id int, gram string, cnt bigint")
    r = stylometry.word_features(c, ["doc_id"]).first()
    assert r.average_word_length == 3.5 and r.types == 2 and r.tokens == 4 and r.type_token_ratio == 0.5


def test_no_vocabulary_keeps_row(spark):
    ch = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, chunk_id int")
    c = spark.createDataFrame([(1, 0, "a", 2), (2, 0, "zz", 1)], "doc_id bigint, chunk_id int, gram string, cnt bigint")
    v = spark.createDataFrame([("a",)], "gram string")
    got = {r.doc_id: r.d for r in corpus.distance_from_corpus(ch, c, v, ["doc_id"], "d").collect()}
    assert set(got) == {1, 2} and got[2] is None


def test_document_frequency_bounds(spark):
    rows = [(i, 0, "all", 1) for i in range(10)] + [(i, 0, "half", 1) for i in range(5)] + [(1, 0, "one", 1)]
    c = spark.createDataFrame(rows, "doc_id bigint, chunk_id int, gram string, cnt bigint")
    got = {r.gram for r in ngrams.vocabulary(c, "doc_id", n_docs=10, min_percent=5, max_percent=50).collect()}
    assert got == {"half", "one"}  # half to even: 0.5 -> 0
    assert {r.gram for r in ngrams.vocabulary(c, "doc_id", min_docs=50, max_docs=5).collect()} == {"half", "one"}


def test_normalised(spark):
    df = spark.createDataFrame([("Don’t  Grüße-ÄÖ 12",), ("",), (None,)], "s string")
    assert [r.n for r in df.select(tx.normalised(F.col("s")).alias("n")).collect()] == ["don t grusse ao", "", None]


def test_review_key(spark):
    df = spark.createDataFrame([("00042_1861_The-Journal_rest",), ("odd",)], "s string")
    i, y, j = tx.review_key(F.col("s"))
    assert [tuple(r) for r in df.select(i, y, j).collect()] == [(42, 1861, "The-Journal"), (None, None, None)]


def test_other_scripts_have_words(spark):
    df = spark.createDataFrame([("Ο κήπος",), ("ёлка в саду",), ("बाग़",), ("สวน",), ("かがみ",)], "s string")
    got = [r.n for r in df.select(tx.normalised(F.col("s")).alias("n")).collect()]
    assert got[0] == "o kepos" and got[1] == "ilka v sadu" and all(got)
