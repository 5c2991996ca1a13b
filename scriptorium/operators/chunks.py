"""From documents to sentences and chunks. No step shuffles: a document's sentences are an array, a chunk is a slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx


def with_sentences(docs: DataFrame, text: str = "text", out: str = "sentences", splitter=None) -> DataFrame:
    """``docs`` with its sentences as an array. ``splitter`` is a Column function text -> array<string>, by default a
    cut after end marks; documents without text are dropped."""
    return docs.where(F.col(text).isNotNull()).withColumn(out, (splitter or tx.sentences)(F.col(text)))


def sentence_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sent_idx, sentence), positions from 0."""
    return with_sentences(docs, text).select(key, F.posexplode("sentences").alias("sent_idx", "sentence"))


def chunk_rows(docs: DataFrame, keys: list[str], size: int | None, text: str = "text") -> DataFrame:
    """(keys, chunk_id, sentences): runs of ``size`` sentences. A last shorter run counts only if it is the first one;
    size None makes a document one chunk."""
    d = with_sentences(docs, text).where(F.size("sentences") > 0)
    if size is None:
        return d.select(*keys, F.lit(0).alias("chunk_id"), "sentences")
    count = F.greatest(F.lit(1), F.floor(F.size("sentences") / size)).cast("int")
    ids = d.withColumn("chunk_id", F.explode(F.sequence(F.lit(0), count - 1)))
    return ids.select(*keys, "chunk_id", F.slice("sentences", F.col("chunk_id") * size + 1, size).alias("sentences"))


def hopping_rows(docs: DataFrame, keys: list[str], size: int, step: int, text: str = "text") -> DataFrame:
    """(keys, win_id, sentences): runs of ``size`` sentences, one every ``step``; shorter runs only as the first."""
    d = with_sentences(docs, text).where(F.size("sentences") > 0)
    last = F.greatest(F.lit(0), F.floor((F.size("sentences") - size) / step)).cast("int")
    ids = d.withColumn("win_id", F.explode(F.sequence(F.lit(0), last)))
    return ids.select(*keys, "win_id", F.slice("sentences", F.col("win_id") * step + 1, size).alias("sentences"))


def packed_paragraphs(docs: DataFrame, keys: list[str], budget: int, text: str = "text", keep_open: bool = False) -> DataFrame:
    """(keys, para_id, paragraph): sentences packed greedily into paragraphs of at most ``budget`` words; longer sentences
    are skipped. The last, open paragraph is given only with ``keep_open``."""
    words = lambda s: F.size(tx.tokens(s))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        fits = s["n"] + words(x) <= budget
        grown = F.struct(s["done"].alias("done"), F.when(s["n"] == 0, x).otherwise(F.concat(s["open"], F.lit(" "), x)).alias("open"), (s["n"] + words(x)).alias("n"))
        closed = F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x.alias("open"), words(x).alias("n"))
        return F.when(words(x) > budget, s).when(fits | (s["n"] == 0), grown).otherwise(closed)

    d = with_sentences(docs, text).withColumn("p", F.aggregate("sentences", start, step))
    paragraphs = F.when(F.lit(keep_open) & (F.col("p.n") > 0), F.concat("p.done", F.array("p.open"))).otherwise(F.col("p.done"))
    return d.select(*keys, F.posexplode(paragraphs).alias("para_id", "paragraph"))


def token_batches(docs: DataFrame, keys: list[str], budget: int, text: str = "text", pad: bool = False, padding: str = "[PAD]") -> DataFrame:
    """(keys, para_id, tokens, n_tokens): the words of packed paragraphs of at most ``budget`` words, filled up with ``padding`` to
    that length if ``pad`` is set; n_tokens counts the words alone."""
    rows = packed_paragraphs(docs, keys, budget, text, keep_open=True).withColumn("tokens", tx.tokens(F.col("paragraph")))
    n = F.size("tokens")
    filled = F.concat("tokens", F.array_repeat(F.lit(padding), F.greatest(F.lit(budget) - n, F.lit(0)))) if pad else F.col("tokens")
    return rows.select(*keys, "para_id", filled.alias("tokens"), n.alias("n_tokens"))


def with_tokens(chunks: DataFrame) -> DataFrame:
    """Chunks with ``toks``, the normalised words of each sentence, if they haven't got them."""
    if "toks" in chunks.columns:
        return chunks
    return chunks.withColumn("toks", F.transform("sentences", lambda s: tx.tokens(tx.normalised(s))))


def raw_text(sentences: str = "sentences") -> Column:
    return F.array_join(sentences, " ")
