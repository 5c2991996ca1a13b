"""Counts of n-grams at the levels chunk, book and corpus, kept in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.chunks import with_tokens

#: Consecutive keys whose offsets are summed in one task.
OFFSET_KEYS = 1_000_000


def chunk_counts(chunks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, chunk_id, gram, cnt)."""
    grams = with_tokens(chunks).select(*keys, "chunk_id", F.explode(tx.ngrams(F.col("toks"), n)).alias("gram"))
    return grams.groupBy(*keys, "chunk_id", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def char_counts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_id, ch, cnt) over the transliterated text of a chunk."""
    chars = chunks.select(*keys, "chunk_id", F.explode(F.split(tx.transliterated(F.array_join("sentences", " ")), "")).alias("ch"))
    return chars.where("ch <> ''").groupBy(*keys, "chunk_id", "ch").agg(F.count(F.lit(1)).alias("cnt"))


def book_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram, cnt), the sums of a book's chunks."""
    return counts.groupBy(*keys, "gram").agg(F.sum("cnt").alias("cnt"))


def corpus_counts(counts: DataFrame) -> DataFrame:
    """(gram, cnt)."""
    return counts.groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def top(counts: DataFrame, k: int, name: str = "gram") -> DataFrame:
    """The k most frequent, ties by name."""
    return counts.orderBy(F.desc("cnt"), name).limit(k)


def chunk_lists(chunks: DataFrame, key: str) -> DataFrame:
    """(key, chunk_ids): the chunks of each document, in order."""
    return chunks.groupBy(key).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def offsets(chunks: DataFrame, key: str) -> DataFrame:
    """(key, first, n): where a document's chunks begin when all are put one after another by key. Sums of a bucket of keys come
    before sums within it, so that no task orders all documents."""
    per = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col(key) / OFFSET_KEYS))
    buckets = per.groupBy("b").agg(F.sum("n").alias("bn"))
    before = buckets.select("b", (F.sum("bn").over(Window.orderBy("b")) - F.col("bn")).alias("before"))  # a row per bucket
    own = F.sum("n").over(Window.partitionBy("b").orderBy(key)) - F.col("n")
    return per.withColumn("own", own).join(before, "b").select(key, (F.col("before") + F.col("own")).alias("first"), "n")


def restricted(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of the grams in a vocabulary."""
    return counts.join(vocabulary.select("gram"), "gram", "left_semi")


def document_frequency(counts: DataFrame, key: str) -> DataFrame:
    """(gram, df): in how many documents a gram occurs."""
    return counts.select("gram", key).distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(counts: DataFrame, key: str, n_docs: DataFrame | int | None = None, min_docs: int | None = None, max_docs: int | None = None, min_percent: float | None = None, max_percent: float | None = None) -> DataFrame:
    """(gram, df) within bounds on document frequency, given as numbers or as percentages of ``n_docs`` documents, a number or
    a frame of one row and column, rounded half to even. A lower bound that nothing meets is ignored if there is an upper one."""
    if (min_docs, max_docs, min_percent, max_percent) == (None,) * 4:
        raise ValueError("no bound given")
    if (min_docs is not None and min_percent is not None) or (max_docs is not None and max_percent is not None):
        raise ValueError("a bound is given both as number and percentage")
    df = document_frequency(counts, key)
    if isinstance(n_docs, DataFrame):
        df = df.join(F.broadcast(n_docs.toDF("__docs")))  # one row
    else:
        df = df.withColumn("__docs", F.lit(n_docs).cast("bigint"))
    bound = lambda n, percent: F.lit(n) if percent is None else F.bround(percent / 100 * F.col("__docs"), 0)
    kept = F.lit(True)
    if min_docs is not None or min_percent is not None:
        kept = F.col("df") >= bound(min_docs, min_percent)
        if max_docs is not None or max_percent is not None:
            df = df.join(F.broadcast(df.agg(F.max(kept).alias("__met"))))  # one row
            kept = kept | ~F.col("__met")
    if max_docs is not None or max_percent is not None:
        kept = kept & (F.col("df") <= bound(max_docs, max_percent))
    return df.where(kept).select("gram", "df")


def relative_frequency(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, cnt, freq): share of all rows."""
    counts = words.groupBy(word).agg(F.count(F.lit(1)).alias("cnt"))
    total = words.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select(word, "cnt", (F.col("cnt") / F.col("total")).alias("freq"))  # total is one row


def selected_shares(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, chunk_id, gram, share) of the corpus's k most frequent grams; a share is that among the selected grams of
    the chunk. Chunks without any have no rows."""
    picked = top(corpus_counts(counts), k)
    own = Window.partitionBy(*keys, "chunk_id")
    return restricted(counts, picked).withColumn("share", tx.ratio(F.col("cnt"), F.sum("cnt").over(own))).drop("cnt")


def wide(shares: DataFrame, keys: list[str], names: list[str], prefix: str) -> DataFrame:
    """One column per named gram, 0 where absent."""
    pivoted = shares.groupBy(*keys, "chunk_id").pivot("gram", names).agg(F.first("share")).na.fill(0.0)
    return pivoted.select(*keys, "chunk_id", *(F.col(f"`{n}`").alias(f"{prefix}_{n}") for n in names))
