"""From review texts to a sentiment lexicon, scores and classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import StopWordsRemover, Word2Vec, Word2VecModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions import vectors as vx

# Evaluative words around which a lexicon is built.
POSITIVE = """excellent admirable estimable exemplary invaluable incomparable superb outstanding wonderful perfect superior worthy
fine exceptional skillful masterful extraordinary impressive notable noteworthy""".split()
NEGATIVE = """terrible grievous hideous ghastly disgusting unfavourable disagreeable distasteful error fault unpleasant imprudent
unlikely undesirable unreasonable absurd offensive unsuitable questionable disconcerting""".split()


def alpha_words(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, word): lower-case words of letters, in order."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(F.lower(F.replace(F.col(text), F.lit("\n"), F.lit(" "))), F.lit(r"(\p{L}+)"), 1)).alias("pos", "word"))


def without_stopwords(words: DataFrame, language: str = "english", word: str = "word", stopwords: list[str] | None = None) -> DataFrame:
    """Rows whose word is none of the stop words given, or of Spark's of a language; repeated words stay."""
    return words.where(~F.col(word).isin(StopWordsRemover.loadDefaultStopWords(language) if stopwords is None else stopwords))


def seed_words(vectors: DataFrame, positive: list[str], negative: list[str], top_words: DataFrame) -> DataFrame:
    """(word, vector) of the seed words, each once, that have a vector and are among the top words."""
    seeds = sorted({*positive, *negative})
    return vectors.where(F.col("word").isin(seeds)).join(top_words.select("word"), "word", "left_semi").select("word", "vector")


def typical_words(frequencies: DataFrame, comparison: DataFrame) -> DataFrame:
    """(word, diff) of words more frequent than in a comparison corpus; both (word, freq)."""
    c = comparison.select("word", F.col("freq").alias("other"))
    return frequencies.join(c, "word", "left").select("word", (F.col("freq") - F.coalesce("other", F.lit(0.0))).alias("diff")).where("diff > 0")


def word_vectors(sentences: DataFrame, words: str = "words", size: int = 100, window: int = 5, min_count: int = 5, seed: int = 1) -> Word2VecModel:
    """Word2Vec trained over rows of word arrays."""
    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol=words, outputCol="vector").fit(sentences)


def similar_words(vectors: DataFrame, seeds: list[str], n: int) -> DataFrame:
    """(seed, word, cosine): the n words most similar to each seed word, vectors being (word, vector)."""
    from pyspark.sql import Window

    s = vectors.where(F.col("word").isin(seeds)).select(F.col("word").alias("seed"), F.col("vector").alias("sv"))
    near = vectors.join(F.broadcast(s), F.col("word") != F.col("seed")).withColumn("cosine", vx.cosine(F.col("vector"), F.col("sv")))  # a row per given seed
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("cosine"), "word"))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).select("seed", "word", "cosine")


def seeds_and_neighbours(vectors: DataFrame, seeds: list[str], n: int) -> DataFrame:
    """(word, vector) of the seed words that have a vector and of the n words most similar to each."""
    near = similar_words(vectors, seeds, n).select("word").union(vectors.where(F.col("word").isin(seeds)).select("word")).distinct()
    return vectors.join(near, "word", "left_semi").select("word", "vector")


def affinity_clusters(points: pd.DataFrame, damping: float = 0.5, rounds: int = 200, preference: float | None = None) -> pd.DataFrame:
    """(word, cluster, exemplar) of at most a few thousand seed words (word, vector) by affinity propagation."""
    x = np.array(points["vector"].tolist(), float)
    n = len(x)
    if n == 0:
        return pd.DataFrame({"word": [], "cluster": [], "exemplar": []})
    s = -((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(s, np.median(s) if preference is None else preference)
    s += 1e-12 * np.random.default_rng(1).standard_normal((n, n)) * np.abs(s).max()
    r, a = np.zeros((n, n)), np.zeros((n, n))
    at = np.arange(n)
    for _ in range(rounds):
        t = a + s
        best = t.argmax(axis=1)
        first = t[at, best].copy()
        t[at, best] = -np.inf
        new = s - first[:, None]
        new[at, best] = s[at, best] - t.max(axis=1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[at, at] = r[at, at]
        new = p.sum(axis=0)[None] - p
        diagonal = new[at, at].copy()
        new = np.minimum(new, 0)
        new[at, at] = diagonal
        a = damping * a + (1 - damping) * new
    exemplars = np.flatnonzero((a + r)[at, at] > 0)
    if not len(exemplars):
        exemplars = np.array([int((a + r)[at, at].argmax())])
    label = s[:, exemplars].argmax(axis=1)
    label[exemplars] = np.arange(len(exemplars))
    words = points["word"].tolist()
    return pd.DataFrame({"word": words, "cluster": label, "exemplar": [words[exemplars[c]] for c in label]})


def cluster_words(clusters: DataFrame) -> DataFrame:
    """(cluster, words): a cluster's words in order, joined by blanks."""
    return clusters.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words"))


def lexicon(vectors: DataFrame, positive: list[list[float]], negative: list[list[float]]) -> DataFrame:
    """(word, score): mean cosine with the positive centroids less that with the negative ones."""
    def side(cs: list[list[float]]):
        if not cs:
            return F.lit(0.0)
        return sum(vx.cosine(F.col("vector"), F.array(*map(F.lit, c))) for c in cs) / len(cs)

    return vectors.select("word", (side(positive) - side(negative)).alias("score"))


def sentence_words(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sent_idx, word) with one row, word null, for a sentence without words."""
    s = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(tx.sentences(F.col(text))).alias("sent_idx", "s"))
    return s.select(key, "sent_idx", F.explode_outer(tx.tokens(tx.normalised(F.col("s")))).alias("word"))


#: Scores are summed as whole multiples of 1/SCALE, and means of sentences as those of 1/FINE, so that no order of rows
#: changes a sum.
SCALE, FINE = 1_000_000, 1_000_000_000_000


def _mean_of_sentences(by_sentence: DataFrame, key: str, name: str) -> DataFrame:
    whole = by_sentence.withColumn("w", F.round(F.col("s") * float(FINE)).cast("decimal(38,0)"))
    return whole.groupBy(key).agg((F.sum("w").cast("double") / (F.count(F.lit(1)) * F.lit(float(FINE)))).alias(name))


def lexicon_scores(words: DataFrame, lexicon: DataFrame, key: str, name: str = "sentiscore_average") -> DataFrame:
    """(key, name): mean over a review's sentences of the mean over their words in the lexicon; sentences without one
    count as 0."""
    hits = words.join(lexicon.select("word", F.round(F.col("score") * SCALE).cast("bigint").alias("w")), "word", "left")
    by_sentence = hits.groupBy(key, "sent_idx").agg(F.coalesce(tx.ratio(F.sum("w"), F.count("w") * SCALE), F.lit(0.0)).alias("s"))
    return _mean_of_sentences(by_sentence, key, name)


def polarity_scores(words: DataFrame, polarity: DataFrame, boosted: DataFrame | None, key: str, boost: float = 1.5, name: str = "sentiment_polarity") -> DataFrame:
    """(key, name): mean over all sentences of the mean over all words of polarity, 0 for unknown words, times ``boost``
    for words of a second lexicon."""
    scored = words.join(polarity.select("word", F.col("score").alias("p")), "word", "left")
    value = F.coalesce("p", F.lit(0.0))
    if boosted is not None:
        scored = scored.join(boosted.select("word", F.lit(boost).alias("b")), "word", "left")
        value = value * F.coalesce("b", F.lit(1.0))
    whole = F.round(value * SCALE).cast("bigint")
    by_sentence = scored.groupBy(key, "sent_idx").agg(F.coalesce(tx.ratio(F.sum(F.when(F.col("word").isNotNull(), whole)), F.count("word") * SCALE), F.lit(0.0)).alias("s"))
    return _mean_of_sentences(by_sentence, key, name)


def classified(scores: DataFrame, key: str, positive: str, negative: str, positive_share: float = 0.5, negative_share: float = 0.5) -> DataFrame:
    """(key, positive, negative, classified, sentiment): positive if the score ``positive`` exceeds a share of its first
    quartile over positive values, negative if ``negative`` is below a share of its own first quartile over negative
    values; a review that is both or neither is not_classified, with sentiment 0."""
    q = scores.agg(
        F.expr(f"percentile(case when `{positive}` > 0 then cast(`{positive}` as double) end, 0.25)").alias("qp"),
        F.expr(f"percentile(case when `{negative}` < 0 then cast(`{negative}` as double) end, 0.25)").alias("qn"),
    )
    p, n = F.col(positive), F.col(negative)
    marked = scores.join(F.broadcast(q)).withColumn("__p", F.coalesce((p > 0) & (p > F.col("qp") * positive_share), F.lit(False))).withColumn("__n", F.coalesce((n < 0) & (n < F.col("qn") * negative_share), F.lit(False)))  # q is one row
    both = lambda a, b: F.col(a) & ~F.col(b)
    kind = F.when(both("__p", "__n"), "positive").when(both("__n", "__p"), "negative").otherwise("not_classified")
    value = F.when(both("__p", "__n"), p).when(both("__n", "__p"), n).otherwise(0.0)
    return marked.select(key, positive, negative, kind.alias("classified"), value.alias("sentiment"))


def quartile_classes(scores: DataFrame, key: str, score: str, positive_share: float = 0.5, negative_share: float = 0.5) -> DataFrame:
    """(key, score, classified): positive above a share of the first quartile of the positive scores, negative below that
    of the magnitudes of the negative ones, else not_classified."""
    q = scores.agg(
        F.expr(f"percentile(case when `{score}` > 0 then cast(`{score}` as double) end, 0.25)").alias("qp"),
        F.expr(f"percentile(case when `{score}` < 0 then -cast(`{score}` as double) end, 0.25)").alias("qn"),
    )
    s = F.col(score)
    kind = F.when(s > positive_share * F.col("qp"), "positive").when(s < -negative_share * F.col("qn"), "negative").otherwise("not_classified")
    return scores.join(F.broadcast(q)).select(key, score, kind.alias("classified"))  # q is one row


def exclusive(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``."""
    return a.join(b.select(key), key, "left_anti")


def confusion(scored: DataFrame, cls: str, score: str) -> DataFrame:
    """One row (tp, fn, tn, fp): class 1 is met by a score above 0, any other by one below 0; a score of 0 meets none."""
    c, s = F.col(cls) == 1, F.col(score)
    n = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).alias
    return scored.agg(n(c & (s > 0))("tp"), n(c & ~(s > 0))("fn"), n(~c & (s < 0))("tn"), n(~c & ~(s < 0))("fp"))


def rates(counts: DataFrame) -> DataFrame:
    """Recall, precision and accuracy of confusion counts."""
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    return counts.select(tx.ratio(tp, tp + fn).alias("recall"), tx.ratio(tp, tp + fp).alias("precision"), tx.ratio(tp + tn, tp + fn + tn + fp).alias("accuracy"))
