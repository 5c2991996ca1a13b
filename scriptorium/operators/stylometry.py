"""Numeric features of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.chunks import with_tokens
from scriptorium.operators.ngrams import chunk_counts


def char_features(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios of kinds of characters over the transliterated text, and its length. No shuffle."""
    t = chunks.select(*keys, "chunk_id", tx.transliterated(F.array_join("sentences", " ")).alias("t"))
    n = F.char_length("t")
    share = lambda p: tx.ratio(tx.count_of(F.col("t"), p), n)
    return t.select(
        *keys, "chunk_id",
        share(tx.PUNCTUATION).alias("ratio_of_punctuation_marks"), share("[0-9]").alias("ratio_of_digits"), share(" ").alias("ratio_of_whitespaces"),
        share("!").alias("ratio_of_exclamation_marks"), share(r"\?").alias("ratio_of_question_marks"), share(",").alias("ratio_of_commas"),
        tx.ratio(tx.count_of(F.col("t"), "[A-Z]"), tx.count_of(F.col("t"), "[A-Za-z]")).alias("ratio_of_uppercase_letters"), n.cast("bigint").alias("text_length"),
    )


def sentence_features(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and greatest number of words in a sentence, and mean paragraph length. No shuffle."""
    sizes = F.transform("toks", lambda t: F.size(t))
    paragraphs = F.transform(F.split(F.array_join("sentences", " "), "\n"), lambda p: F.char_length(p))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return with_tokens(chunks).select(
        *keys, "chunk_id", tx.ratio(total(sizes), F.size("toks")).alias("average_number_of_words_in_sentence"),
        F.array_max(sizes).cast("bigint").alias("maximum_number_of_words_in_sentence"), tx.ratio(total(paragraphs), F.size(paragraphs)).alias("average_paragraph_length"),
    )


def entropy(cnt):
    """Entropy in nats over a group's counts."""
    c = cnt.cast("double")
    return F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)


def word_features(counts: DataFrame, keys: list[str]) -> DataFrame:
    """From unigram counts: types, tokens, type-token ratio, word length over types, entropy."""
    return counts.groupBy(*keys, "chunk_id").agg(
        F.count(F.lit(1)).alias("types"), F.sum("cnt").alias("tokens"), tx.ratio(F.count(F.lit(1)), F.sum("cnt")).alias("type_token_ratio"),
        F.avg(F.char_length("gram") * F.col("cnt")).alias("average_word_length"), entropy(F.col("cnt")).alias("unigram_entropy"),
    )


def unique_ratio(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, chunk_id, name): different grams over all grams."""
    return counts.groupBy(*keys, "chunk_id").agg(tx.ratio(F.count(F.lit(1)), F.sum("cnt")).alias(name))


def conditional_entropy(counts: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """(keys, chunk_id, name): entropy of the last word given the words before it, averaged over the latter unweighted."""
    left = counts.withColumn("ctx", F.substring_index("gram", " ", n - 1))
    by_context = left.groupBy(*keys, "chunk_id", "ctx").agg(entropy(F.col("cnt")).alias("h"))
    return by_context.groupBy(*keys, "chunk_id").agg(F.avg("h").alias(name))


def gram_features(counts: DataFrame, keys: list[str], n: int, ratio: str, mean: str) -> DataFrame:
    """(keys, chunk_id, ratio, mean): ``unique_ratio`` and ``conditional_entropy`` from one pass over the counts."""
    left = counts.withColumn("ctx", F.substring_index("gram", " ", n - 1))
    by_context = left.groupBy(*keys, "chunk_id", "ctx").agg(entropy(F.col("cnt")).alias("h"), F.count(F.lit(1)).alias("types"), F.sum("cnt").alias("n"))
    return by_context.groupBy(*keys, "chunk_id").agg(tx.ratio(F.sum("types"), F.sum("n")).alias(ratio), F.avg("h").alias(mean))


def readability(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Flesch reading ease and Gunning fog, syllables counted as vowel groups. No shuffle."""
    words = F.flatten("toks")
    syllables = F.transform("words", lambda w: tx.syllables(w))
    w = with_tokens(chunks).select(*keys, "chunk_id", F.size("sentences").alias("n_sent"), words.alias("words")).withColumn("syl", syllables)
    n, total = F.size("words"), F.aggregate("syl", F.lit(0), lambda s, x: s + x)
    hard = F.size(F.filter("syl", lambda x: x >= 3))
    per = tx.ratio(n, F.col("n_sent"))
    return w.select(
        *keys, "chunk_id", (206.835 - 1.015 * per - 84.6 * tx.ratio(total, n)).alias("flesch_reading_ease_score"), (0.4 * (per + 100 * tx.ratio(hard, n))).alias("gunning_fog"),
    )


#: Registry of feature groups: name -> (chunks, keys) -> DataFrame by keys and chunk_id.
FEATURES = {
    "characters": char_features,
    "sentences": sentence_features,
    "words": lambda chunks, keys: word_features(chunk_counts(chunks, keys, 1), keys),
    "bigrams": lambda chunks, keys: unique_ratio(chunk_counts(chunks, keys, 2), keys, "ratio_of_unique_bigrams"),
    "trigrams": lambda chunks, keys: unique_ratio(chunk_counts(chunks, keys, 3), keys, "ratio_of_unique_trigrams"),
    "bigram_entropy": lambda chunks, keys: conditional_entropy(chunk_counts(chunks, keys, 2), keys, 2, "bigram_entropy"),
    "trigram_entropy": lambda chunks, keys: conditional_entropy(chunk_counts(chunks, keys, 3), keys, 3, "trigram_entropy"),
    "readability": readability,
}


#: Groups that need a chunk's words only, as counts.
_COUNTED = {"words", "bigrams", "trigrams", "bigram_entropy", "trigram_entropy"}
#: Groups that are worked out together, by the length of their grams.
_TOGETHER = {2: ("bigrams", "bigram_entropy", "ratio_of_unique_bigrams"), 3: ("trigrams", "trigram_entropy", "ratio_of_unique_trigrams")}


def all_features(chunks: DataFrame, keys: list[str], groups: list[str] | None = None) -> DataFrame:
    """Feature groups side by side; chunks without words keep their row with nulls. The words of each chunk are made and shuffled
    once, by the join keys, so that no count of grams is shuffled."""
    groups = groups or list(FEATURES)
    tokens = with_tokens(chunks).select(*keys, "chunk_id", "toks").repartition(*keys, "chunk_id")
    out, names, made = chunks.select(*keys, "chunk_id"), [], set()
    for g in groups:
        both = next(((n, t) for n, t in _TOGETHER.items() if g in t[:2] and set(t[:2]) <= set(groups)), None)
        if both:
            n, (_, mean, ratio) = both
            names.append(ratio if g != mean else mean)
            if n in made:
                continue
            made.add(n)
            part = gram_features(chunk_counts(tokens, keys, n), keys, n, ratio, mean)
        else:
            part = FEATURES[g](tokens if g in _COUNTED else chunks, keys)
            names += [c for c in part.columns if c not in (*keys, "chunk_id")]
        out = out.join(part, [*keys, "chunk_id"], "left")
    return out.select(*keys, "chunk_id", *names)
