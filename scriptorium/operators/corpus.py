"""How chunks stand to the whole corpus: distance of word use, tag and production shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.joins import salted_join
from scriptorium.session import materialize

#: Words whose totals are sent to the executors; of more, totals are joined in salted parts.
BROADCAST_WORDS = 500_000

# Words and word ends by which the plain tagger tells parts of speech.
DETERMINERS = ["the", "a", "an", "der", "die", "das", "den", "dem", "des", "ein", "eine", "le", "la", "les", "un", "une"]
PRONOUNS = ["he", "she", "it", "his", "her", "their", "that", "this", "er", "sie", "es", "il", "elle", "nous", "we", "wir"]
ADPOSITIONS = ["in", "on", "at", "with", "of", "by", "before", "after", "mit", "vor", "nach", "bei", "unter", "neben", "hinter", "aus", "avec", "sans", "sous", "devant", "vers"]
CONJUNCTIONS = ["and", "or", "but", "und", "oder", "aber", "weil", "et", "ou", "mais"]


def tag_of(w: Column) -> Column:
    """Part of speech of a plain lower-case word by word lists and endings."""
    return (
        F.when(w.isin(DETERMINERS), "DET").when(w.isin(PRONOUNS), "PRON").when(w.isin(ADPOSITIONS), "ADP").when(w.isin(CONJUNCTIONS), "CONJ")
        .when(w.rlike("ly$"), "ADV").when(w.rlike("(ed|ing|te|ten|ait)$"), "VERB").when(w.rlike("(ful|ous|ig|lich|igen|lichen|ique)$"), "ADJ").otherwise("NOUN")
    )


def with_tags(chunks_with_toks: DataFrame, tagger=tag_of) -> DataFrame:
    """``tags``, an array of tags for each sentence of ``toks``. ``tagger`` is a Column function of a word."""
    return chunks_with_toks.withColumn("tags", F.transform("toks", lambda s: F.transform(s, lambda w: tagger(w))))


def tag_counts(tagged: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, chunk_id, gram, cnt) of tag n-grams."""
    grams = tagged.select(*keys, "chunk_id", F.explode(F.flatten(F.transform("tags", lambda t: tx.sentence_grams(t, n)))).alias("gram"))
    return grams.groupBy(*keys, "chunk_id", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def production_counts(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_id, gram, cnt) of the productions of a shallow parse: noun phrases are runs of determiner, adjectives
    and nouns, a sentence is what remains with NP in their place."""
    phrase = "(?:DET )?(?:ADJ )*(?:NOUN )+"
    line = lambda t: F.concat(F.array_join(t, " "), F.lit(" "))
    phrases = lambda t: F.transform(F.regexp_extract_all(line(t), F.lit(f"({phrase})"), 1), lambda p: F.concat(F.lit("NP->"), F.replace(F.trim(p), F.lit(" "), F.lit("_"))))
    whole = lambda t: F.concat(F.lit("S->"), F.replace(F.trim(F.regexp_replace(line(t), phrase, "NP ")), F.lit(" "), F.lit("_")))
    filled = F.filter("tags", lambda t: F.size(t) > 0)
    rows = tagged.select(*keys, "chunk_id", F.explode(F.flatten(F.transform(filled, lambda t: F.concat(phrases(t), F.array(whole(t)))))).alias("gram"))
    return rows.groupBy(*keys, "chunk_id", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def distance_from_corpus(chunks: DataFrame, counts: DataFrame, vocabulary: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, chunk_id, name): cosine distance between a chunk's counts and those of the rest of the corpus over a
    vocabulary; null for chunks without a word of it. Only words that occur are touched: the sum of squares of the rest,
    (T - c)^2 over the vocabulary, is T^2 - 2Tc + c^2 summed up."""
    used = counts.join(vocabulary.select("gram"), "gram", "left_semi")
    totals = materialize(used.groupBy("gram").agg(F.sum("cnt").cast("double").alias("t")), "totals")
    whole = totals.agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    c = F.col("cnt").cast("double")
    few = totals.count() <= BROADCAST_WORDS
    joined = used.join(F.broadcast(totals), "gram") if few else salted_join(used, totals, "gram", [*keys, "chunk_id"])  # the commonest words are in every chunk
    sums = joined.groupBy(*keys, "chunk_id").agg(F.sum(F.col("t") * c).alias("tc"), F.sum(c * c).alias("cc"))
    rest = F.col("tt") - 2 * F.col("tc") + F.col("cc")
    value = 1 - F.try_divide(F.col("tc") - F.col("cc"), F.sqrt(F.greatest(rest, F.lit(0.0))) * F.sqrt("cc"))
    scored = sums.join(F.broadcast(whole)).select(*keys, "chunk_id", value.alias(name))  # whole is one row
    return chunks.select(*keys, "chunk_id").join(scored, [*keys, "chunk_id"], "left")
