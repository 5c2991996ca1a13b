"""Text expressions on the JVM side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms, and characters that become several.
PLAIN_FROM = "àáâãäåāăąçćčďèéêëēęěìíîïīñńňòóôõöøōŕřśšťùúûüūůýÿźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ‘’‚“”„–—‐«»…"
PLAIN_TO = 'aaaaaaaaacccdeeeeeeeiiiiinnnooooooorrsstuuuuuuyyzzzAAAAAACEEEEIIIINOOOOOOUUUUY\'\'\'"""---<>.'
SEVERAL = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "þ": "th", "đ": "d", "ł": "l"}
PUNCTUATION = r"[!-/:-@\[-`{-~]"

# Letters of names by which other scripts are read, where that isn't the name's first letter.
READ_AS = {"CHI": "c", "KSI": "x", "XI": "x", "YERU": "y", "HARD": "", "SOFT": "", "SHORT": "y"}
SCRIPTS = ("GREEK", "CYRILLIC", "DEVANAGARI", "THAI", "HIRAGANA", "KATAKANA")


def _by_name(first: int, last: int) -> tuple[str, str, str]:
    """(characters, their Latin letters, characters without sound) of a range of Unicode: a letter is read as the first letter
    of its own name, capitals as capitals; vowel signs as the vowel; tone marks, viramas and accents have no sound."""
    letters, latin, mute = "", "", ""
    for code in range(first, last):
        c = chr(code)
        words = unicodedata.name(c, "").split()
        if unicodedata.combining(c) and not set(words) & {"VOWEL", "SARA"} or "CHARACTER MAI" in " ".join(words):
            mute += c
        elif words and words[0] in SCRIPTS and unicodedata.category(c)[0] in "LM":
            own = [w for w in words[1:] if w not in ("CAPITAL", "SMALL", "LETTER", "CHARACTER", "VOWEL", "SIGN", "SARA", "FINAL", "CANDRA")]
            if own and words[0] == "CYRILLIC" and len(own[0]) == 2 and own[0][0] == "E":
                own = [own[0][1]]  # el, em, en, er, es, ef
            if own and (x := READ_AS.get(own[0], own[0][0].lower())).isascii():
                letters, latin, mute = (letters + c, latin + (x.upper() if "CAPITAL" in words else x), mute) if x else (letters, latin, mute + c)
    return letters, latin, mute


_ranges = [_by_name(*r) for r in ((0x0300, 0x0370), (0x0370, 0x0400), (0x0400, 0x0460), (0x0900, 0x0980), (0x0E00, 0x0E80), (0x3040, 0x3100))]
#: All characters that are transliterated one by one, and what they become; those beyond the end of the latter vanish.
ALL_FROM = PLAIN_FROM + "".join(r[0] for r in _ranges) + "".join(r[2] for r in _ranges)
ALL_TO = PLAIN_TO + "".join(r[1] for r in _ranges)


def transliterated(c: Column) -> Column:
    """Latin text without marks. Greek, Cyrillic, Devanagari, Thai and kana become one Latin letter a character, by the
    characters' names; Chinese characters stay as they are."""
    for a, b in SEVERAL.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, ALL_FROM, ALL_TO)


def stripped(c: Column) -> Column:
    """A text without any white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Line ends to blanks, then three blanks to one and two to one, once each."""
    for a, b in (("\r\n", " "), ("\n", " "), ("   ", " "), ("  ", " ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalised(c: Column) -> Column:
    """Lower case, transliterated, other than letters to single blanks, trimmed."""
    return F.trim(F.regexp_replace(transliterated(F.lower(c)), "[^a-zA-Z]+", " "))


def tokens(c: Column) -> Column:
    """Words between blanks; none for an empty text."""
    return F.filter(F.split(c, " "), lambda x: x != "")


#: The commonest words of the languages in Latin script, by which a missing language code is told.
COMMON = {"en": ["the", "a", "and", "of", "that", "his", "her", "their"], "de": ["der", "die", "das", "und", "den", "dem", "mit"], "fr": ["le", "la", "et", "les", "un", "une", "l", "que", "dans"]}


def is_english(lang: Column, words: Column) -> Column:
    """Whether a text is English: by its code, in whatever way it is written, and without a code by its commonest words."""
    code = F.element_at(F.split(F.lower(F.trim(lang)), "[-_]"), 1)
    count = lambda common: F.size(F.filter(words, lambda x: x.isin(common)))
    n = {k: count(v) for k, v in COMMON.items()}
    told = (n["en"] > n["de"]) & (n["en"] > n["fr"])
    return F.when(code.isNull() | code.isin("", "und"), told).otherwise(code.isin("en", "eng", "english"))


def sentences(c: Column, least: int = 4) -> Column:
    """Trimmed sentences of at least ``least`` characters, cut after . ! ? and blanks. An array in text order."""
    cut = F.split(F.regexp_replace(collapsed(c), r"([.!?]) +", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.char_length(s) >= least)


def count_of(c: Column, pattern: str) -> Column:
    """Number of characters that a character class matches."""
    return F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def syllables(word: Column) -> Column:
    """Vowel groups of a plain lower-case word, one at least."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(word, F.lit("([aeiouy]+)"), 1)))


def key_parts(name: Column, n: int) -> Column:
    """The first ``n`` parts of a key joined by underscores."""
    return F.substring_index(name, "_", n)


def review_key(stem: Column) -> tuple[Column, Column, Column]:
    """(id, year, journal) of a review's file stem ``NNNNN_YYYY_journal_rest``; null where the stem has another form."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(stem, r"^(\d{5})_(\d{4})_([^_]+)_", i), F.lit(""))

    return part(1).cast("int"), part(2).cast("int"), part(3)


def ngrams(sentence_tokens: Column, n: int) -> Column:
    """n-grams over an array of sentences' words. For n > 1 each sentence gets n - 1 begin and end marks, and grams run
    across sentences."""
    if n == 1:
        return F.flatten(sentence_tokens)
    marks = [F.lit("<BOS>")] * (n - 1), [F.lit("<EOS>")] * (n - 1)
    flat = F.flatten(F.transform(sentence_tokens, lambda t: F.concat(F.array(*marks[0]), t, F.array(*marks[1]))))
    # an array of one array: its words are made once and not again for each gram
    return F.transform(F.array(flat), lambda f: F.transform(F.sequence(F.lit(1), F.size(f) - (n - 1)), lambda i: F.array_join(F.slice(f, i, n), " ")))[0]


def sentence_grams(tags: Column, n: int) -> Column:
    """Tag n-grams of one sentence, joined by underscores; marks for n > 1, no gram crosses the sentence."""
    if n == 1:
        return tags
    t = F.concat(F.array(*[F.lit("BOS")] * (n - 1)), tags, F.array(*[F.lit("EOS")] * (n - 1)))
    return F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), "_"))
