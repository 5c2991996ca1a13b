"""Sentence boundaries across languages and scripts (problem 6).

Method: abbreviations, collocations and sentence starters are learnt without labels, per language, by log-likelihood
ratios over the counts of all documents; each period is then classified with these statistics. Headings are learnt as
well: one-line paragraphs without end mark that recur. Other scripts end sentences by their own marks; Thai by blanks.

Rules beside the statistics: an end mark followed by a small letter ends nothing (speech and the clause that names its
speaker are one sentence); a paragraph end or a heading line always ends a sentence; closing quotes and brackets belong
to the sentence they close.

Results for special inputs: null, empty and blank texts have no sentences; a text without end mark is one sentence; the
language of a text without one is told from its script and commonest words; repeated rows count once.

What was learnt goes to the executors while it is small enough; beyond that, what each text asks of it is joined with it,
and each text gets its own answers. Both ways give the same sentences.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize

#: Thresholds of the log-likelihood ratios, and the share of sentence-like successors that makes an abbreviation final.
ABBREVIATION, STARTER, COLLOCATION, FINAL = 0.3, 30.0, 7.88, 0.3
#: Learnt types that go to the executors at most, and their characters.
MODEL_ROWS, MODEL_CHARS = 500_000, 32_000_000
#: Parts in which a fact that many texts ask for is joined.
SALTS = 16
#: An abbreviation's length is damped by exp(-length): longer types than this cannot reach the threshold.
LONGEST_ABBREVIATION = 12
#: The commonest words of the languages in Latin script.
COMMON = {"de": {"der", "die", "das", "und", "den", "dem", "mit"}, "en": {"the", "a", "and", "of", "that", "his", "her", "their"}, "fr": {"le", "la", "et", "les", "un", "une", "l", "que", "dans"}}
ALIAS = {"deu": "de", "ger": "de", "eng": "en", "fra": "fr", "fre": "fr", "ell": "el", "gre": "el", "jpn": "ja", "hin": "hi", "tha": "th", "zho": "zh"}

_w = r"\w\u0300-\u036f\u0900-\u0963\u0971-\u097f"
_token = rf"[{_w}]+(?:[.’'-]+[{_w}]+)*"
_TOKENS = re.compile(rf"{_token}(?:\.(?!\.))?")
_open = "\"'„“”«»‹›‘‚(\\[¿¡–—"
_AFTER = re.compile(rf"\.\s+[{_open}\s]*+(?=([^\W\d_][{_w}]*+)(?!\.))")
_LATIN_WORDS = re.compile(r"[a-zà-ÿ]+")
_SCRIPTS = [("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[一-鿿]"))]
_closing = r"(?:[ \u00a0\u202f]?[»›](?=[\s.,;:!?)»]|$)|[\"'”’“‘«‹)\]」』）】〉》])*"
_MARK = re.compile(rf"(?P<m>[.!?…]+|[。！？｡]+|[।॥]|[;\u037e])(?P<c>{_closing})(?P<s>\s*)")
_BREAK = re.compile(r"[^\S\n]*\n[^\S\n]*(?:\n\s*)+")
_LINE = re.compile(r"[^\n]+")
_DIGITS = re.compile(r"\d+")
_last = re.compile(rf"({_token})$")


def language(lang: str | None, text: str) -> str:
    """The language under which a text is counted: as recorded, else by its script or its commonest words."""
    if lang:
        low = lang.strip().lower()
        low = ALIAS.get(low, low.split("-")[0].split("_")[0])
        if low in ("de", "en", "fr", "th", "hi", "el", "ja", "zh"):
            return low
    size = len(text.split())
    for name, p in _SCRIPTS:
        if len(p.findall(text)) * 3 > size:
            return name
    seen = Counter(_LATIN_WORDS.findall(text.lower()))
    best = max(COMMON, key=lambda x: (sum(seen[w] for w in COMMON[x]), x))
    if lang and re.fullmatch(r"[a-z]{2,3}", low):
        return low
    return best if any(seen[w] for w in COMMON[best]) else "und"


def heading_form(line: str) -> str | None:
    """What two headings have in common, or null if a line can't be one."""
    s = line.strip()
    if not s or len(s) > 60 or s[-1] in ".!?…。！？।;:,»«”“’)」-":
        return None
    return _DIGITS.sub("9", s)


def _paragraph_headings(text: str) -> list[str]:
    return [h for p in _BREAK.split(text.replace("\r", "")) if "\n" not in (q := p.strip()) and (h := heading_form(q))]


def _pairs(text: str) -> list[tuple[str, str]]:
    """(word before a period, capitalised word behind it)."""
    out = []
    for m in _AFTER.finditer(text):
        follower = m.group(1)
        if follower[0].isupper():
            at = m.start()
            w = _last.search(text, max(0, at - LONGEST_ABBREVIATION - 1), at)
            if w and at - w.start() <= LONGEST_ABBREVIATION:
                out.append((w.group(), follower))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, a, b, n): w words as they stand, p words with period, n pairs over a period, h headings."""
    total: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flush():
        # pieces between blanks were counted; each different one is taken apart once
        for lang in [x for x, kind in total if kind == "raw"]:
            words = total[lang, "w"]
            for piece, n in total.pop((lang, "raw")).items():
                for w in _TOKENS.findall(piece):
                    words[w] += n
        rows = [(lang, kind, *(k if kind == "n" else (k, "")), n) for (lang, kind), c in total.items() for k, n in c.items()]
        cols = list(zip(*rows)) or [[]] * 5
        total.clear()
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at : at + 50_000], pa.string()) for c in cols[:4]), pa.array(cols[4][at : at + 50_000], pa.int64())], names=["lang", "kind", "a", "b", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lang = language(lang, text)
            total[lang, "h"].update(_paragraph_headings(text))
            total[lang, "raw"].update(text.split())
            total[lang, "n"].update(_pairs(text))
        if sum(map(len, total.values())) > 1_500_000:
            yield from flush()
    yield from flush()


def _log_likelihood(k, n, p):
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _dunning(both, first, second, total):
    """Log-likelihood ratio of two events that occur together ``both`` times."""
    tiny = F.lit(1e-9)
    p = F.greatest(tiny, F.least(1 - tiny, second / total))
    p1 = F.greatest(tiny, F.least(1 - tiny, both / first))
    p2 = F.greatest(tiny, F.least(1 - tiny, (second - both) / F.greatest(total - first, F.lit(1.0))))
    return -2 * (_log_likelihood(both, first, p) + _log_likelihood(second - both, total - first, p) - _log_likelihood(both, first, p1) - _log_likelihood(second - both, total - first, p2))


def learn(texts: DataFrame) -> DataFrame:
    """(lang, kind, a, b): what was learnt from all texts (lang, text). kind A: abbreviation; F: abbreviation that often
    ends sentences; S: word that starts sentences; C: a follows b's period within a sentence; H: heading."""
    raw = texts.where("trim(text) <> ''").select("lang", "text").mapInArrow(_counts, "lang string, kind string, a string, b string, n bigint")
    counts = materialize(raw.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")), "sentence-counts")
    period = F.col("a").endswith(".")
    forms = counts.where("kind = 'w'").select("lang", F.when(period, F.expr("substring(a, 1, length(a) - 1)")).otherwise(F.col("a")).alias("form"), period.alias("period"), "n")
    totals = forms.groupBy("lang").agg(F.sum("n").cast("double").alias("total"), F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).cast("double").alias("periods"))
    n_with, n_without = (F.sum(F.when(F.col("period") == p, F.col("n")).otherwise(0)).cast("double") for p in (True, False))
    types = forms.groupBy("lang", F.lower("form").alias("w")).agg(n_with.alias("p"), n_without.alias("q"), F.sum(F.when(F.col("form") == F.lower("form"), F.col("n")).otherwise(0)).cast("double").alias("small"))
    inner = F.length(F.regexp_replace("w", "[^.]", ""))
    size = F.length(F.regexp_replace("w", "[.]", ""))
    rate = F.greatest(F.lit(1e-6), F.least(F.lit(0.98), F.col("periods") / F.col("total")))
    ratio = 2 * (_log_likelihood(F.col("p"), F.col("p") + F.col("q"), F.lit(0.99)) - _log_likelihood(F.col("p"), F.col("p") + F.col("q"), rate))
    score = ratio * F.exp(-size.cast("double")) * (inner + 1) * F.pow(F.greatest(size, F.lit(1)).cast("double"), -F.least(F.col("q"), F.lit(50.0)))
    found = (
        types.where((F.col("p") > 0) & (size <= LONGEST_ABBREVIATION) & F.col("w").rlike(r"[^\d.,_'’-]"))
        .join(F.broadcast(totals), "lang").where(score >= ABBREVIATION).select("lang", "w")
    )
    pairs = counts.where("kind = 'n' and not a rlike '[0-9]$'").select("lang", F.lower("a").alias("w"), "b", "n")
    marked = pairs.join(found.withColumn("abbreviation", F.lit(True)), ["lang", "w"], "left")
    after = marked.groupBy("lang", "b").agg(F.sum("n").cast("double").alias("follows"), F.sum(F.when(F.col("abbreviation").isNull(), F.col("n")).otherwise(0)).cast("double").alias("starts"))
    of_word = types.select("lang", F.col("w").alias("b_low"), (F.col("p") + F.col("q")).alias("seen"), "small")
    rated = after.withColumn("b_low", F.lower("b")).join(of_word, ["lang", "b_low"]).join(F.broadcast(totals), "lang")
    # a word that follows periods far more often than chance, or that is mostly small elsewhere
    starts = _dunning(F.col("starts"), F.col("periods"), F.col("seen"), F.col("total")) >= STARTER
    rated = rated.select(
        "lang", "b", "follows", "seen", "total",
        ((F.col("small") > 0.1 * F.col("seen")) | (starts & (F.col("starts") / F.greatest(F.col("periods"), F.lit(1.0)) > F.col("seen") / F.col("total")))).alias("starter"),
    )
    successors = marked.where("abbreviation").join(rated, ["lang", "b"], "left")
    by_abbreviation = types.select("lang", "w", F.col("p").alias("first"))
    final = (
        successors.groupBy("lang", "w").agg(F.sum(F.when(F.col("starter"), F.col("n")).otherwise(0)).alias("ends"))
        .join(by_abbreviation, ["lang", "w"]).where(F.col("ends") >= FINAL * F.col("first")).select("lang", "w")
    )
    together = successors.where("starter").join(final, ["lang", "w"], "left_anti").join(by_abbreviation, ["lang", "w"]).where(
        _dunning(F.col("n").cast("double"), F.col("first"), F.col("seen"), F.col("total")) >= COLLOCATION
    ).where(F.col("n") / F.col("first") > F.col("seen") / F.col("total"))
    blank = F.lit("")
    used = rated.where("starter").join(marked.where("abbreviation").select("lang", "b").distinct(), ["lang", "b"], "left_semi")
    numbered = rated.where("starter").select("lang", "b")
    out = found.select("lang", F.lit("A").alias("kind"), F.col("w").alias("a"), blank.alias("b"))
    out = out.union(final.select("lang", F.lit("F"), "w", blank)).union(used.select("lang", "b").union(numbered).distinct().select("lang", F.lit("S"), "b", blank))
    out = out.union(together.select("lang", F.lit("C"), "b", "w")).union(counts.where("kind = 'h' and n >= 2").select("lang", F.lit("H"), "a", blank))
    return materialize(out, "sentence-model")


class Model:
    """What was learnt, by language."""

    def __init__(self, rows: list[tuple[str, str, str, str]]):
        self.sets: dict[tuple[str, str], set] = defaultdict(set)
        for lang, kind, a, b in rows:
            self.sets[lang, kind].add((a, b) if kind == "C" else a)

    def of(self, lang: str) -> tuple[set, set, set, set, set]:
        return tuple(self.sets.get((lang, k), set()) for k in "AFSCH")


def sentence_ends(text: str, lang: str, model: Model) -> list[int]:
    """Ends of a text's sentences, in characters from its start."""
    n = len(text.rstrip())
    if not n:
        return []
    if lang == "th":
        return [m.start() for m in re.finditer(r"\s+", text[:n]) if m.start()] + [n]
    abbreviations, final, starters, together, headings = model.of(lang)
    forced = {m.start() for m in _BREAK.finditer(text, 0, n)}
    if headings:
        for m in _LINE.finditer(text, 0, n):
            line = m.group()
            if len(line) <= 62 and heading_form(line) in headings:
                forced.add(m.start() + len(line.rstrip()))
                before = text[: m.start()].rstrip() if m.start() < 400 else text[m.start() - 400 : m.start()].rstrip()
                if before:
                    forced.add(m.start() - (min(m.start(), 400) - len(before)))
    ends: list[int] = []
    cuts = sorted(forced)
    depth_from = 0
    for m in _MARK.finditer(text, 0, n):
        mark, end = m["m"], m.end("c")
        if end >= n:
            break
        if mark == ";" or mark == ";":
            if lang != "el":
                continue
        blank = m["s"]
        if mark[0] in "。！？｡":
            quoted = text.count("「", depth_from, end) + text.count("『", depth_from, end) - text.count("」", depth_from, end) - text.count("』", depth_from, end)
            nxt = text[m.end() : m.end() + 1]
            if quoted > 0 or (m["c"] and nxt in "とっ、，") or (not blank and nxt in "、，"):
                continue
            ends.append(end)
            depth_from = end
            continue
        if not blank:
            continue
        if "\n" in blank and end in forced:
            ends.append(end)
            continue
        at = m.end()
        k = at
        while k < n and (text[k] in _open or text[k].isspace() or text[k] in "…."):
            k += 1
        c = text[k] if k < n else ""
        if mark[0] in "।॥":
            ends.append(end)
            continue
        if c.islower():
            continue
        if mark[0] == "…" or mark.startswith(".."):
            if m.start() and text[m.start() - 1].isspace():
                continue
            ends.append(end)
            continue
        if mark != ".":
            ends.append(end)
            continue
        if not m["c"]:
            w = _last.search(text, max(0, m.start() - 40), m.start())
            word = w.group(1) if w else ""
            if word:
                low = word.lower()
                following = re.match(rf"[{_w}]+", text[k : k + 40])
                follower = following.group() if following else ""
                if word.isdigit():
                    if not c.isdigit() and follower not in starters:
                        continue
                elif len(word) == 1 and word.isupper():
                    continue
                elif low in abbreviations or "." in word:
                    if not c.isupper() and c.lower() == c.upper() and c.isalpha():
                        continue
                    if c.isdigit():
                        continue
                    # a word that is an abbreviation itself starts no sentence after one that ends none
                    again = text[k + len(follower) : k + len(follower) + 1] == "." and (len(follower) == 1 or follower.lower() in abbreviations or f"{follower.lower()}." in abbreviations)
                    if low not in final and (again or follower not in starters or (follower, low) in together):
                        continue
        ends.append(end)
    ends = sorted({*ends, *cuts, n})
    # an end without a word since the last one belongs to the next sentence, unless a heading or paragraph ends there
    out, start = [], 0
    for e in ends:
        piece = text[start:e]
        if not piece.strip() or (not any(ch.isalnum() for ch in piece) and e not in forced and e != n):
            continue
        if not any(ch.isalnum() for ch in piece) and out and e == n:
            out[-1] = e
            continue
        out.append(e)
        start = e
    return out


def asked_facts(text: str, lang: str) -> set[tuple[str, str, str]]:
    """All (kind, a, b) that ``sentence_ends`` may look up for a text."""
    out = {("H", h, "") for m in _LINE.finditer(text) if len(line := m.group()) <= 62 and (h := heading_form(line))}
    n = len(text)
    for m in _MARK.finditer(text):
        if m["m"] != "." or m["c"] or not m["s"]:
            continue
        w = _last.search(text, max(0, m.start() - 40), m.start())
        if w:
            k = m.end()
            while k < n and (text[k] in _open or text[k].isspace() or text[k] in "…."):
                k += 1
            low, following = w.group(1).lower(), re.match(rf"[{_w}]+", text[k : k + 40])
            follower = following.group() if following else ""
            out |= {("A", low, ""), ("F", low, ""), ("S", follower, ""), ("C", follower, low), ("A", follower.lower(), ""), ("A", f"{follower.lower()}.", "")}
    return out


def _rows_of_sentences(src, keys, found: list[tuple[str, list[int]]]) -> pa.RecordBatch:
    where, ends, starts = [], [], []
    for i, (text, own) in enumerate(found):
        last = 0
        for e in own:
            piece = text[last:e]
            where.append(i)
            starts.append(last + len(piece) - len(piece.lstrip()))
            ends.append(e)
            last = e
    at = pa.array(where, pa.int64())
    return pa.RecordBatch.from_arrays([src.take(at), keys.take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["src_table", "item_key", "sent_start", "sent_end"])


def _splitter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            langs, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield _rows_of_sentences(batch.column(0), batch.column(1), [(t, sentence_ends(t, language(lang, t), model)) for lang, t in zip(langs, texts)])

    return run


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, lang, kind, a, b) that each text asks."""
    for batch in batches:
        rows = [(r, lang, *f) for r, lang, t in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))) for lang in [language(lang, t)] for f in asked_facts(t, lang)]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["row", "lang", "kind", "a", "b"])


def _told_splitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for lang, t, told in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            lang = language(lang, t)
            found.append((t, sentence_ends(t, lang, Model([(lang, f["kind"], f["a"], f["b"]) for f in told or ()]))))
        yield _rows_of_sentences(batch.column(0), batch.column(1), found)


def sentences(learn_from: DataFrame, split: DataFrame) -> DataFrame:
    """(src_table, item_key, sent_start, sent_end) of the texts in ``split`` (src_table, item_key, lang, text), with what
    all texts of ``learn_from`` (lang, text) teach. Ends are exclusive, without the white space behind."""
    model = learn(learn_from)
    spark = split.sparkSession
    texts = split.where("trim(text) <> '' and item_key is not null").select("src_table", "item_key", "lang", "text")
    schema = "src_table string, item_key bigint, sent_start int, sent_end int"
    rows, chars = model.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("a") + F.char_length("b")), F.lit(0))).first()
    if rows <= MODEL_ROWS and chars <= MODEL_CHARS:
        return texts.mapInArrow(_splitter(spark.sparkContext.broadcast([tuple(r) for r in model.collect()])), schema)
    numbered = texts.distinct().select(F.xxhash64("src_table", "item_key", F.coalesce("lang", F.lit("\0")), "text").alias("row"), "*")
    asked = numbered.mapInArrow(_asking, "row bigint, lang string, kind string, a string, b string").withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)))
    salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    told = asked.join(salted, ["lang", "kind", "a", "b", "salt"]).groupBy("row").agg(F.collect_list(F.struct("kind", "a", "b")).alias("told"))  # a text's own facts
    return numbered.join(told, "row", "left").select("src_table", "item_key", "lang", "text", "told").mapInArrow(_told_splitter, schema)
