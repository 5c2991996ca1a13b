"""Personal information inside free text (problem 10).

Method: weak supervision. Patterns propose spans of five types; of names, every two capitalised words side by side, or with a
comma between them. Labelers vote on each span: its shape, labels and titles before it, what stands behind it, labels that
speak against it, a list of given names, and, for names, how the corpus uses the two words (below).
Expectation-maximisation over the counts of all vote patterns estimates how reliable each labeler is and how likely each
pattern is a true case; a span classifier (logistic regression over votes, shape and neighbouring words) is then trained on
these probabilities and decides, so that phrases before and behind names are learnt and not listed. The vote patterns
of all spans are counted; the classifier is fitted on at most SAMPLE spans.

A word is used like a given name if it is hardly ever written small and precedes several different capitalised words; a
word is used like none if it is written small, or if it stands behind words that are, as nouns do behind articles. Two words
that stand together again and again are rather a phrase. These counts cover all texts, and are joined with the spans.

Results for special inputs: null and empty texts hold nothing; a piece that stands several times in a document is
reported once; repeated rows of a document count once; names never cross a line end; of spans that overlap the likeliest
counts, of equally likely ones the earlier, longer one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import salted_join
from scriptorium.session import materialize

TYPES = ("email", "phone", "id_number", "street_address", "name")
#: Spans on which the classifier is fitted, at most; size of its hashed feature space.
SAMPLE, WIDTH = 40_000, 1 << 12
#: Features of a span, shorter lists being filled up with their last one, which all have.
WORDS = 11
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

# Given names of the collection's languages and time.
GIVEN = """
Adelheid Agnes Albert Alexander Alfred Alice Aline Amalie Anna Anne Anselm Anton Antonie Arthur August Auguste Babette
Bastien Benedikt Bernhard Bertha Caroline Catherine Cecily Charles Charlotte Christian Christine Clara Conrad Dorothea
Edith Eduard Edward Eleonore Elisabeth Eliza Elizabeth Elise Emil Emilie Emma Ernst Eugen Ferdinand Francis Franz
Franziska Friederike Friedrich Fritz Georg George Gertrud Gottfried Gustav Hans Hedwig Heinrich Helene Henri Henriette
Henry Hermann Hugo Ida Ilse Jakob James Jane Jean Jeanne Johann Johanna John Jorinde Josef Josephine Juliane Julie
Julius Karl Kaspar Katharina Klara Konrad Leopold Louis Louise Lucan Ludwig Luise Malwine Margarethe Maria Marie
Martha Martin Mary Mathilde Maud Max Moritz Nikolaus Odile Oskar Otto Ottilie Paul Pauline Peter Philipp Pierre Rahel
Richard Rike Robert Rosalie Rosa Rowan Rudolf Sarah Sebastian Sophie Susanne Theodor Therese Thomas Tobias Ursula
Valentin Veit Veronika Victor Walburga Walter Wilhelm Wilhelmine William
""".split()
TITLES = r"(?:Frau|Herrn?|Fräulein|Frl\.|Hrn\.|Dr\.|Prof\.|Mrs\.|Mr\.|Miss|Ms\.|Rev\.|Mme|Mlle|M\.|Madame|Monsieur)"
# What personal data is labelled with, and what stands behind it.
BEFORE = {
    "email": r"(?:\b(?:an|oder|or|ou par|to|à|unter|at|mail|e-mail)[ :]*|\n)$",
    "phone": r"(?:\b(?:Tel(?:efon)?\.?|[Pp]hone|[Tt]él\.?|[Tt]éléphone|[Rr]uf(?:e|t)?(?: an)?|[Cc]all|[Aa]ppeler?z?(?: le)?|unter|at|au|Fon|Mobil|oder|or)[ :]*|\n)$",
    "id_number": r"\b(?:Ausweis\w*|(?:Reise)?[Pp]ass(?:port)?|[Pp]asseport|Steuer\w*|[Tt]ax|[Ii]nsurance|\w*[Vv]ersicherung\w*|[Ss]écurité|[Ii]dentité|[Ii]dentity|[Ss]ocial)\b[^\d\n;,]{0,24}$",
    "street_address": r"(?:\b(?:Anschrift|[Aa]dresse?|in der|im|at|[Ll]ives at|[Dd]omicile|au|à|[Ww]ohnt)[ :]*|,\s+|\n)$",
}
BEHIND = {
    "email": r"^(?:[.,;)]?(?:\s|$))",
    "phone": r"^(?:\s*\)|[.,;]?(?:\s|$))",
    "id_number": r"^(?:[.,;)]?(?:\s|$))",
    "street_address": r"^(?:,? ?\d{4,5} |, [A-ZÄÖÜ]|[.;)]| oder| or | ou |\n|$)",
}
AGAINST = re.compile(r"(?:\b(?:ISBN|ISSN|Inv\.-Nr\.|No\.|Nr\.|Sign\.|Bd\.|S\.|pp?\.|vol\.|Anm\.|Aufl\.|Kat\.|Opus|op\.)|\(\d{4}\)|£|§)\s*$")
AFTER_AGAINST = re.compile(r"^(?:, folio| Mark| francs| fl\.| Seiten| v\. H\.| per cent|, \d\. Aufl)")

_upper = "A-ZÄÖÜÉÈÀÂÊÎÔÛÇ"
_cap = rf"[{_upper}][\w’']*[\w](?:-[{_upper}][\w’']+)*"
_between = rf"(?: [{_upper}]\.)*(?: (?:von der|von|van|vom|zu|de|du|VON))?"
EMAIL = re.compile(r"[\w+-]+(?:\.[\w+-]+)*(?:@| @ | ?\(at\) ?| ?\[at\] ?| AT )[\w-]+(?:(?:\.| DOT | ?\(dot\) ?| ?\[dot\] ?)[\w-]+)+")
EMAIL_MARK = re.compile(r"@|\(at\)|\[at\]| AT [\w-]+ DOT ")
NUMBERS = {
    "phone": re.compile(
        r"(?<![\w+/.,-])(?<!\d )(?:\+\d{1,3}(?:[ ./-]?\(?\d{1,5}\)?)(?:[ ./-]?\d{2,8}){1,6}|00\d{2}(?:[/-]\d{2,9}){2,3}|0\d{2,4}(?:[ ./-]\d{2,8}){1,4}|0\d(?:[ .]\d{2}){4}"
        r"|\(\d{2,5}\) ?\d{3,9}(?:[ -]\d{2,5})?|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4})(?![\w/]|[.,-]\d)"
    ),
    "id_number": re.compile(
        r"(?<![\w+/.,-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|\d{2} ?\d{6} ?[A-Z] ?\d{3}|\d \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|\d{2} \d{3} \d{3} \d{3}|\d{3}-\d{2}-\d{4})(?![\w/]|[.,-]\d)"
    ),
}
LABELLED_ID = re.compile(BEFORE["id_number"][:-1] + r"?(?<!\w)(?P<v>[A-Z0-9](?:[A-Z0-9./-]| (?=[A-Z0-9./-]*\d|[A-Z](?![\w])))*[A-Z0-9])")
_street_de = rf"(?:[{_upper}][\w-]*(?:[Ss]tr\.|[Ss]traße|[Ss]trasse|[Gg]asse|[Ww]eg|[Pp]latz|[Aa]llee|[Uu]fer|[Dd]amm|[Gg]raben|[Mm]arkt)|(?:Am|An der|Im|Auf dem|Auf der|Zum|Zur|Unter den) (?:[{_upper}][\wäöüß-]+ )?[{_upper}][\wäöüß-]+)"
STREET = re.compile(
    rf"(?<![\w-])(?:{_street_de} \d{{1,4}} ?(?:[a-z](?![\w]))?(?![\w.,]*\d)"
    rf"|\d{{1,4}}[a-z]?(?: bis| ter)?,? (?:rue|avenue|boulevard|quai|chemin|impasse|place|allée)(?: (?:des|de la|de l'|du|de|d'))? ?[{_upper}][\w'’-]+"
    rf"|\d{{1,4}}[a-z]? (?:[{_upper}][\w'’-]+ ){{1,3}}(?:Road|Lane|Street|St\.|Avenue|Ave\.|Square|Terrace|Row|Hill|Court|Place|Close|Way|Rd\.))"
)
PAIR = re.compile(rf"(?<![\w@.-])(?=({_cap})({_between}) ({_cap})(?![\w@])){_cap}")
INVERTED = re.compile(rf"(?<![\w@.-])(?=({_cap}), ({_cap})(?: [{_upper}]\.)*(?: von(?= ?[\n(,.]))?(?![\w@])){_cap}")
_whole_inverted = re.compile(rf"{_cap}, {_cap}(?: [{_upper}]\.)*(?: von(?= ?[\n(,.]))?(?![\w@])")
TITLE = re.compile(rf"^{TITLES}$")
_title_before = re.compile(rf"{TITLES}\s+$")
_plain_word = re.compile(r"[^\w@]*([^\W\d_]+)[^\w@]*$")
_digit_run = re.compile(r"\d")
_before = {t: re.compile(p) for t, p in BEFORE.items()}
_behind = {t: re.compile(p) for t, p in BEHIND.items()}
_listed = {*GIVEN, *map(str.upper, GIVEN)}
#: A word is written small if so large a share of its occurrences is; a given name precedes at least so many different words,
#: and these are so large a share of all it precedes; a phrase is two words that stand together this often.
SMALL, DIFFERENT, DIFFERENT_SHARE, PHRASE = 0.2, 3, 0.2, 8


def _shape(s: str) -> str:
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m.group() != m.group().lower() else "a", s)
    s = re.sub(r"\d", "9", s)
    return re.sub(r"([Aa])\1+", r"\1+", s)


def _near(pre: str, post: str) -> list[str]:
    before, after = [w.lower() for w in re.findall(r"\w+|[^\w\s]", pre)[-2:]], [w.lower() for w in re.findall(r"\w+|[^\w\s]", post)[:1]]
    return [f"b={' '.join(before)}", f"b1={' '.join(before[-1:])}", f"a={' '.join(after)}"]


def spans(text: str) -> list[tuple[int, int, str, tuple[int, ...], list[str], str, str]]:
    """Candidate spans of a text: (start, end, type, votes, features, given name, surname). A vote is 1 for, -1 against, 0 none.
    Of numbers and addresses the labelers are: pattern of the type, words before, words behind, number of digits, labels
    against. Of names: list of given names, title before, capitals in the usual way, and two that the corpus gives."""
    found: list[tuple[int, int, str, int]] = []
    masked = text
    if EMAIL_MARK.search(text):
        for m in EMAIL.finditer(text):
            found.append((m.start(), m.end(), "email", 1 if re.search(r"[^\W\d_]", m.group().split("@")[-1]) else -1))
            masked = masked[: m.start()] + "\x00" * (m.end() - m.start()) + masked[m.end() :]
    if _digit_run.search(masked):
        for kind, p in NUMBERS.items():
            found += [(m.start(), m.end(), kind, 1) for m in p.finditer(masked)]
        known = [(a, b) for a, b, k, _ in found if k == "id_number"]
        for m in LABELLED_ID.finditer(masked):
            if not any(a < m.end("v") and m.start("v") < b for a, b in known) and sum(c.isdigit() for c in m["v"]) >= 4:
                found.append((*m.span("v"), "id_number", 0))
        found += [(m.start(), m.end() - (m.group()[-1] == " "), "street_address", 1) for m in STREET.finditer(masked)]
    streets = [(a, b) for a, b, k, _ in found if k == "street_address"]
    out = []
    for a, b, kind, pattern in found:
        piece, pre, post = text[a:b], text[max(0, a - 48) : a], text[b : b + 16]
        digits = sum(c.isdigit() for c in piece)
        listed = 0
        if kind == "phone":
            listed = 1 if 8 <= digits <= 15 else -1
        before = 1 if _before[kind].search(pre) or not pre or (kind == "phone" and pre.endswith("(")) else 0
        behind = 1 if _behind[kind].search(post) else 0
        against = -1 if AGAINST.search(pre) or AFTER_AGAINST.search(post) else 0
        out.append((a, b, kind, (pattern, before, behind, listed, against), [f"s={_shape(piece)}", f"m={re.sub('[a-z+]+', 'x', _shape(piece))}", *_near(pre, post), "1"], "", ""))
    names = [(m.start(), m.end(3), m[1], m[3], "d") for m in PAIR.finditer(masked)]
    begun = {a for a, *_ in names}
    for m in INVERTED.finditer(masked):
        if m.start(2) not in begun and (w := _whole_inverted.match(masked, m.start())):  # else the name begins behind the comma
            names.append((m.start(), w.end(), m[2], m[1], "i"))
    for a, b, given, surname, order in names:
        if TITLE.match(given) or TITLE.match(surname) or f"{surname}." in text[a : b + 1] and TITLE.match(f"{surname}.") or any(x < b and a < y for x, y in streets) or any(c.isdigit() for c in surname + given):
            continue
        if order == "i" and surname in _listed:
            continue
        pre, post = text[max(0, a - 48) : a], text[b : b + 16]
        listed = 1 if all(w in _listed for w in given.split("-")) else 0
        usual = -1 if given.isupper() and surname.isupper() else 0
        votes = (listed, 1 if _title_before.search(pre) else 0, usual)
        out.append((a, b, "name", votes, [f"o={order}", f"s={_shape(text[a:b])}", *_near(pre, post), "1"], given.lower(), surname.lower()))
    return out


def _candidates(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(spans, words written small with their numbers) of documents (k, t), in one pass."""
    kind = dict(docs.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: Counter = Counter()

        def rows_of(keys, rows):
            return pa.RecordBatch.from_arrays(
                [
                    keys, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string()),
                    pa.array([r[5] for r in rows], pa.list_(pa.int32())), pa.array([r[6] for r in rows], pa.list_(pa.string())), pa.array([r[7] for r in rows], pa.string()), pa.array([r[8] for r in rows], pa.string()), pa.array([r[9] for r in rows], pa.int64()),
                ],
                names=[key, "start", "end", "pii_type", "pii_text", "votes", "features", "given", "surname", "small"],
            )

        def flush(keys):
            words: Counter = Counter()
            for piece, n in small.items():
                if piece.islower() and (w := _plain_word.match(piece)):  # no part of an address
                    words[w[1]] += n
            small.clear()
            rows = [(None, None, None, None, None, None, None, w, None, n) for w, n in words.items()]
            return rows_of(pa.nulls(len(rows), keys.type), rows)

        keys = pa.array([], pa.int64())
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            rows = []
            for n, t in enumerate(texts):
                small.update(t.split())
                rows += [(n, a, b, k, t[a:b], v, f, g, u, None) for a, b, k, v, f, g, u in spans(t)]
            yield rows_of(keys.take(pa.array([r[0] for r in rows], pa.int64())), rows)
            if len(small) > 1_000_000:
                yield flush(keys)
        if small:
            yield flush(keys)

    schema = f"`{key}` {kind}, start int, end int, pii_type string, pii_text string, votes array<int>, features array<string>, given string, surname string, small bigint"
    both = materialize(docs.mapInArrow(run, schema), "pii-spans")
    return both.where("small is null").drop("small"), both.where("small is not null").groupBy(F.col("given").alias("word")).agg(F.sum("small").alias("small"))


def _voted(candidates: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end, pii_type, pii_text, votes, features) with all votes. Names whose first word is written small, for
    which no labeler can be, are dropped when they have been counted."""
    names, others = candidates.where("pii_type = 'name'"), candidates.where("pii_type <> 'name'")
    direct = F.array_contains("features", "o=d")
    words = names.groupBy(F.col("given").alias("word")).agg(F.count(F.lit(1)).alias("x")).unionByName(names.groupBy(F.col("surname").alias("word")).agg(F.count(F.lit(1)).alias("x")))
    words = words.groupBy("word").agg(F.sum("x").alias("x")).join(small, "word", "left").na.fill(0)
    is_small = (F.col("small") >= SMALL * (F.col("small") + F.col("x"))).alias("is_small")
    shares = materialize(words.select("word", is_small, (F.col("small") / (F.col("small") + F.col("x"))).alias("share")), "pii-small")
    told = materialize(salted_join(names, shares.select(F.col("word").alias("given"), "is_small"), "given", "start"), "pii-names")
    pairs = told.groupBy("given", "surname", direct.alias("direct"), "is_small").agg(F.count(F.lit(1)).alias("n"))
    first = pairs.where("direct and not is_small").groupBy(F.col("given").alias("word")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"))
    after = pairs.where("direct").groupBy(F.col("surname").alias("word")).agg(F.sum("n").alias("as_second"), F.sum(F.when(F.col("is_small"), F.col("n")).otherwise(0)).alias("after_small"))
    rated = shares.join(first, "word", "left").join(after, "word", "left").na.fill(0)
    noun = (F.col("after_small") >= DIFFERENT) & (F.col("after_small") >= F.col("n"))
    like = (F.col("different") >= DIFFERENT) & (F.col("different") >= DIFFERENT_SHARE * F.col("n"))
    rated = materialize(rated.select("word", F.when(noun, -1).when(like, 1).otherwise(0).alias("given_vote"), (noun | (F.col("share") >= 0.5)).alias("noun"), "share"), "pii-words")
    of_first = rated.select(F.col("word").alias("given"), "given_vote")
    of_second = rated.select(F.col("word").alias("surname"), F.col("given_vote").alias("second_given"), "noun", F.col("share").alias("second_share"))
    often = pairs.groupBy("given", "surname").agg((F.sum("n") >= PHRASE).alias("often"))
    # a pair with a word that is mostly written small is no name, nor are two given names with a comma between them
    joined = salted_join(salted_join(told.where("not is_small"), of_first, "given", "start"), of_second.where("second_share < 0.5"), "surname", "start").join(often, ["given", "surname"])
    joined = joined.where(direct | (F.col("second_given") < 1))
    given = F.when(~direct & (F.col("given_vote") < 1), F.when(F.col("votes")[0] == 1, 0).otherwise(-1)).otherwise(F.col("given_vote"))
    surname = F.when(F.col("noun") | ((F.col("second_given") == 1) & (~direct | (F.col("given_vote") < 1))), -1).when(F.col("second_share") < SMALL, 1).otherwise(0)
    voted = joined.withColumn("votes", F.concat("votes", F.array(given.cast("int"), surname.cast("int"), F.when(F.col("often") & (F.col("votes")[0] == 0), -1).otherwise(0))))
    columns = [key, "start", "end", "pii_type", "pii_text", "votes", "features"]
    return others.select(*columns).unionByName(voted.select(*columns))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability of a true case by vote pattern, by expectation-maximisation over pattern counts. Labelers are taken as
    independent given the truth. The start is a vote count, so that the labelers' majority names the classes; patterns with a
    clear majority stay on their side of the line, so that the classes aren't exchanged where most spans are no cases."""
    votes = np.array([p for p, _ in patterns], int)
    n = np.array([c for _, c in patterns], float)
    q = np.clip(0.5 + 0.2 * (votes.sum(axis=1) - 1.5), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((q * n).sum() / n.sum(), 0.02, 0.98)
        like = np.tile(np.log([1 - prior, prior]), (len(n), 1))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                for y, w in enumerate(((1 - q) * n, q * n)):
                    toward = 3.0 if (v == 1) == (y == 1) else 1.0
                    like[at, y] += np.log((w[at].sum() + toward) / (w.sum() + 5.0))
        q = 1 / (1 + np.exp(like[:, 0] - like[:, 1]))
        q = np.where(votes.sum(axis=1) >= 3, np.maximum(q, 0.9), np.where(votes.sum(axis=1) < 0, np.minimum(q, 0.1), q))
    return {p: float(x) for (p, _), x in zip(patterns, q)}


def _hashed(kind: str, votes: list[int], features: list[str]) -> list[int]:
    words = [*(f"v{i}={v}" for i, v in enumerate(votes)), *features]
    if kind == "name":  # the list says nothing of names that aren't on it: what it teaches comes through the probabilities
        words = [w for w in words if w != "v0=0" and w != "v0=1"]
    return [xxhash.xxh32_intdigest(f"{kind}|{w}") % WIDTH for w in words]


def fit(candidates: DataFrame) -> np.ndarray:
    """Weights of the span classifier over WIDTH hashed features."""
    counts = candidates.groupBy("pii_type", "votes").count().collect()  # 3 ** 5 patterns of five types at most
    truth = {}
    for t in TYPES:
        own = sorted((tuple(r.votes), r["count"]) for r in counts if r.pii_type == t)
        truth |= {(t, p): x for p, x in reliabilities(own).items()} if own else {}
    total = sum(r["count"] for r in counts)
    chosen = candidates if total <= SAMPLE else candidates.where(F.pmod(F.xxhash64(*candidates.columns), F.lit(1 << 20)) < int((1 << 20) * 0.95 * SAMPLE / total))
    rows = chosen.groupBy("pii_type", "votes", "features").count().limit(SAMPLE).collect()
    w = np.zeros(WIDTH)
    if not rows:
        return w
    coded = [_hashed(r.pii_type, r.votes, r.features) for r in sorted(rows, key=lambda r: (r.pii_type, r.votes, r.features))]
    rows = sorted(rows, key=lambda r: (r.pii_type, r.votes, r.features))
    x = np.array([[*c, *[c[-1]] * (WORDS - len(c))] for c in coded])
    y = np.array([truth[r.pii_type, tuple(r.votes)] for r in rows])
    n = np.array([r["count"] for r in rows], float)
    grad2 = np.full(WIDTH, 1e-6)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat((p - y) * n, WORDS), WIDTH) + 1e-3 * w
        grad2 += g * g
        w -= 0.5 * g / np.sqrt(grad2)
    return w


def _kept(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, pii_type, pii_text, score) of the spans that the classifier takes, the likeliest of those with one start."""
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t <> ''")
    candidates = materialize(_voted(*_candidates(docs, key), key), "pii")
    shared = documents.sparkSession.sparkContext.broadcast(fit(candidates))
    names = [key, "start", "end", "pii_type", "pii_text", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = np.array([w[(c := _hashed(k, v, f))].sum() + (WORDS - len(c)) * w[c[-1]] for k, v, f in zip(*(batch.column(i).to_pylist() for i in (3, 5, 6)))])
            keep = pa.array(scores > 0, pa.bool_()) if len(scores) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(scores, pa.float64())], names=names).filter(keep)

    kept = candidates.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.select(*names[:5]).schema) + ", score double")
    return kept.groupBy(key, "start").agg(F.max_by(F.struct("end", "pii_type", "pii_text", "score"), F.struct("score", "end", "pii_type")).alias("s")).select(key, "start", "s.*")


def apart(found: list[tuple[int, int, float]]) -> list[int]:
    """Places of the spans (start, end, score) that are left of overlapping ones, the likeliest first."""
    out: list[int] = []
    for i in sorted(range(len(found)), key=lambda i: (-found[i][2], found[i][0], -found[i][1])):
        if all(found[i][1] <= found[j][0] or found[j][1] <= found[i][0] for j in out):
            out.append(i)
    return sorted(out, key=lambda i: found[i][0])


def _by_document(kept: DataFrame, key: str) -> DataFrame:
    return kept.groupBy(key).agg(F.collect_list(F.struct("start", "end", "score", "pii_type", "pii_text")).alias("found"))  # a document's own spans


def personal_data(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pii_type, pii_text) of each different piece of personal data of a document."""
    kept = _kept(documents, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rows = [], []
            for i, found in enumerate(batch.column(1).to_pylist()):
                own = [(f["start"], f["end"], f["score"]) for f in found]
                picked = sorted({(found[k]["pii_type"], found[k]["pii_text"]) for k in apart(own)})
                where += [i] * len(picked)
                rows += picked
            cols = list(zip(*rows)) or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, pa.string()) for c in cols)], names=[key, "pii_type", "pii_text"])

    return _by_document(kept, key).mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, pii_type string, pii_text string")


def masked(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with each piece of personal data replaced by the placeholder of its type. Null stays null: one row per input
    row. The spans found are joined with the texts; rows of one key with different texts are told apart by their text."""
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("row", F.struct(F.col("k").alias("k"), F.xxhash64("t").alias("h")))
    found = _by_document(_kept(docs.where("k is not null"), "row", "t"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                texts.append(t if t is None or not own else mask(t, [(f["start"], f["end"], f["score"], f["pii_type"]) for f in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, text])

    return docs.join(found, "row", "left").select("k", "t", "found").mapInArrow(run, f"`{key}` {dict(docs.dtypes)['k']}, `{text}` string")


def mask(text: str, found: list[tuple[int, int, float, str]]) -> str:
    """One text with placeholders for the spans (start, end, score, type) found in it."""
    out, at = [], 0
    for k in apart([f[:3] for f in found]):
        a, b, _, kind = found[k]
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]
