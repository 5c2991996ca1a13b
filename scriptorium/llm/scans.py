"""Noise in text from scanned pages (problem 7).

Method: a hidden Markov model labels each line as furniture (running header, page number), body or break, from layout
features; Viterbi decoding yields the labels, and paragraphs are put together from the body lines. The model starts from
rules and is re-estimated by expectation-maximisation on at most SAMPLE_TEXTS texts; word counts, which decide on broken
and misread words, cover all texts.

A word is misread if it is neither known nor made of two known words and an exchange of characters that print confuses makes
it so. Of the known words of all languages the KNOWN_WORDS commonest are sent to the executors; if there are more, the other
words of each text are judged once each by a join with the rest, and each text gets the judgements of its own words. Both
ways give the same result.

Results for special inputs: null and empty texts have no lines; lines are counted from 1 and split at line feeds, a
carriage return belongs to no line; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.sentences import language
from scriptorium.session import materialize

SAMPLE_TEXTS, ROUNDS = 400, 4
KNOWN_WORDS, KNOWN_FROM = 400_000, 2
#: Longest word that is counted: longer runs of letters are no words.
LONGEST = 64
FURNITURE, BODY, BREAK = 0, 1, 2
FEATURES = (9, 4, 3, 3, 2, 2, 3)

# What print shows, and what it may stand for. From public descriptions of scanned print.
CONFUSED = {
    "c": ["e", "o"], "e": ["c", "o"], "o": ["c", "e"], "l": ["t", "i", "f", "1"], "t": ["l", "f", "r"], "j": ["i"], "i": ["j", "l", "t"], "b": ["h", "l"], "h": ["b", "li"], "1": ["l", "i"], "u": ["n", "ii"],
    "n": ["u", "ri"], "f": ["s", "t"], "s": ["f"], "0": ["o"], "6": ["b", "G"], "5": ["s"], "8": ["B"], "9": ["g"], "m": ["rn", "in", "nn"], "rn": ["m"], "ii": ["u", "n"], "cl": ["d"], "d": ["cl"], "vv": ["w"], "w": ["vv"],
    "ri": ["n"], "li": ["h"], "in": ["m"], "nn": ["m"], "v": ["y"], "y": ["v"], "g": ["q"], "q": ["g"], "a": ["o"], "r": ["t"],
    "F": ["E"], "E": ["F"], "I": ["l", "T", "J"], "G": ["C"], "C": ["G"], "O": ["Q", "D"], "B": ["H", "R"], "R": ["B"], "H": ["B"], "D": ["O"], "J": ["I"], "T": ["I"], "L": ["I"], "S": ["5"], "U": ["N"], "N": ["U"],
}
JOINERS = {"und", "oder", "bis", "sowie", "or", "and", "to", "ou", "et", "bzw"}
HYPHENS = "-¬‐⸗=­"
_roman = re.compile(r"^[ivxlcdm]{1,9}$|^[IVXLCDM]{2,9}$")
_page = re.compile(r"^[\[(\s—–·*.-]*[\dlIOoS]{1,4}[\])\s—–·*-]*$")
_edge_number = re.compile(r"^[\W_]{0,3}[\dlIOo]{1,4}[\W_]{0,3}(?=\s)|(?<=\s)[\W_]{0,3}[\dlIOo]{1,4}[\W_]{0,3}$")
_word = re.compile(r"[^\W_]+")
_end_mark = re.compile(r"[.!?…:;,。！？।][\"'”“»«’)\]]*$|[”»“]$")
_ENDS, _CLOSES = frozenset(".,;:!?…"), frozenset(".!?…:;,。！？।\"'”’“»«)]")
_heading = re.compile(r"^(?:Kapitel|Chapter|Chapitre|Part|Partie|Teil|Theil|Buch|Book|Livre|Abschnitt|Act|Acte|Scene|Section|Tome|Band)\b.{0,20}$|^\w+(?:tes|ter|te) (?:Kapitel|Buch|Abschnitt|Teil|Theil|Band)$", re.I)
_fold = str.maketrans("clt1ij|nusfhb60", "ellllllnnssbbbo")
_last_word = re.compile(rf"([^\W_][^\W_'’]*(?:[-][^\W_]+)*)[{HYPHENS}]\s*$")
_first_word = re.compile(r"^\s*([^\W\d_]+)")


def _folded(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"[\W_]", "", s.replace("F", "E").lower()).translate(_fold)


def _like(a: str, b: str) -> bool:
    return bool(a and b) and 3 * min(len(a), len(b)) >= 2 * max(len(a), len(b)) and (a == b or SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.8)


def title_of(src_table: str, name: str | None, journal: str | None) -> str:
    """What a running header may repeat: the book's title or the journal, folded."""
    parts = (name or "").split("_")
    return _folded((journal or (parts[2] if len(parts) > 2 else "")) if src_table == "reviews" else (parts[2] if len(parts) > 2 else ""))


def _header_text(s: str) -> str:
    words = s.split()
    if len(words) > 1 and _roman.match(words[0].strip("[]()—–-.")):
        words = words[1:]
    elif len(words) > 1 and _roman.match(words[-1].strip("[]()—–-.")):
        words = words[:-1]
    return _edge_number.sub("", " ".join(words)).strip(" —–-[]().·*")


def line_features(lines: list[str], title: str) -> list[tuple[int, ...] | None]:
    """Categories of each line, null for blank ones: shape, length, end, repetition in the text, whether it stands in the
    midst of a sentence, whether it repeats the title, and how many of its words have capitals."""
    stripped = [x.strip() for x in lines]
    filled = [i for i, s in enumerate(stripped) if s]
    sizes = sorted(len(stripped[i]) for i in filled)
    width = sizes[4 * (len(sizes) - 1) // 5] if sizes else 1
    heads = {}
    for i in filled:
        s = stripped[i]
        if len(s) <= 64 and s[-1] not in _ENDS and (not s[0].islower() or s[0] in "ivxlcdmo" and ((first := s.split(None, 1)[0]).isalpha() is False or _roman.match(first))) and not _end_mark.search(s):
            if len(s) < 0.85 * width or len(s) < 1.7 * len(title) + 12 or s[0].isdigit() or s[-1].isdigit():
                heads[i] = _folded(_header_text(s))
    seen = Counter(h for h in heads.values() if len(h) > 2)
    out: list[tuple[int, ...] | None] = [None] * len(lines)
    for k, i in enumerate(filled):
        s = stripped[i]
        head = heads.get(i)
        ratio = len(s) / max(width, 1)
        length = 0 if ratio < 0.35 else 1 if ratio < 0.65 else 2 if ratio < 0.9 else 3
        end = 1 if s[-1] in _CLOSES else 2 if s[-1] in HYPHENS else 0
        if head is None:  # no line of a header's form
            out[i] = (7 if end == 2 else 8, length, end, 0, 0, 0, 0)
            continue
        words = s.split()
        if _page.match(s) and any(c.isdigit() or c in "lIOoS" for c in s):
            shape = 0
        elif len(words) == 1 and _roman.match(s.strip("[]()—–-.")) and len(s) > 1:
            shape = 1
        elif _heading.match(s) or (not _like(head or "", title) and (not head or seen[head] < 2) and not _edge_number.search(s) and _alone(stripped, i) and head is not None):
            shape = 2
        elif not (s[0].isupper() or len(words) > 1 and words[1][0].isupper()):  # a header's text has a capital
            shape = 7 if s[-1] in HYPHENS else 8
        elif head is not None and _edge_number.search(s):
            shape = 3
        elif head is not None and len(words) > 1 and (_roman.match(words[0].strip("[]().")) and words[1][:1].isupper() or (_roman.match(words[-1].strip("[]().")) and words[0][:1].isupper())):
            shape = 4
        elif head is not None and s.upper() == s and any(c.isalpha() for c in s):
            shape = 5
        elif head is not None and len(s) < 0.7 * width:
            shape = 6
        elif s[-1] in HYPHENS:
            shape = 7
        else:
            shape = 8
        times = seen[head] if head else 0
        repeat = 0 if times < 2 else 1 if times < 4 else 2
        before = stripped[filled[k - 1]] if k else ""
        after = stripped[filled[k + 1]] if k + 1 < len(filled) else ""
        cuts = int(bool(before) and not re.search(r"[.!?…][\"'”“»«’)\]]*$", before) and bool(after) and (after[0].islower() or before[-1] in HYPHENS))
        titled = int(head is not None and _like(head, title))
        letters = [w for w in words if w[0].isalpha()]
        capital = sum(w[0].isupper() for w in letters) / len(letters) if letters else 1.0
        if shape == 6 and not titled and not cuts:
            shape = 2
        if shape in (3, 4) and length >= 2 and not titled and times < 2:
            shape = 8  # a line of text that begins or ends with a number
        out[i] = (shape, length, end, repeat, cuts, titled, 0 if capital < 0.5 else 1 if capital < 1 else 2)
    return out


def _alone(stripped: list[str], i: int) -> bool:
    """Whether a line is a paragraph of its own that interrupts no sentence."""
    if i and stripped[i - 1] or i + 1 < len(stripped) and stripped[i + 1]:
        return False
    before = next((x for x in reversed(stripped[:i]) if x), "")
    return not before or bool(_end_mark.search(before)) and before[-1] not in ",;:"


def _by_rule(f: tuple[int, ...] | None) -> int:
    if f is None:
        return BREAK
    shape, length, end, repeat, cuts, titled, capital = f
    if shape in (0, 1) or (titled and shape != 2) or (shape in (3, 4) and end == 0 and capital and (repeat or cuts)):
        return FURNITURE
    return BODY


class LineModel:
    """Hidden Markov model whose states emit the line features independently of one another; breaks are seen as such."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start, self.step, self.emit = start, step, emit

    @staticmethod
    def _estimate(texts: list[list], weights: list[np.ndarray], steps: np.ndarray, starts: np.ndarray) -> "LineModel":
        emit = [np.full((3, n), 0.5) for n in FEATURES]
        for lines, w in zip(texts, weights):
            for f, row in zip(lines, w):
                if f is not None:
                    for e, v in zip(emit, f):
                        e[:, v] += row
        emit[0][FURNITURE, 2] = 0.0  # headings are body text
        return LineModel((starts + 1) / (starts.sum() + 3), (steps + 1) / (steps.sum(axis=1, keepdims=True) + 3), [e / e.sum(axis=1, keepdims=True) for e in emit])

    def _likelihood(self, lines: list) -> np.ndarray:
        out = np.zeros((len(lines), 3))
        at = [i for i, f in enumerate(lines) if f is not None]
        out[:, BREAK] = 1
        if at:
            codes = np.array([lines[i] for i in at])
            p = np.ones((len(at), 3))
            for j, e in enumerate(self.emit):
                p *= e.T[codes[:, j]]
            p[:, BREAK] = 0
            out[at] = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        return out

    @classmethod
    def fit(cls, texts: list[list]) -> "LineModel":
        hard = [np.eye(3)[[_by_rule(f) for f in lines]] for lines in texts]
        steps, starts = np.zeros((3, 3)), np.zeros(3)
        for w in hard:
            starts += w[0]
            steps += w[:-1].T @ w[1:]
        model = cls._estimate(texts, hard, steps, starts)
        for _ in range(ROUNDS):
            weights, steps, starts = [], np.zeros((3, 3)), np.zeros(3)
            for lines, rule in zip(texts, hard):
                b = model._likelihood(lines)
                n = len(lines)
                a, z = np.zeros((n, 3)), np.ones((n, 3))
                for i in range(n):
                    a[i] = b[i] * (model.start if i == 0 else a[i - 1] @ model.step)
                    a[i] /= max(a[i].sum(), 1e-300)
                for i in range(n - 2, -1, -1):
                    z[i] = model.step @ (b[i + 1] * z[i + 1])
                    z[i] /= max(z[i].sum(), 1e-300)
                g = a * z
                g /= np.maximum(g.sum(axis=1, keepdims=True), 1e-300)
                g = (g + rule) / 2  # the rules stay a labeler, so that the states keep their meaning
                weights.append(g)
                starts += g[0]
                for i in range(n - 1):
                    x = np.outer(a[i], b[i + 1] * z[i + 1]) * model.step
                    steps += x / max(x.sum(), 1e-300)
            model = cls._estimate(texts, weights, steps, starts)
        return model

    def label(self, lines: list) -> list[int]:
        """The likeliest states."""
        if not lines:
            return []
        with np.errstate(divide="ignore"):
            b, step = np.log(self._likelihood(lines)), np.log(self.step).tolist()
            v = (np.log(self.start) + b[0]).tolist()
        back = []
        for row in b[1:].tolist():
            frm = [max(range(3), key=lambda s: v[s] + step[s][t]) for t in range(3)]
            v = [v[frm[t]] + step[frm[t]][t] + row[t] for t in range(3)]
            back.append(frm)
        out = [max(range(3), key=lambda s: v[s])]
        for frm in reversed(back):
            out.append(frm[out[-1]])
        return out[::-1]


def _exchanges(w: str) -> Iterator[tuple[int, str]]:
    """(place, word) with one exchange of characters that print confuses."""
    for i in range(len(w)):
        for size in (1, 2):
            for new in CONFUSED.get(w[i : i + size], ()) if i + size <= len(w) else ():
                yield i, w[:i] + new + w[i + size :]


def _of_digits(w: str) -> Iterator[str]:
    """Words with one digit exchanged for what print confuses it with."""
    for j, c in enumerate(w):
        for new in CONFUSED.get(c, ()) if c.isdigit() else ():
            yield w[:j] + new + w[j + 1 :]


def _cases(v: str) -> tuple[str, str, str]:
    return v, v[0].lower() + v[1:], v[0].upper() + v[1:]


def _halves(low: str) -> list[tuple[str, str]]:
    return [(low[:i], low[i:]) for i in range(3, len(low) - 2)]


class Words:
    """The known words of one language."""

    def __init__(self, words: list[str], low: list[str] = ()):
        self.known = set(words)
        self.low = {*(w.lower() for w in words), *low}
        self._bad: dict[str, tuple[int, str] | None] = {}

    def good(self, w: str) -> bool:
        low = w.lower()
        return w in self.known or low in self.low or any(a in self.low and b in self.low for a, b in _halves(low))

    def misread(self, w: str) -> tuple[int, str] | None:
        """(place, what it should be) if a word has a misrecognised character, else null."""
        if w in self.known or len(w) > LONGEST:
            return None
        if w in self._bad:
            return self._bad[w]
        out = None
        if any(c.isdigit() for c in w):
            letters = sum(c.isalpha() for c in w)
            if letters and re.fullmatch(r"[\dlIO]{2,6}", w):  # a number with letters for digits
                out = (next(i for i, c in enumerate(w) if c.isalpha()), re.sub("[lI]", "1", w.replace("O", "0")))
            elif letters >= 2 and not re.fullmatch(r"\d+(?:st|nd|rd|th|er|re|e|me|ème|te|ten|ter)?[a-z]?", w):
                out = self._repair(w)
        elif len(w) > 1 and not self.good(w):
            out = self._repair(w)
        if len(self._bad) < 500_000:
            self._bad[w] = out
        return out

    def _repair(self, w: str) -> tuple[int, str] | None:
        found = list(_exchanges(w))
        for i, v in found:
            if len(v) > 1 and not any(c.isdigit() for c in v) and any(x in self.known for x in _cases(v)):
                return i, v
        if len(w) >= 6:
            for i, v in found:
                if not any(c.isdigit() for c in v) and self.good(v):
                    return i, v
            if any(c.isdigit() for c in w):  # a second exchange, which words with digits need most
                for i, v in found:
                    for u in _of_digits(v):
                        if self.good(u):
                            return i, u
        return None

    def breaks(self, first: str, second: str) -> bool:
        """Whether two parts with a hyphen between them are one broken word, rather than a word spelt with a hyphen."""
        head = re.split("-", first)[-1]
        joined = head + second
        if joined in self.known or joined.lower() in self.low:
            return True
        if f"{first}-{second}" in self.known:
            return False
        a, b = head.lower() in self.low, second in self.low
        return self.good(joined) or self.misread(joined) is not None or not (a and b and len(head) > 2 and len(second) > 2)


class ToldWords(Words):
    """The commonest words of a language, and the judgements of all other words of a text."""

    def __init__(self, common: Words, told: list[dict]):
        self.known, self.low = common.known, common.low
        self.bad = {t["a"]: (t["place"], t["right"]) for t in told if t["b"] == ""}
        self.broken = {(t["a"], t["b"]) for t in told if t["b"] != ""}

    def misread(self, w: str) -> tuple[int, str] | None:
        return None if w in self.known else self.bad.get(w)

    def breaks(self, first: str, second: str) -> bool:
        return (first, second) in self.broken


def probes(a: str, b: str) -> set[tuple[bool, str]]:
    """All (as written, word) that the judgement of a word, or of a word broken into ``a`` and ``b``, may look up."""

    def good(w: str) -> set[tuple[bool, str]]:
        low = w.lower()
        return {(True, w), (False, low), *((False, h) for pair in _halves(low) for h in pair)}

    def misread(w: str) -> set[tuple[bool, str]]:
        out = good(w)
        for _, v in _exchanges(w):
            if v:
                out |= {(True, x) for x in _cases(v)}
                if len(w) >= 6:
                    out |= good(v)
                    if any(c.isdigit() for c in w):
                        for u in _of_digits(v):
                            out |= good(u)
        return out

    if not b:
        return misread(a)
    head = re.split("-", a)[-1]
    return misread(head + b) | {(True, f"{a}-{b}"), (False, head.lower()), (False, b)}


def _breaks(first: str, second: str, mark: str, words: Words) -> bool:
    """Whether a word is broken between two lines, rather than spelt with a hyphen."""
    if second in JOINERS or not second[:1].islower():
        return False
    return mark != "-" or len(first) + len(second) <= LONGEST and words.breaks(first, second)


def _wrong_words(line: str, words: Words, carried: str, broken: bool) -> list[tuple[int, int, int, str]]:
    """(start, end, place, what it should be) of the misread words of a line. ``carried`` is the part of its first word that
    stands on the line before, to which ``place`` then counts; a last word that is broken is judged with the next line."""
    plain = _word.findall(line)
    if not carried and words.known.issuperset(plain):
        return []
    out = []
    tokens = list(_word.finditer(line))
    for j, t in enumerate(tokens):
        w = carried + t.group() if j == 0 else t.group()
        if w in words.known or broken and j == len(tokens) - 1 or line[t.end() : t.end() + 2] == "- ":
            continue
        wrong = words.misread(w)
        if wrong:
            out.append((t.start(), t.end(), *wrong))
    return out


def _labels(lines: list[str], title: str, model: LineModel) -> list[int]:
    features = line_features(lines, title)
    if any(f is not None and f[0] < 7 for f in features):
        return model.label(features)
    return [BREAK if f is None else BODY for f in features]  # no line has a header's form


def asked_words(text: str, title: str, model: LineModel, known: set[str]) -> set[tuple[str, str]]:
    """What ``examine`` may ask of a text's words that are none of ``known``: (word, nothing) and (part before, part behind) of
    words that may be broken."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    body = [lines[i].strip() for i, s in enumerate(_labels(lines, title, model)) if s == BODY]
    out = set()
    for line, after in zip(body, [*body[1:], ""]):
        out |= {(w, "") for w in _word.findall(line) if w not in known}
        if after and line[-1:] in HYPHENS and (m := _last_word.search(line)) and (n := _first_word.match(after)):
            out.add((m.group(1), n.group(1)))
            first = _word.search(after)
            out.add((m.group(1).split("-")[-1] + (first.group() if first else ""), ""))
    return out


def examine(text: str, title: str, model: LineModel, words: Words, repair: bool = True) -> tuple[list[tuple[int, str]], list[str]]:
    """((line, problem) of a text's lines, its repaired paragraphs if asked for)."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    labels = _labels(lines, title, model)
    body = [i for i, s in enumerate(labels) if s == BODY]
    problems = [(i + 1, "furniture") for i, s in enumerate(labels) if s == FURNITURE]
    paragraphs: list[str] = []
    current: list[str] = []
    carried = ""
    bad: set[int] = set()
    for k, i in enumerate(body):
        line = lines[i].strip()
        follower = body[k + 1] if k + 1 < len(body) else None
        first = ""
        if follower is not None and line[-1:] in HYPHENS:
            m, n = _last_word.search(line), _first_word.match(lines[follower])
            if m and n and _breaks(m.group(1), n.group(1), line[-1], words):
                first = m.group(1)
                problems.append((i + 1, "hyphen"))
        wrong = _wrong_words(line, words, carried, bool(first))
        for start, _, place, _ in wrong:
            # a broken word's character may stand on the line before
            bad.add(body[k - 1] if carried and place < len(carried) and start == 0 else i)
        if repair:
            out, at = [], 0
            for start, end, _, right in wrong:
                out += [line[at:start], right.removeprefix(carried) if carried and start == 0 and right.startswith(carried) else line[start:end] if carried and start == 0 else right]
                at = end
            out.append(line[at:])
            whole = "".join(out)
            current.append(whole.rstrip().rstrip(HYPHENS) if first else whole + " ")
            between = labels[i + 1 : follower] if follower is not None else [BREAK]
            if not first and BREAK in between and (FURNITURE not in between or _end_mark.search(line)):
                paragraphs.append("".join(current).strip())
                current = []
        carried = first.split("-")[-1]
    if current:
        paragraphs.append("".join(current).strip())
    problems += [(i + 1, "misread") for i in sorted(bad)]
    return problems, paragraphs


def known_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n): the commonest words of each language over all texts not recorded as scanned; of all texts, if none
    is. One count in each task, then one aggregation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bool], Counter] = defaultdict(Counter)

        def flush():
            # pieces between blanks were counted; each different one is taken apart once
            words: dict[tuple[str, bool], Counter] = defaultdict(Counter)
            for k, c in total.items():
                for piece, n in c.items():
                    for w in _word.findall(piece):
                        words[k][w] += n
            rows = [(lang, typed, w, n) for (lang, typed), c in words.items() for w, n in c.items()]
            total.clear()
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["lang", "typed", "word", "n"])

        for batch in batches:
            for lang, origin, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total[language(lang, text), origin == "keyed"].update(text.split())
            if sum(map(len, total.values())) > 1_500_000:
                yield from flush()
        yield from flush()

    raw = texts.where("text <> ''").select("lang", "origin", "text").mapInArrow(count, "lang string, typed boolean, word string, n bigint").where(F.char_length("word") <= LONGEST)
    counts = materialize(raw.groupBy("lang", "word").agg(F.sum(F.when(F.col("typed"), F.col("n")).otherwise(0)).alias("typed"), F.sum("n").alias("n")), "word-counts")
    any_typed = counts.groupBy("lang").agg((F.max("typed") > 0).alias("any_typed"))
    score = F.when(F.col("any_typed"), F.col("typed")).otherwise(F.col("n"))
    return counts.join(F.broadcast(any_typed), "lang").select("lang", "word", score.alias("n")).where(F.col("n") >= KNOWN_FROM)  # a row per language code


def _commonest(known: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(the commonest words, at most KNOWN_WORDS, the rest or null): words are told apart by steps of their count."""
    step = F.floor(F.log2("n") * 8).cast("int")
    upto, least = 0, None
    for r in sorted(known.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # 8 * 63 rows at most
        upto += r["count"]
        if upto > KNOWN_WORDS:
            least = r.step + 1
            break
    return (known, None) if least is None else (known.where(step >= least), known.where(step < least))


def _prepared(texts: DataFrame):
    """(rows that have lines, line model and commonest words by language as a broadcast, the rest of the known words or null)."""
    rows = texts.where("text <> '' and item_key is not null").select("src_table", "item_key", "lang", "name", "journal", "text")
    spread = F.xxhash64("src_table", "item_key", "text")
    total = rows.count()
    share = min(1.0, 0.9 * SAMPLE_TEXTS / max(total, 1))
    sample = rows.where(F.pmod(spread, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(spread).limit(SAMPLE_TEXTS).collect()
    coded = [line_features([x.rstrip("\r") for x in r.text.split("\n")], title_of(r.src_table, r.name, r.journal)) for r in sample]
    model = LineModel.fit(coded)
    common, rest = _commonest(materialize(known_words(texts), "known-words"))
    words = defaultdict(list)
    for r in common.select("lang", "word").collect():
        words[r.lang].append(r.word)
    return rows, texts.sparkSession.sparkContext.broadcast((model, dict(words))), rest


def _judged(rows: DataFrame, shared, rest: DataFrame) -> DataFrame:
    """``rows`` with ``told``: the judgements, other than that nothing is wrong, of the words and broken words of each text that
    the commonest words don't decide. Each different one is judged once, by those of its probes that are known."""
    numbered = rows.distinct().select(F.xxhash64("src_table", "item_key", "text", F.coalesce("lang", F.lit("\0")), F.coalesce("name", F.lit("\0")), F.coalesce("journal", F.lit("\0"))).alias("row"), "*")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = shared.value[0], _vocabularies(shared.value[1])
        for batch in batches:
            out: list[tuple] = []
            for row, src, lang, name, journal, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6))):
                lang = language(lang, text)
                out += [(row, lang, a, b) for a, b in asked_words(text, title_of(src, name, journal), model, vocabulary[lang].known) if len(a) + len(b) <= LONGEST]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["row", "lang", "a", "b"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                out = [(i, exact, w) for i, (a, b) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())) for exact, w in probes(a, b)]
                cols = list(zip(*out)) or [[]] * 3
                where = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(where) for k in range(3)), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())], names=["lang", "a", "b", "exact", "word"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabularies(shared.value[1])
        for batch in batches:
            where, places, rights = [], [], []
            for i, (lang, a, b, found) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                words = Words([])
                common = vocabulary[lang]
                hits = probes(a, b)
                words.known = {w for e, w in hits if e and w in common.known} | {f["word"] for f in found or () if f["exact"]}
                words.low = {w for e, w in hits if not e and w in common.low} | {f["word"] for f in found or () if not f["exact"]}
                wrong = ((0, "") if words.breaks(a, b) else None) if b else words.misread(a)
                if wrong:
                    where.append(i)
                    places.append(wrong[0])
                    rights.append(wrong[1])
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(places, pa.int32()), pa.array(rights, pa.string())], names=["lang", "a", "b", "place", "right"])

    asked = materialize(numbered.mapInArrow(ask, "row bigint, lang string, a string, b string"), "asked")
    things = asked.select("lang", "a", "b").distinct()
    have = rest.select("lang", F.lit(True).alias("exact"), "word").unionByName(rest.select("lang", F.lit(False).alias("exact"), F.lower("word").alias("word")).distinct())
    found = things.mapInArrow(probe, "lang string, a string, b string, exact boolean, word string").join(have, ["lang", "exact", "word"])
    found = found.groupBy("lang", "a", "b").agg(F.collect_set(F.struct("exact", "word")).alias("found"))  # a word's probes
    judged = things.join(found, ["lang", "a", "b"], "left").select("lang", "a", "b", "found").mapInArrow(judge, "lang string, a string, b string, place int, right string")
    told = asked.join(judged, ["lang", "a", "b"]).groupBy("row").agg(F.collect_list(F.struct("a", "b", "place", "right")).alias("told"))  # a text's own words
    return numbered.join(told, "row", "left").select("src_table", "item_key", "lang", "name", "journal", "text", "told")


def _over(texts: DataFrame, one, names: list[str], types: list, schema: str) -> DataFrame:
    """The rows that ``one(text, title, model, words)`` gives for all texts, each once."""
    rows, shared, rest = _prepared(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = shared.value[0], _vocabularies(shared.value[1])
        for batch in batches:
            where, found = [], []
            told = batch.column(6).to_pylist() if batch.num_columns > 6 else None
            for i, (src, _, lang, name, journal, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)))):
                words = vocabulary[language(lang, text)]
                own = one(text, title_of(src, name, journal), model, words if told is None else ToldWords(words, told[i] or []))
                where += [i] * len(own)
                found += own
            at, cols = pa.array(where, pa.int64()), list(zip(*found)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols, types))], names=["src_table", "item_key", *names])

    return (rows if rest is None else _judged(rows, shared, rest)).mapInArrow(run, schema).distinct()


def _vocabularies(words: dict[str, list[str]]) -> dict[str, Words]:
    out = defaultdict(lambda: Words([]))
    out.update({k: Words(v) for k, v in words.items()})
    return out


def line_problems(texts: DataFrame) -> DataFrame:
    """(src_table, item_key, line_no, problem) of all texts (src_table, item_key, lang, origin, name, journal, text)."""
    one = lambda *a: examine(*a, repair=False)[0]
    return _over(texts, one, ["line_no", "problem"], [pa.int32(), pa.string()], "src_table string, item_key bigint, line_no int, problem string")


def repaired(texts: DataFrame) -> DataFrame:
    """(src_table, item_key, paragraph_no, paragraph) of all texts, in order from 0."""
    one = lambda *a: list(enumerate(examine(*a)[1]))
    return _over(texts, one, ["paragraph_no", "paragraph"], [pa.int32(), pa.string()], "src_table string, item_key bigint, paragraph_no int, paragraph string")
