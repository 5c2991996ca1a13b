"""Variant spellings of names typed by people (problem 3).

Method: names that differ in case, umlauts or accents only are one node. Nodes become tf-idf vectors over character
n-grams, each gram of one part being taken together with the initial of the other part, so that people who share a surname
share few grams, whatever the order of the parts; initials that are written for one another are one. A distributed sparse
join finds all pairs whose cosine reaches a threshold: of each name's grams, rarest first, only those are joined without
which the threshold can't be reached, so that no pair is lost and no common gram meets itself. The lists of partners end
at the threshold and not at a number n, as a number would lose spellings of names that have more. A comparison of the parts
strikes out pairs whose parts contradict each other, such as two given names. Average-linkage clustering over the cosines
groups the rest. Clusters that are each other's best partner merge in each round, which gives the average-linkage result
without ever holding a cluster in one task.

Results for special inputs: null and empty names take no part; names that differ in nothing but case or umlauts are
alike; a name without second part is all surname; repeated names count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import discard, materialize

#: Least cosine of a pair that is compared, least average cosine of two clusters that merge, and the least likeness of parts
#: that don't contradict each other.
COSINE, LINKAGE, AGREES = 0.3, 0.3, 0.45
GRAM = 3
#: Names with a gram that one task joins with the others of that gram.
BLOCK = 5_000
#: Different grams up to which their numbers of names are sent to the executors; with more, vectors are joined, with the same result.
GRAMS = 1_000_000
#: Decimals of a cosine, so that the order of a sum doesn't count.
DIGITS = 12
#: What rounding may take from a bound, and names whose vectors a task keeps.
SLACK, KNOWN = 1e-9, 50_000
#: Initials that are written for one another.
INITIALS = {"i": "j", "y": "j", "k": "c", "q": "c", "v": "f", "w": "f", "p": "b", "t": "d", "z": "s"}

# Short and pet forms of given names.
SHORT_FORMS = """
adelheid: heidi adel; amalie: malchen amelie; anna: anne annchen; anton: toni; august: gustl gust; benedikt: bene ben;
bernhard: bernd; charlotte: lotte lotti charl; christian: krischan christl; clara: klaerchen klara claire; conrad: konrad kurt;
dorothea: dora doro dorle; eduard: ede edi; elisabeth: else lisbeth liesl elise elsbeth lise betty; emilie: emmi milly;
ferdinand: ferdi fernand; franziska: fanny franzi frz; friedrich: fritz fried; georg: joerg schorsch; gottfried: friedel goetz;
heinrich: heinz hein; henriette: jette henny; hugo: hugi; ida: idchen; johann: hans joh hannes; johanna: hanna; josephine: josefa josefine pepi finchen;
julius: jule; karl: carl kalle; katharina: kaethe cath kathi trine katrin; konrad: kurt kuno; leopold: poldi leo; ludwig: lutz luis; luise: lulu;
margarethe: grete gretchen marg margret; maria: marie mia mizzi; mathilde: tilde thilde hilde; nikolaus: klaus niklas nik; ottilie: tilly otti; otto: ottel;
paul: paule; peter: pitt; rahel: rachel; rosalie: rosel rosa rosi; sebastian: bastian basti; sophie: fieke soffi; theodor: theo thdr; therese: resi;
ursula: ulla urs ursel; valentin: velten valtin; veronika: vroni; walburga: burga walli; wilhelm: willy willi wim helm; wilhelmine: minna mine
"""
# Bodies and the ways to shorten them.
BODIES = {
    "gesellschaft": ("gesellschaft", "gesellsch", "ges"), "schriftleitung": ("schriftleitung", "schriftltg", "redaktion", "red"),
    "herausgeberkreis": ("herausgeberkreis", "hrsgkreis", "hgkreis", "hrsg", "hg"), "verein": ("verein", "ver"),
}
FILLERS = {"der", "die", "das", "d", "von", "v", "vom", "zu", "und", "u", "fuer", "f", "des", "kreis"}
PARTICLES = {"von", "v", "van", "zu", "de"}

_canon = {}
for _entry in SHORT_FORMS.replace("\n", " ").split(";"):
    _name, _, _forms = _entry.strip().partition(":")
    for _form in _forms.split():
        _canon.setdefault(_form, set()).add(_name)
_umlauts = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})


def plain(name: str) -> str:
    """A name in lower case, umlauts written out, without accents."""
    s = unicodedata.normalize("NFC", name).casefold().translate(_umlauts)
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def parts(name: str) -> tuple[str, tuple[str, ...]]:
    """(first part, words of the second part) of a plain name."""
    first, _, second = name.partition("_")
    return first, tuple(w for w in re.split(r"[^\w]+", second.replace(".", " ")) if w)


def edits(a: str, b: str, most: int) -> int:
    """Inserted, lost, exchanged and swapped characters between two words; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, older[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return most + 1
    return row[-1]


def _surnames(a: str, b: str) -> float:
    a, b = (re.sub(r"^(?:von|van|zu|de)\W+", "", x) for x in (a, b))
    a, b = re.sub(r"\W", "", a), re.sub(r"\W", "", b)
    size = min(len(a), len(b))
    if size < 3:
        return 1.0 if a == b else 0.0
    most = 1 if size < 6 else 2 if size < 12 else 3
    d = edits(a, b, most)
    return 0.0 if d > most else (1.0, 0.9, 0.75, 0.6)[d]


def _given(a: str, b: str) -> float:
    """How well two given names agree."""
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    forms = {long, *_canon.get(long, ())}
    if len(short) == 1:
        return 0.75 if any(f[0] == short for f in forms) else 0.0
    if forms & {short, *_canon.get(short, ())}:
        return 0.95
    if long.startswith(short) or any(f.startswith(short) for f in forms):
        return 0.9
    if len(short) >= 3 and short[0] == long[0] and not set(short) & set("aeiou") and _skips(short, long):
        return 0.85
    most = 1 if len(long) < 6 else 2
    d = min(edits(x, y, most) for x in (short, *_canon.get(short, ())) for y in forms) if len(short) >= 3 else most + 1
    return 0.0 if d > most else (0.95, 0.85, 0.7)[d]


def _skips(short: str, long: str) -> bool:
    at = iter(long)
    return all(c in at for c in short)


def _givens(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    a, b = (tuple(w for w in x if w not in PARTICLES) or x for x in (a, b))
    if not a or not b:
        return 0.5 if not a and not b else 0.3
    whole = _given("".join(a), "".join(b))
    pairs = [_given(x, y) for x, y in zip(a, b)]
    score = min(pairs)
    if len(a) != len(b) and score:
        score *= 0.95
    glued = max((_given(x + "von", "".join(b)) for x in a), default=0.0), max((_given("".join(a), y + "von") for y in b), default=0.0)
    return max(score, whole, *(0.95 * g if g >= 0.85 else 0.0 for g in glued))


def _body(name: str) -> tuple[str, frozenset, str] | None:
    """(kind, other words, second part) of a body's name."""
    first, _, second = name.partition("_")
    words = [w for w in re.split(r"[^\w]+", first) if w]
    joined = "".join(words)
    for kind, forms in BODIES.items():
        for form in forms:
            if form in words or joined.startswith(form) and len(form) > 6:
                rest = [w for w in words if w != form and w not in FILLERS] if form in words else [re.sub("^der", "", joined[len(form) :].removeprefix("kreis"))]
                if any(len(w) > 5 for w in rest):
                    return kind, "".join(sorted(rest)), second
    return None


def _ways(name: str) -> tuple[tuple[str, tuple[str, ...]], tuple[str, tuple[str, ...]]]:
    """(surname, given names) of a plain name as it stands and with its parts exchanged."""
    first, second = parts(name)
    return (first, second), ("-".join(second), tuple(w for w in re.split(r"\W+", first) if w))


def likeness(a: str, b: str) -> float:
    """0 to 1: how surely two plain names name one person or body; 0 if parts contradict each other."""
    x, y = _body(a), _body(b)
    if x or y:
        if not (x and y) or x[0] != y[0]:
            if x and y or not (x or y):
                return 0.0
            if edits(a, b, 2) <= 2:
                return 0.8
            return 0.0
        return min(_surnames(x[2], y[2]), _surnames(x[1], y[1]))
    ways_a, ways_b = _ways(a), _ways(b)
    best = 0.0
    for (sa, ga), (sb, gb) in ((ways_a[0], ways_b[0]), (ways_a[0], ways_b[1]), (ways_a[1], ways_b[0])):
        s = _surnames(sa, sb)
        if s:
            g = _givens(ga, gb)
            if g and s + g >= 1.35:
                best = max(best, s * g)
    return best


def name_grams(name: str) -> set[str]:
    """Grams of a plain name: those of each part, with the initials that the other part's first word may have."""

    def words(part: str) -> list[str]:
        found = [w for w in re.split(r"[\W_]+", part) if w]
        return [w for w in found if w not in PARTICLES] or found

    def initials(ws: list[str]) -> set[str]:
        return {INITIALS.get(w[0], w[0]) for w in (ws[0], *_canon.get(ws[0], ()))} if ws else {"-"}

    body = _body(name)
    if body:
        sides = [(body[2], {body[0][0]}), (body[1], {body[2][:1]})]
    else:
        first, _, second = name.partition("_")
        x, y = words(first), words(second)
        sides = [("".join(x), initials(y)), ("".join(y), initials(x))]
    return {f"{w[k : k + GRAM]}|{i}" for part, ii in sides if part for w in [f"<{part}>"] for k in range(len(w) - GRAM + 1) for i in ii}


def gram_vectors(names: DataFrame) -> DataFrame:
    """(name, gram, df, weight) of unit length for plain names (name); weights are tf-idf over all names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, grams = [], []
            for i, p in enumerate(batch.column(0).to_pylist()):
                found = sorted(name_grams(p))
                where += [i] * len(found)
                grams += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), pa.array(grams, pa.string())], names=["name", "gram"])

    grams = names.select("name").mapInArrow(run, "name string, gram string")
    total = names.count()
    rarity = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + F.lit(float(total)) / F.col("df")))
    weighted = grams.join(rarity, "gram")
    norm = weighted.groupBy("name").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return weighted.join(norm, "name").select("name", "gram", "df", (F.col("idf") / F.col("norm")).alias("weight"))


def alike_pairs(vectors: DataFrame, least: float = COSINE, rules: bool = True) -> DataFrame:
    """(a, b, sim) of all pairs with a < b whose cosine ``sim`` is at least ``least`` and, with ``rules``, whose parts don't
    contradict each other. The names that have a gram meet in blocks, so that a gram of many names is no single task."""
    entry = F.struct("df", "gram", "weight")
    lists = materialize(vectors.groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("grams")), "name-grams")  # a name's own grams
    # the grams before the place from which on the rest of the vector is too short to reach the threshold alone
    square = lambda g: g["weight"] * g["weight"]
    rest = F.aggregate(
        F.reverse("grams"), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda s, g: F.when(s["sum"] + square(g) < least * least, F.struct((s["sum"] + square(g)).alias("sum"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(2.0).alias("sum"), s["n"].alias("n"))),
    )["n"]
    prefix = lists.select("name", F.explode(F.slice("grams", 1, F.size("grams") - rest)).alias("g")).select("name", F.col("g.gram").alias("gram"), F.ceil(F.col("g.df") / BLOCK).cast("bigint").alias("blocks"))
    a = prefix.select(F.col("name").alias("a"), "gram", F.pmod(F.xxhash64("name"), F.col("blocks")).alias("block"))
    b = prefix.select(F.col("name").alias("b"), "gram", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    pairs = a.join(b, ["gram", "block"]).where("a < b").select("a", "b").distinct()
    slim = lists.select("name", F.map_from_arrays(F.transform("grams", lambda g: g["gram"]), F.transform("grams", lambda g: g["weight"])).alias("m"))
    joined = pairs.join(slim.select(F.col("name").alias("a"), F.col("m").alias("ma")), "a").join(slim.select(F.col("name").alias("b"), F.col("m").alias("mb")), "b")
    dot = F.aggregate(F.map_entries("ma"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(F.col("mb"), e["key"]), F.lit(0.0)))
    near = joined.select("a", "b", F.round(dot, DIGITS).alias("sim")).where(F.col("sim") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([likeness(x, y) >= AGREES for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    return near.mapInArrow(run, "a string, b string, sim double") if rules else near


def near_names(names: DataFrame, least: float = COSINE, rules: bool = True) -> DataFrame:
    """``alike_pairs`` of plain names (name). The numbers of names with a gram go to the executors, where a name's vector is worked
    out from the name: what is shuffled is one entry for each gram that must be compared, and pairs that pass."""

    def only_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([g for p in batch.column(0).to_pylist() for g in name_grams(p)], pa.string())], names=["gram"])

    rarity = materialize(names.select("name").mapInArrow(only_grams, "gram string").groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "grams")
    if rarity.count() > GRAMS:
        discard(rarity)
        return alike_pairs(gram_vectors(names), least, rules)
    told = rarity.toArrow()
    shared = names.sparkSession.sparkContext.broadcast((names.count(), told["gram"].combine_chunks(), told["df"].combine_chunks()))
    discard(rarity)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = _vectors(shared.value)
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                left = [0.0]  # square of the length of what follows
                grams = vector(p)
                for _, _, w in reversed(grams):
                    left.append(left[-1] + w * w)
                left.reverse()
                out += [(p, g, -(-df // BLOCK), w, math.sqrt(left[k + 1])) for k, (df, g, w) in enumerate(grams) if left[k] >= least * least - SLACK]
            cols = list(zip(*out)) or [[]] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["name", "gram", "blocks", "w", "rest"])

    found = names.select("name").mapInArrow(entries, "name string, gram string, blocks int, w double, rest double")
    # a gram's names meet by pairs of blocks; both sides of the join are the same rows, which are shuffled once
    own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    found = found.select("name", "gram", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "w", "rest")
    found = found.select("name", "gram", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "w", "rest")
    # the rows are few and their pairs many: more tasks than the rows' bytes ask for
    spark = names.sparkSession
    found = found.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "gram", "i", "j")
    # from the first gram that two names share on, all they share is in the rests
    most = F.col("x.w") * F.col("y.w") + F.col("x.rest") * F.col("y.rest")
    met = found.alias("x").join(found.alias("y"), ["gram", "i", "j"]).where((F.col("x.name") < F.col("y.name")) & (most >= least - SLACK)).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, known, sides = _vectors(shared.value), {}, {}
        for batch in batches:
            out = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kept in (known, sides):
                    if len(kept) >= KNOWN:
                        kept.clear()
                if a not in known:
                    known[a] = vector(a)
                if b not in sides:
                    sides[b] = {g: w for _, g, w in vector(b)}
                other = sides[b]
                sim = round(sum([w * other[g] for _, g, w in known[a] if g in other]), DIGITS)
                if sim >= least and (not rules or likeness(a, b) >= AGREES):
                    out.append((a, b, sim))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()))], names=["a", "b", "sim"])

    return met.mapInArrow(run, "a string, b string, sim double").distinct()


def _vectors(told: tuple) -> Callable[[str], list[tuple[int, str, float]]]:
    """The function of a plain name that gives its (df, gram, weight), rarest first, from (names, grams, their df)."""
    total, grams, dfs = told
    df = dict(zip(grams.to_pylist(), dfs.to_pylist()))

    def vector(name: str) -> list[tuple[int, str, float]]:
        found = sorted((df[g], g) for g in name_grams(name))
        idf = [math.log(1 + total / n) for n, _ in found]
        norm = math.sqrt(sum(x * x for x in idf))
        return [(n, g, x / norm) for (n, g), x in zip(found, idf)]

    return vector


def average_linkage(pairs: DataFrame, least: float = LINKAGE) -> DataFrame:
    """(name, cluster): average-linkage clusters of the pairs (a, b, sim), pairs that are missing being 0 alike. Each round
    merges all clusters that are each other's best partner; since average linkage never raises a likeness by a merger,
    this gives the same clusters as merging one pair at a time."""
    members = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct().withColumn("cluster", F.col("name"))
    members, links = materialize(members, "members"), materialize(pairs.groupBy("a", "b").agg(F.max("sim").alias("total")), "links")
    while True:  # each round merges a pair at least
        sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        rated = (
            links.join(sizes.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
            .withColumn("mean", F.col("total") / (F.col("na") * F.col("nb"))).where(F.col("mean") >= least)
        )
        # a total order of pairs, the same seen from either side
        order = F.struct("mean", (-F.xxhash64("a", "b")).alias("h"), "a", "b")
        sides = rated.select(F.col("a").alias("c"), order.alias("o")).union(rated.select(F.col("b").alias("c"), order.alias("o")))
        best = sides.groupBy("c").agg(F.max("o").alias("o")).select(F.col("o.a").alias("a"), F.col("o.b").alias("b"))
        merged = materialize(best.groupBy("a", "b").count().where("count = 2").select(F.least("a", "b").alias("into"), F.greatest("a", "b").alias("gone")), "mergers")
        if merged.isEmpty():
            break
        new_members = materialize(members.join(merged, members.cluster == merged.gone, "left").select("name", F.coalesce("into", "cluster").alias("cluster")), "members")
        x, y = (merged.select(F.col("gone").alias(c), F.col("into").alias(f"{c}_into")) for c in ("a", "b"))
        moved = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("a_into", "a").alias("p"), F.coalesce("b_into", "b").alias("q"), "total").where("p <> q")
        new_links = materialize(moved.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("total").alias("total")), "links")
        discard(members, links, merged)
        members, links = new_members, new_links
    return members


def variant_clusters(table: DataFrame, file_name: str = "file_name", rules: bool = True) -> DataFrame:
    """(name, cluster) of the author parts (first two parts of ``file_name``, as typed) that have a variant."""
    name = F.substring_index(F.col(file_name), "_", 2)
    spelt = F.pandas_udf(lambda s: s.map(plain), "string")
    names = materialize(table.select(name.alias("name")).where("name <> '' and name <> '_'").distinct().withColumn("plain", spelt("name")), "names")
    nodes = names.select(F.col("plain").alias("name")).distinct()
    found = average_linkage(materialize(near_names(nodes, rules=rules), "name-pairs")).withColumnRenamed("name", "plain")
    placed = names.join(found, "plain", "left").select("name", F.coalesce("cluster", "plain").alias("cluster"))
    several = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    return placed.join(several, "cluster", "left_semi").select("name", "cluster")


def variant_pairs(clusters: DataFrame) -> DataFrame:
    """(author_a, author_b) of each two variants of a cluster, smaller string first. A cluster holds the different spellings
    of one name, which the question asks for in pairs."""
    a = clusters.select("cluster", F.col("name").alias("author_a"))
    b = clusters.select("cluster", F.col("name").alias("author_b"))
    return a.join(b, "cluster").where("author_a < author_b").select("author_a", "author_b")
