"""Splits that keep related records together (problem 1).

Method: grouped iterative stratification. Books are linked by the author ids and the author names they hold; the
connected components are found, each component's label vector (books by period of publication) is summed up, and
components are placed with the rarest outstanding label first into the split that needs that label most.

Placing is sequential by nature, so it runs on the different label vectors, each with the number of components that have
it, rather than on the components: those of one vector are interchangeable, which of them goes where is told by their rank.
The vectors are sorted and go through one task, which holds the outstanding needs only. The components of a vector are
placed at once, with the numbers that placing them one by one gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.components import components, salted_join
from scriptorium.session import materialize

#: Different vectors whose splits go to the executors at most, of more they are joined, with the same result; components
#: ranked in one task, about.
VECTORS, RANKED = 200_000, 500_000
#: Label of a book: its period of so many years, years outside the bounds or null being one label of their own.
PERIOD_YEARS, FIRST_YEAR, LAST_YEAR = 25, 1600, 2000


def author_name(file_name: str = "file_name"):
    """The first two parts of a file name, in lower case, with the umlauts written out."""
    c = F.lower(F.substring_index(F.col(file_name), "_", 2))
    for a, b in (("a", "ä"), ("o", "ö"), ("u", "ü")):
        c = F.replace(F.replace(c, F.lit(b), F.lit(a + "e")), F.lit(a + "̈"), F.lit(a + "e"))
    return c


def author_ids(author_viaf: str = "author_viaf"):
    """The ids in a field. A field may hold several; an id may carry a prefix, blanks within, or a decimal zero;
    fields without three digits, or with one digit repeated, are stand-ins."""
    parts = F.split(F.col(author_viaf), r"[;|/,&+]")
    digits = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"\.0+$", ""), r"[^0-9]", ""))
    return F.array_distinct(F.filter(digits, lambda d: (F.length(d) >= 3) & ~d.rlike(r"^(\d)\1*$")))


def grouped_books(books: DataFrame) -> DataFrame:
    """(id, group_id, file_name, pub_year) of each book: group_id is the least id of its component.

    Repeated rows count once; a row whose id is null is dropped; rows of one id that differ are one book that has the
    keys of all of them. A book without author name and ids is a group of its own. Further columns are ignored.
    """
    rows = books.select(F.col("id").alias("id"), "file_name", "pub_year", "author_viaf").where("id is not null").distinct()
    name = F.when(F.length(author_name()) > 0, F.array(F.concat(F.lit("n:"), author_name()))).otherwise(F.array().cast("array<string>"))
    ids = F.transform(F.coalesce(author_ids(), F.array().cast("array<string>")), lambda d: F.concat(F.lit("v:"), d))
    keyed = rows.select("id", "file_name", "pub_year", F.concat(name, ids, F.array(F.concat(F.lit("z:"), F.col("id").cast("string")))).alias("keys"))
    links = keyed.select(F.col("keys")[0].alias("u"), F.explode("keys").alias("v"))
    found = components(links.distinct())
    of_key = found.withColumnsRenamed({"node": "key", "component": "c"})
    placed = keyed.select("id", F.concat(F.lit("z:"), F.col("id").cast("string")).alias("key")).distinct().join(of_key, "key")
    least = placed.groupBy("c").agg(F.min("id").alias("group_id"))
    books_once = keyed.groupBy("id").agg(F.max("file_name").alias("file_name"), F.max("pub_year").alias("pub_year"))
    return salted_join(placed.select("id", "c").distinct(), least, "c", "id").join(books_once, "id").select("id", "group_id", "file_name", "pub_year")


def _by_label(sums: list[dict[int, int]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for v in sums:
        for x, n in v.items():
            out[x] = out.get(x, 0) + n
    return out


def _needs(sums: Iterable[dict[int, int]], plan: list[tuple[str, float]]) -> tuple[dict[int, int], dict[tuple[str, int], float], dict[str, float]]:
    """What placing begins with, from books by label, summed up over the components that have the same labels: each label's
    turn, the rarest outstanding one being next, and the books that each split needs by label and in all."""
    sums = list(sums)
    total = _by_label(sums)
    turn: dict[int, int] = {}
    while left := _by_label(sums):
        x = min(left, key=lambda y: (left[y], y))
        turn[x] = len(turn)
        sums = [v for v in sums if x not in v]
    turn |= {x: len(total) for x in total.keys() - turn.keys()}  # all their components come with a label that is rarer
    weight = sum(share for _, share in plan) or 1.0
    return turn, {(s, x): share / weight * n for s, share in plan for x, n in total.items()}, {s: share / weight * sum(total.values()) for s, share in plan}


def _place(units: list[tuple[str, int, dict[int, int]]], plan: list[tuple[str, float]], needs=None) -> dict[str, list[tuple[str, int]]]:
    """For each label vector the splits of its components, as runs (split, number of components) in the order of their ranks.
    ``units`` are (vector's name, number of components, summed counts by label): all there are, or with ``needs``, which are
    brought up to date, those whose turn is next."""
    turn, need, open_all = needs or _needs([v for _, _, v in units], plan)

    def place_in_order(unit):
        k, m, v = unit
        x = min(v, key=turn.__getitem__)
        return turn[x], -v[x] / m, -sum(v.values()) / m, k

    out: dict[str, list[tuple[str, int]]] = {}
    for k, m, v in sorted(units, key=place_in_order):
        x = min(v, key=turn.__getitem__)
        each, size = v[x] / m, sum(v.values()) / m
        runs = {s: 0 for s, _ in plan}

        def give(s, n):
            for y, c in v.items():
                need[s, y] -= c / m * n
            open_all[s] -= size * n
            runs[s] += n

        # one by one the neediest split gets a component; all above the level to which m of them bring the needs down is certain
        levels = sorted((need[s, x] for s in runs), reverse=True)
        level = max((sum(levels[:i]) - m * each) / i for i in range(1, len(levels) + 1))
        for s, n in [(s, int((need[s, x] - level) / each) - 1) for s in runs]:
            if n > 0:
                give(s, n)
        for _ in range(m - sum(runs.values())):
            give(max(runs, key=lambda s: (need[s, x], open_all[s], s)), 1)
        out[k] = [(s, n) for s, n in runs.items() if n]
    return out


def _placing(plan: list[tuple[str, float]], needs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_place`` over batches (vector, number of components) in the order of their turns: (vector, ends), ends being the
    last rank that each split gets."""
    kind = pa.list_(pa.struct([("split_name", pa.string()), ("upto", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, need, open_all = needs
        now = turn, dict(need), dict(open_all)
        for batch in batches:
            units = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units.append((k, m, {int(x): m * int(n) for x, n in (part.split(":") for part in k.split(" "))}))
            names, ends = [], []
            for k, runs in _place(units, plan, now).items():
                upto = 0
                names.append(k)
                ends.append([{"split_name": s, "upto": (upto := upto + n)} for s, n in runs])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ends, kind)], names=["vector", "ends"])

    return run


def grouped_splits(grouped: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, group_id, split_name) of every book of ``grouped_books``; no group is cut.

    ``plan`` has a row per split (its size is that of the plan, not of the data); shares are taken relative to their
    sum, rows with null or no share are no splits. Without any split, split_name is null. A group larger than every
    need still goes into one split, so that shares can then be missed by that group's size.
    """
    splits = [(r[0], float(r[1])) for r in plan.select("split_name", "share").where("share > 0 and split_name is not null").orderBy("split_name").collect()]
    if not splits:
        return grouped.select("id", "group_id", F.lit(None).cast("string").alias("split_name"))
    year = F.when(F.col("pub_year").between(FIRST_YEAR, LAST_YEAR - 1), F.floor((F.col("pub_year") - FIRST_YEAR) / PERIOD_YEARS)).otherwise(-1).cast("int")
    by_label = grouped.groupBy("group_id", year.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    vector = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: F.concat_ws(":", x["label"].cast("string"), x["n"].cast("string"))), " ")
    named = materialize(by_label.groupBy("group_id").agg(vector.alias("vector")), "vectors")
    units = materialize(named.groupBy("vector").agg(F.count(F.lit(1)).alias("m")), "units")
    labels = range(-1, (LAST_YEAR - 1 - FIRST_YEAR) // PERIOD_YEARS + 1)
    counts = F.str_to_map("vector", F.lit(" "), F.lit(":"))
    by_set = units.withColumn("v", counts).groupBy(F.regexp_replace("vector", ":[0-9]+", "")).agg(*(F.sum(F.col("v")[str(x)].cast("bigint") * F.col("m")).alias(str(x)) for x in labels))
    # a row per set of labels, at any size of the input 2 ** len(labels) at most
    needs = _needs([{x: r[str(x)] for x in labels if r[str(x)]} for r in by_set.collect()], splits)
    turns = F.array(*(F.lit(x) for x in sorted(labels, key=lambda x: needs[0].get(x, len(labels)))))
    parts = F.transform(F.split("vector", " "), lambda p: F.struct(F.array_position(turns, F.split_part(p, F.lit(":"), F.lit(1)).cast("int")).alias("turn"), (-F.split_part(p, F.lit(":"), F.lit(2)).cast("bigint")).alias("less")))
    size = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["less"])
    in_turn = units.withColumn("parts", parts).select("vector", "m", F.array_min("parts").alias("first"), size.alias("less")).repartition(1).sortWithinPartitions("first", "less", "vector")
    ends = materialize(in_turn.select("vector", "m").mapInArrow(_placing(splits, needs), "vector string, ends array<struct<split_name:string, upto:bigint>>"), "ends")
    # buckets follow the order of the hash, so that a rank is the same with any number of them
    buckets = -(-named.count() // RANKED) or 1
    of_hash = F.xxhash64("group_id")
    placed = named.select("group_id", "vector", of_hash.alias("hash"), F.floor((of_hash.cast("double") / 2.0**64 + 0.5) * buckets).alias("bucket"))
    rank = F.row_number().over(Window.partitionBy("vector", "bucket").orderBy("hash", "group_id"))
    before = placed.groupBy("vector", "bucket").count().select("vector", "bucket", (F.sum("count").over(Window.partitionBy("vector").orderBy("bucket")) - F.col("count")).alias("before"))
    by_bucket = before.join(F.broadcast(ends) if ends.count() <= VECTORS else ends, "vector")
    ranked = placed.withColumn("rank", rank).join(by_bucket, ["vector", "bucket"])
    group_split = ranked.select("group_id", F.filter("ends", lambda e: e["upto"] >= F.col("rank") + F.col("before"))[0]["split_name"].alias("split_name"))
    return salted_join(grouped.select("id", "group_id"), group_split, "group_id", "id").select("id", "group_id", "split_name")


def later_members(grouped: DataFrame) -> DataFrame:
    """(group_id, id) of the books whose group has a smaller id."""
    return grouped.where("id > group_id").select("group_id", "id")
