from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import splits
from scriptorium.llm.components import components

SCHEMA = "id int, file_name string, pub_year int, author_viaf string, group_id string"


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, keys in rows:
        for k in keys:
            a, b = find(("id", i)), find(k)
            parent[a] = b
    root = {}
    for i, _ in rows:
        root.setdefault(find(("id", i)), []).append(i)
    return {i: min(v) for v in root.values() for i in v}


def test_groups(spark):
    rows = [
        (1, "Müller_Anna_X_1800", 1800, "999000000011", "x"), (2, "MUELLER_ANNA_Y_1801", 1801, None, None), (3, "Other_B_Z_1802", 1802, "viaf 9990 00000011", None),
        (4, "Solo_C_Q_1803", None, "unbekannt", None), (5, "Solo_D_Q_1803", 1803, "0", None), (6, None, 1804, None, None), (6, None, 1804, None, None),
        (7, "E_F_G_1", 1805, "(VIAF)999000000022;999000000033.0", None), (8, "H_I_J_1", 1805, "VIAF:999000000033", None), (None, "Z_Z_Z_1", 1, None, None), (9, "", 1, "", None),
    ]
    got = {r.id: r.group_id for r in splits.grouped_books(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}
    assert splits.grouped_books(spark.createDataFrame([], SCHEMA)).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rows = [(i, f"A{i % 400}_B_T_{i}", 1700 + i % 200, None, None) for i in range(1, 2001)] + [(i, "Hot_Author_T_1", 1850, None, None) for i in range(3000, 3600)]
    books = spark.createDataFrame(rows, SCHEMA)
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5)], "split_name string, share double")
    got = splits.grouped_splits(splits.grouped_books(books), plan).collect()
    assert len(got) == len(rows) and all(r.split_name for r in got)
    assert max(Counter(g for g, _ in {(r.group_id, r.split_name) for r in got}).values()) == 1
    n = Counter(r.split_name for r in got)
    assert abs(n["train"] / len(got) - 0.8) < 0.03 and abs(n["test"] / len(got) - 0.1) < 0.03
    none = splits.grouped_splits(splits.grouped_books(books.limit(3)), plan.limit(0)).collect()
    assert [r.split_name for r in none] == [None] * 3


def test_components_against_union_find(spark):
    import random

    rng = random.Random(4)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(110)] + [("hub", f"h{i}") for i in range(200)] + [("x", None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: find(x) for x in parent}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1200), st.dictionaries(st.integers(0, 5), st.integers(1, 9), min_size=1)), min_size=1, max_size=60))
def test_every_component_is_placed(vectors):
    units = [(str(k), m, {x: m * n for x, n in v.items()}) for k, (m, v) in enumerate(vectors)]
    got = splits._place(units, [("a", 0.7), ("b", 0.3)])
    assert {k: sum(n for _, n in runs) for k, runs in got.items()} == {k: m for k, m, _ in units}


def test_shares_of_each_label(spark, monkeypatch):
    """More than 1,000 components, each placed for itself; also where vectors are shortened and ranks told by bucket."""
    rows = [(i, f"A{i // (1 + i % 3)}_B_T_{i}", 1650 + (i * 7919) % 300, None, None) for i in range(1, 4001)]
    grouped = splits.grouped_books(spark.createDataFrame(rows, SCHEMA)).cache()
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")

    def deviation():
        got = {r.id: r.split_name for r in splits.grouped_splits(grouped, plan).collect()}
        assert len(got) == len(rows)
        by = {}
        for i, _, year, _, _ in rows:
            by.setdefault((year - 1600) // 25, []).append(got[i])
        whole = Counter(got.values())
        assert all(abs(whole[s] / len(got) - share) < 0.02 for s, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
        return max(abs(Counter(v)[s] - share * len(v)) for v in by.values() for s, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))

    assert deviation() <= 4
    monkeypatch.setattr(splits, "RANKED", 300)
    assert deviation() <= 4
    monkeypatch.setattr(splits, "VECTORS", 10)
    assert deviation() <= 40  # of 330 books of a label, which chance divides


def one_by_one(units, plan):
    """Each component placed for itself: the rarest outstanding label first, into the split that needs it most."""
    total = Counter()
    for _, _, v in units:
        total.update(v)
    need = {(s, x): share * total[x] for s, share in plan for x in total}
    open_all = {s: share * sum(total.values()) for s, share in plan}
    waiting, out = {k: (m, v) for k, m, v in units}, {}
    while waiting:
        left = Counter()
        for _, v in waiting.values():
            left.update(v)
        x = min(left, key=lambda y: (left[y], y))
        for k in sorted((k for k, (_, v) in waiting.items() if x in v), key=lambda k: (-waiting[k][1][x] // waiting[k][0], -sum(waiting[k][1].values()) // waiting[k][0], k)):
            m, v = waiting.pop(k)
            out[k] = Counter()
            for _ in range(m):
                s = max((s for s, _ in plan), key=lambda s: (need[s, x], open_all[s], s))
                out[k][s] += 1
                open_all[s] -= sum(v.values()) // m
                for y in v:
                    need[s, y] -= v[y] // m
    return {k: {s: n for s, n in c.items() if n} for k, c in out.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3000), st.dictionaries(st.integers(-1, 5), st.integers(1, 130), min_size=1)), min_size=1, max_size=12))
def test_many_components_of_a_vector_are_placed_one_by_one(vectors):
    plan = [("test", 0.125), ("train", 0.75), ("validation", 0.125)]
    units = [(str(k), m, {x: m * n for x, n in v.items()}) for k, (m, v) in enumerate(vectors)]
    got = {k: {s: sum(n for t, n in runs if t == s) for s, _ in runs} for k, runs in splits._place(units, plan).items()}
    assert got == one_by_one(units, plan)


def test_splits_do_not_depend_on_bounds(spark, monkeypatch):
    """Many different vectors, counts over 99 that differ in the last digit, and vectors that go through several batches."""
    rows, i = [], 0
    for author in range(1500):
        for label in range(1 + author % 3):
            for _ in range(1 + (author * 7 + label * 13) % 11 if author > 3 else 101 + author):
                i += 1
                rows.append((i, f"A{author}_B_T_{i}", 1600 + 25 * ((author * (label + 3)) % 16), None, None))
    grouped = splits.grouped_books(spark.createDataFrame(rows, SCHEMA)).cache()
    plan = [("test", 0.125), ("train", 0.75), ("validation", 0.125)]
    wanted = spark.createDataFrame(plan, "split_name string, share double")

    def got():
        return sorted(map(tuple, splits.grouped_splits(grouped, wanted).collect()))

    whole = got()
    assert len(whole) == len(rows)
    vectors = {}
    for i, group, s in whole:
        vectors.setdefault((group, s), Counter())[(rows[i - 1][2] - 1600) // 25] += 1
    found = {}
    for (_, s), v in vectors.items():
        found.setdefault(" ".join(f"{x}:{n}" for x, n in sorted(v.items())), Counter())[s] += 1
    units = [(k, c.total(), {int(x): c.total() * int(n) for x, n in (p.split(":") for p in k.split(" "))}) for k, c in found.items()]
    assert len(units) > 100 and {k: dict(c) for k, c in found.items()} == one_by_one(units, plan)
    monkeypatch.setattr(splits, "VECTORS", 10)
    assert got() == whole
    monkeypatch.setattr(splits, "RANKED", 100)
    assert got() == whole
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
