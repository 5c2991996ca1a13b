import math
from collections import Counter

import pytest

from scriptorium.llm import names


@pytest.mark.parametrize("a, b", [
    ("Kimpevald_Eduard", "Kimpevalz_Eduard"), ("Boengaloh_Ferdinand", "Böngaloh_F."), ("Lilkumund_Christian", "C_Lilkumund"), ("Bannubert_Katharina", "BANNUBERT_Kaethe"), ("Spugihus_August", "Spugihus_Aug."),
    ("Hugo-von_Puelkiner", "Puelkiner_Hugo"), ("Kloeckoschitz_Hugo-von", "Kloeckoschitz_H-v"), ("Gesellschaft-der-Bibliophilen_Buelkumark", "Ges-d-Bibliophilen_Buelkumark"), ("Red-Lesefreunde_Jaungalin", "schriftleitung-lesefreunde_jaungalin"),
])
def test_alike(a, b):
    assert names.likeness(names.plain(a), names.plain(b)) >= names.AGREES
    assert names.likeness(names.plain(b), names.plain(a)) >= names.AGREES


@pytest.mark.parametrize("a, b", [
    ("Vengaler_August", "Vengaler_Franziska"), ("Spugihus_August", "Red-Mundartdichter_Spugihus"), ("Gesellschaft-der-Bibliophilen_X", "Verein-der-Bibliophilen_X"), ("Kurz_Anna", "Lang_Anna"),
])
def test_different(a, b):
    assert names.likeness(names.plain(a), names.plain(b)) < names.AGREES


def test_clusters(spark):
    typed = ["Kimpevald_Eduard", "Kimpevalz_Eduard", "kimpevald_eduard", "Eduard_Kimpevald", "Kimpevald_E.", "Kimpevald_Rosalie", "Stoltofer_Paul", "Stoltofer_Paul", "", None, "Alone"]
    df = spark.createDataFrame([(f"{t}_Title_1800" if t else t, "x", "y") for t in typed], "file_name string, name string, a string")
    got = names.variant_clusters(df)
    pairs = {(r.author_a, r.author_b) for r in names.variant_pairs(got).collect()}
    group = sorted(typed[:5])
    assert pairs == {(a, b) for i, a in enumerate(group) for b in group[i + 1 :]}
    assert names.variant_pairs(names.variant_clusters(df.limit(0))).count() == 0


def test_join_misses_no_pair(spark, monkeypatch):
    some = ["Kimpevald_Eduard", "Kimpevalz_Eduard", "Kimpeval_E", "Stoltofer_Paul", "Stoltover_Paul", "Paul_Stoltofer", "Rampetner_Katharina", "Rampetner_Kaethe"]
    rows = sorted({names.plain(n) for n in some})
    grams = {p: names.name_grams(p) for p in rows}
    df = Counter(g for f in grams.values() for g in f)
    vec = {}
    for n, f in grams.items():
        w = {g: math.log(1 + len(rows) / df[g]) for g in f}
        size = math.sqrt(sum(x * x for x in w.values()))
        vec[n] = {g: x / size for g, x in w.items()}
    cosine = {(a, b): sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) for a in rows for b in rows if a < b}
    vectors = names.gram_vectors(spark.createDataFrame([(r,) for r in rows], "name string")).cache()
    for block in (5_000, 1):
        monkeypatch.setattr(names, "BLOCK", block)
        plain = {(r.a, r.b): r.sim for r in names.alike_pairs(vectors, rules=False).collect()}
        assert plain == {p: pytest.approx(c) for p, c in cosine.items() if c >= names.COSINE}
        ruled = {(r.a, r.b) for r in names.alike_pairs(vectors).collect()}
        assert ruled == {p for p in plain if names.likeness(*p) >= names.AGREES}


def test_spellings_of_case_and_umlaut_are_one_node(spark):
    df = spark.createDataFrame([(f"{t}_Title_1800",) for t in ["Böngaloh_Anna", "BÖNGALOH_Anna", "Boengaloh_anna", "Other_Paul"]], "file_name string")
    assert {r.name for r in names.variant_clusters(df).collect()} == {"Böngaloh_Anna", "BÖNGALOH_Anna", "Boengaloh_anna"}


def test_given_names_that_begin_with_letters_written_for_one_another(spark):
    df = spark.createDataFrame([(f"{t}_Title_1800",) for t in ["Braundever_Johann", "Braundever_Iohann", "Stoltofer_Paul", "Rampetner_Anna"]], "file_name string")
    assert {r.name for r in names.variant_clusters(df).collect()} == {"Braundever_Johann", "Braundever_Iohann"}


def test_average_linkage(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.5), ("a", "c", 0.0)], "a string, b string, sim double")
    got = {r.name: r.cluster for r in names.average_linkage(pairs, 0.45).collect()}
    # one best pair merges first; the third then averages 0.45 with it
    assert got["a"] == got["b"] and got["d"] in ("c", "d", "a")
    assert len(set(got.values())) <= 2


def test_average_linkage_of_many_spellings(spark):
    # one right spelling and 62 typos of it: a typo joins in each round
    some = [f"n{i:02d}" for i in range(63)]
    pairs = spark.createDataFrame([(a, b, 0.9 if a == "n00" else 0.75) for i, a in enumerate(some) for b in some[i + 1 :]], "a string, b string, sim double")
    got = {r.name: r.cluster for r in names.average_linkage(pairs).collect()}
    assert set(got) == set(some) and len(set(got.values())) == 1


def test_names_meet_without_shuffled_vectors(spark, monkeypatch):
    some = ["Kimpevald_Eduard", "Kimpevalz_Eduard", "Kimpeval_E", "Stoltofer_Paul", "Stoltover_Paul", "Paul_Stoltofer", "Rampetner_Katharina", "Rampetner_Kaethe"]
    nodes = spark.createDataFrame([(names.plain(n),) for n in some], "name string")
    table = spark.createDataFrame([(f"{n}_Title_1800",) for n in some], "file_name string")
    pairs = lambda: [sorted(map(tuple, names.near_names(nodes, rules=r).collect())) for r in (True, False)]
    whole = pairs()
    monkeypatch.setattr(names, "BLOCK", 1)
    assert pairs() == whole and len(whole[0]) == 7
    monkeypatch.setattr(names, "GRAMS", 0)
    assert pairs() == whole
    monkeypatch.setattr(names, "GRAMS", 1_000)
    monkeypatch.setattr(names, "gram_vectors", None)  # not needed
    assert names.variant_clusters(table).count() == 8
