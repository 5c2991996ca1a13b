import numpy as np

from scriptorium.llm import neighbours


def brute(rows, k=5):
    ok = {key: np.array(v, np.float32).astype(float) for key, v in rows if v is not None and np.isfinite(np.array(v, float)).all()}
    out = set()
    for a, x in ok.items():
        near = sorted((((x - y) ** 2).sum(), b) for b, y in ok.items() if b != a)[:k]
        out |= {(min(a, b), max(a, b)) for _, b in near}
    return out


def run(spark, rows, extra=()):
    df = spark.createDataFrame([(k, v, "e") for k, v in [*rows, *extra]], "key bigint, v array<float>, vec string")
    table = neighbours.vector_table([(df, "key", "v")])
    return {(r.key_a, r.key_b) for r in neighbours.nearest_pairs(table).collect()}


def test_ties_duplicates_and_gaps(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).round(3).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] * 6) for i in range(12)]  # equal vectors: ties go to the smaller key
    rows += [(200, None), (201, [float("nan")] * 6)]
    assert run(spark, rows, extra=rows[:5]) == brute(rows)


def test_few_and_none(spark):
    assert run(spark, [(1, [0.0, 1.0])]) == set()
    assert run(spark, [(1, [0.0, 1.0]), (2, [0.0, 2.0])]) == {(1, 2)}
    assert run(spark, [(1, None)]) == set()


def test_recall_over_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 12)) * 3
    rows = [(i, (centers[i % 40] + 0.1 * rng.standard_normal(12)).tolist()) for i in range(1200)]
    got, want = run(spark, rows), brute(rows)
    assert len(got & want) / len(want) >= 0.95


def test_tree_cuts_equal_vectors():
    t = neighbours.Tree(np.ones((100, 3), np.float32), 10, 1)
    assert t.leaves >= 4


def test_greedy_search(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((30, 12)) * 2
    rows = [(i, (centers[i % 30] + 0.2 * rng.standard_normal(12)).tolist()) for i in range(900)]
    table = neighbours.vector_table([(spark.createDataFrame(rows, "key bigint, v array<float>"), "key", "v")])
    got: dict[int, set] = {}
    for r in neighbours.search(neighbours.neighbour_graph(table), table.where("key % 50 = 0"), 5).collect():
        got.setdefault(r.q, set()).add(r.other)
    x = np.array([v for _, v in rows], np.float32).astype(float)
    hits = sum(len(got[q] & set(np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:5].tolist())) for q in range(0, 900, 50))
    assert hits / (18 * 5) >= 0.9


def test_search_finds_equal_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).round(3).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] * 6) for i in range(12)]
    table = neighbours.vector_table([(spark.createDataFrame(rows, "key bigint, v array<float>"), "key", "v")])
    got: dict[int, set] = {}
    for r in neighbours.search_keys(neighbours.neighbour_graph(table), table.where("key in (0, 7, 100, 103, 111)")).collect():
        got.setdefault(r.q, set()).add(r.other)
    x = {k: np.array(v, np.float32).astype(float) for k, v in rows}
    assert got == {q: {b for _, b in sorted((((x[q] - x[b]) ** 2).sum(), b) for b in x if b != q)[:5]} for q in (0, 7, 100, 103, 111)}


def test_full_leaves_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 40)
    monkeypatch.setattr(neighbours, "SAMPLE", 60)  # too few for small leaves, as 30,000 are for many million vectors
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * (1 + i % 3)).tolist()) for i in range(1500)]
    whole = run(spark, rows)
    monkeypatch.setattr(neighbours, "FULL", 80)
    monkeypatch.setattr(neighbours, "PART", 50)
    table = neighbours.vector_table([(spark.createDataFrame(rows, "key bigint, v array<float>"), "key", "v")])
    nodes, _, _ = neighbours.neighbour_graph(table)
    sizes = [r["n"] for r in nodes.selectExpr("explode(leaves) as leaf").groupBy("leaf").agg({"leaf": "count"}).withColumnRenamed("count(leaf)", "n").collect()]
    assert max(sizes) <= 80 and sum(sizes) == 3 * 1500
    want, got = brute(rows), run(spark, rows)
    assert len(got & want) / len(want) >= 0.97 and len(whole & want) / len(want) >= 0.97


def test_vectors_no_plane_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FULL", 50)
    monkeypatch.setattr(neighbours, "LEAF", 20)
    rows = [(i, [1e7 + (i % 2), 0.0, float(np.float32(1e-30) * i)]) for i in range(200)]
    table = neighbours.vector_table([(spark.createDataFrame(rows, "key bigint, v array<float>"), "key", "v")])
    nodes, _, _ = neighbours.neighbour_graph(table)
    assert nodes.count() == 200
    assert nodes.selectExpr("explode(leaves) as leaf").groupBy("leaf").count().agg({"count": "max"}).first()[0] <= 50


def test_lengths_do_not_mix(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0]), (4, [9.0]), (5, [0.0, 0.0, 0.0])]
    assert run(spark, rows) == {(1, 2), (3, 4)}
