import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import stats
from scriptorium.operators import chunker, describe, features, folds, geometry, joins, labels, metrics, models, sentiment


def test_majority_tie_and_numbers(spark):
    df = spark.createDataFrame([("a", "negative"), ("a", "not_classified"), ("b", "positive"), ("b", "negative"), ("c", "positive"), ("c", None)], "f string, c string")
    got = {r.f: r.c for r in labels.majority(df, "f", "c").collect()}
    assert got["a"] == "not_classified" and got["c"] == "positive"
    assert {r.f for r in labels.undisputed(df, "f", "c").select("f").distinct().collect()} == {"a", "c"}


def test_library_label(spark):
    df = spark.createDataFrame([(None,), (0,), (3,)], "sum_libraries int")
    assert [r.y for r in labels.library_label(df).collect()] == [1, 0, 1]


def test_confusion_of_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0), (1, 1.0), (0, -1.0)], "c int, s double")
    assert tuple(sentiment.confusion(df, "c", "s").first()) == (1, 1, 1, 1)


def test_first_quartile(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0), (4, 9.0)], "k int, s double")
    got = {r.k: r.classified for r in sentiment.quartile_classes(df, "k", "s", 1.0, 1.0).collect()}
    assert got == {1: "not_classified", 2: "positive", 3: "positive", 4: "positive"}  # 1.75


def test_harmonic_p(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.0), ("b", 0.2)], "g string, p double")
    got = {r.g: r.harmonic_pvalue for r in metrics.harmonic_p_values(df, ["g"], "p").collect()}
    assert math.isclose(got["a"], 2 / 15) and got["b"] is None


def test_correlation_p():
    for n, r in ((10, 0.6319), (20, 0.4438), (30, 0.3610)):  # the textbook's 5 % values
        assert abs(stats.correlation_p(r, n) - 0.05) < 1e-4
    assert stats.correlation_p(None, 9) is None and stats.correlation_p(0.5, 2) is None and stats.correlation_p(1.0, 9) == 0.0


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0)], "f int, y_true double, y_pred double")
    r = metrics.regression_scores(df, ["f"]).first()
    assert r["corr"] is None and r.r2 is None and r.n == 2


def test_geometry(spark):
    v = spark.createDataFrame([("a", 1, [0.0, 0.0]), ("a", 2, [2.0, 0.0]), ("b", 3, [1.0, 5.0]), ("c", 4, None), ("c", 5, [float("nan"), 1.0])], "g string, k bigint, v array<float>")
    assert {r.g: r.s for r in geometry.stepwise(v, "g", "k", "v", "s").collect()} == {"a": 2.0, "b": 0.0}
    assert {r.g: r.s for r in geometry.spread(v, "g", "v", "s").collect()} == {"a": 1.0, "b": 0.0}
    assert {r.g: r.s for r in geometry.overlap(v, "g", "k", "v", "s").collect()} == {"a": 0.0, "b": 0.0}
    assert {r.g: r.s for r in geometry.outlier(v, "g", "v", "s").collect()} == {"a": 5.0, "b": 5.0}
    assert geometry.outlier(v.where("g = 'b'"), "g", "v", "s").first().s is None


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.dictionaries(st.sampled_from("01"), st.integers(1, 30), min_size=1), min_size=1, max_size=30), st.booleans())
def test_placing_is_whole(units, stratified):
    members = {k: 1 + len(k) * 7 for k in units}
    got = folds._place(units, 3, stratified, members)
    assert {k: sum(n for _, n in runs) for k, runs in got.items()} == members
    assert {f for runs in got.values() for f, _ in runs} <= {0, 1, 2}


def test_group_folds(spark):
    df = spark.createDataFrame([(f"a{i % 7}", i % 2) for i in range(70)] + [(None, 1)], "author string, y int")
    for label in (None, "y"):
        got = folds.group_folds(df, "author", 5, label)
        assert got.count() == 7 == got.select("author").distinct().count()


def test_upsampling(spark):
    df = spark.createDataFrame([("x", i) for i in range(7)] + [("y", i) for i in range(3)], "l string, k bigint")
    assert {r.l: r["count"] for r in folds.upsampled(df, "l", "k").groupBy("l").count().collect()} == {"x": 7, "y": 7}


def test_features(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, float("nan"))], "file_name string, chunk_id int, pos_x double")
    assert {r.file_name: r.pos_x for r in features.chunk_means(df, "file_name").collect()} == {"a": 1.0, "b": None}
    assert features.without(df, ["pos"]).columns == ["file_name", "chunk_id"]
    with pytest.raises(TypeError):
        features.without(df, "pos")
    with pytest.raises(ValueError):
        features.unique(df, ["file_name"])


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "j", "y")], "i int, j string, v string")
    b = spark.createDataFrame([(1, None, "p"), (3, "j", "q")], "i int, j string, v string")
    got = sorted((r.i, r.v, r.v_right) for r in labels.null_safe_outer(a, b, ["i", "j"]).collect())
    assert got == [(1, "x", "p"), (2, "y", None), (3, None, "q")]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)] + [(None,)], "x double")
    got = {r.bin: r.n for r in describe.histogram(df, "x", 30).collect()}
    assert sum(got.values()) == 31 and got[30] == 2 and max(got) == 30
    assert {r.bin: r.n for r in describe.histogram(df.where("x = 3"), "x", 30).collect()} == {1: 1}


def test_grid_and_tasks():
    assert models.grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    assert sum(len(c) for c in models.task("regression").candidates.values()) == 49
    assert sum(len(c) for c in models.task("binary", testing=True).candidates.values()) == 2


def test_evaluation_choice(spark):
    df = spark.createDataFrame([("a", 0.9, 0.5), ("a", 0.4, 0.01), ("b", 0.9, 0.5), ("b", 0.1, 0.3)], "g string, m double, p double")
    got = {r.g: r.m for r in metrics.evaluation_choice(df, ["g"], "m", "p").collect()}
    assert got == {"a": 0.4, "b": 0.1}
    assert {r.g: r.m for r in metrics.refit_choice(df, ["g"], "m", "p", tie="m").collect()} == {"a": 0.4, "b": 0.9}


def test_affinity_clusters():
    import pandas as pd

    pts = pd.DataFrame({"word": list("abcdef"), "vector": [[0, 0], [0, 0.1], [0.1, 0], [5, 5], [5, 5.1], [5.1, 5]]})
    got = sentiment.affinity_clusters(pts)
    assert got.groupby("cluster")["word"].apply(lambda s: "".join(s)).tolist() == ["abc", "def"]


def test_combined(spark):
    df = spark.createDataFrame([("positive", 1.0, 3.0), ("negative", 1.0, 3.0), ("not_classified", 1.0, 3.0), ("odd", 1.0, 3.0)], "c string, p double, l double")
    assert [r[0] for r in df.select(labels.combined_score(F.col("c"), F.col("p"), F.col("l"))).collect()] == [1.0, 3.0, 2.0, None]


def test_words_of_english_however_written(spark):
    from scriptorium.functions import text as tx

    rows = [("en", "x"), ("EN", "x"), ("eng", "x"), ("en-GB", "x"), (None, "the end of the day"), ("", "that and the other"), ("de", "the end of"), (None, "das Ende der Zeit"), (None, "x")]
    df = spark.createDataFrame(rows, "lang string, text string").select("lang", tx.tokens(tx.normalised(F.col("text"))).alias("words"))
    assert [bool(r[0]) for r in df.select(tx.is_english(F.col("lang"), F.col("words"))).collect()] == [True] * 6 + [False] * 3


def test_affinity_takes_seeds_and_neighbours(spark, tmp_path):
    from scriptorium.plans import catalog

    # over 300 words sort before the seeds, in texts whose language is written in several ways
    filler = [f"aa{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(330)]
    rows = [(i, f"a worthy tale with fine wit and terrible tedium {' '.join(filler[i % 11 :: 11])}", ["EN", "eng", "en-GB"][i % 3], "s", "review", 1800) for i in range(66)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, genre string, pub_year int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    words = {w for r in catalog.affinity_clusters(spark, str(tmp_path)).collect() for w in r.words.split()}
    seeds = {"worthy", "fine", "wit", "terrible", "tedium"}
    assert seeds <= words and len(words) <= 3 * len(seeds)


def test_nested_cv_is_registered_in_full(spark, tmp_path, monkeypatch):
    import inspect

    from scriptorium.plans import catalog

    rows = [(i, f"The old garden, the tower and house {i}. It was so then, as it is now.", "en", f"s{i}", "review", 1800) for i in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, genre string, pub_year int").write.parquet(str(tmp_path / "documents.parquet"))
    seen, form = {}, inspect.signature(models.nested)

    def nested(*args, **named):
        bound = form.bind(*args, **named)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return args[0], None

    monkeypatch.setattr(models, "nested", nested)
    catalog.nested_cv(spark, str(tmp_path))
    assert (seen["outer"], seen["inner"], seen["testing"]) == (5, 5, False) and len(seen["columns"]) > 4
    assert {t for c, t in seen["data"].dtypes if c in seen["columns"]} <= {"double", "bigint", "int", "float"}


def test_many_groups_of_a_kind(spark, monkeypatch):
    df = spark.createDataFrame([(f"a{i}",) for i in range(300)] + [("big",)] * 40, "author string")
    whole = folds.group_folds(df, "author", 5).join(df, "author").groupBy("fold").count().collect()
    assert {r["count"] for r in whole} == {68}
    monkeypatch.setattr(folds, "STEPS", 20)
    coarse = folds.group_folds(df, "author", 5).join(df, "author").groupBy("fold").count().collect()
    assert len(coarse) == 5 and max(r["count"] for r in coarse) - min(r["count"] for r in coarse) <= 15


def test_hashed_rank(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(1000)], "g int, k bigint")
    got = joins.hashed_rank(df, ["g"], "k", 8).collect()
    for g in range(3):
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(1, len([1 for i in range(1000) if i % 3 == g]) + 1))


def test_trained_chunker(spark):
    rows = [(["DET", "ADJ", "NOUN", "VERB"], ["B-NP", "I-NP", "I-NP", "B-VP"]), (["NOUN", "VERB", "DET", "NOUN", "ADP"], ["B-NP", "B-VP", "B-NP", "I-NP", "O"])] * 3
    df = spark.createDataFrame(rows, "tags array<string>, chunks array<string>")
    model = chunker.train(df)
    out = df.select("chunks", chunker.chunk_tags(F.col("tags"), model).alias("c"), "tags")
    assert all(r.c == r.chunks for r in out.collect())
    first = out.select(chunker.productions(F.col("tags"), F.col("c")).alias("p")).first().p
    assert first == ["NP->DET_ADJ_NOUN", "VP->VERB", "S->NP_VP"]
    assert chunker.train(df.limit(0)) == {}


def test_dataset_tasks(spark):
    x = spark.createDataFrame([("Tieck_Ludwig_Adbdallah_1792", 1.0), ("b", 2.0), ("c", 3.0)], "file_name string, f double")
    y = spark.createDataFrame([("Tieck_Ludwig_Abdallah_1792", 3), ("b", 1)], "file_name string, y int")
    years = spark.createDataFrame([("Tieck_Ludwig_Abdallah_1792", 1792), ("b", 1902), ("c", 1784)], "file_name string, pub_year int")
    of = lambda task: {(r.file_name, r.y) for r in labels.dataset(x, y, task, "ger", years).collect()}
    assert of("regression") == {("b", 1)}
    assert of("library") == {("Tieck_Ludwig_Adbdallah_1792", 3), ("c", 0)}
    assert of("multiclass") == {("Tieck_Ludwig_Adbdallah_1792", 3), ("b", 1)}


def test_selected_and_reduced_features(spark):
    df = spark.createDataFrame([(float(i), float(i % 5), float(-i), i % 2) for i in range(40)], "a double, b double, c double, y int")
    from pyspark.ml.regression import LinearRegression

    fitted = models.pipeline(["a", "b", "c"], models.estimator("regression", "lasso", {"share": 0.01, "steps": 10}), components=2, percentile=0.9).fit(df.withColumn("y", F.col("a") * 2))
    assert isinstance(models.estimator("regression", "lasso", {"share": 0.01, "steps": 10}), LinearRegression)
    assert fitted.transform(df).select("features").first()[0].size == 2


def test_evaluation_bundle(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(30)], "row_id int, y_true int, y_pred int")
    got = metrics.evaluation(df)
    assert {r.baseline for r in got["baselines"].collect()} == set(metrics.BASELINES) and got["scores"].count() == 1
    assert {r.metric for r in metrics.scored(df, "library").collect()} == {"balanced_accuracy"}


def test_overlap_of_many_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, f"g{i % 7}", (rng.standard_normal(4) + (i % 7) / 2).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, g string, v array<double>")
    x, g = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    want = {}
    for name in sorted(set(g)):
        near = np.argsort(np.sqrt(((x - x[g == name].mean(axis=0)) ** 2).sum(axis=1)), kind="stable")[: (g == name).sum()]
        want[name] = float((g[near] != name).mean())
    assert {r.g: r.overlap_score for r in geometry.overlap(df, "g", "k", "v").collect()} == want


def test_learners_fit_what_is_not_linear():
    import numpy as np

    from scriptorium.operators import learners

    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3))
    circle, three = ((x[:, 0] ** 2 + x[:, 1] ** 2) > 1.4).astype(float), np.digitize(x[:, 0] * x[:, 1], [-0.3, 0.3]).astype(float)
    curve = np.sin(2 * x[:, 0]) + 0.3 * x[:, 1]
    for make in (lambda k: learners.KernelMachine(k, 10.0, 0.01), lambda k: learners.BoostedTrees(k, 4, 0.1, 0.75)):
        for kind, y in (("binary", circle), ("multiclass", three), ("regression", curve)):
            got = learners.scores(kind, y[300:], make(kind).fit(x[:300], y[:300]).predict(x[300:]))
            assert (got["corr"] if kind == "regression" else got["f1_macro"]) > 0.7
    one = learners.BoostedTrees("binary", 2, 0.1, 1.0).fit(x[:5], np.ones(5)).predict(x[:3])
    assert one.tolist() == [1.0] * 3
    assert learners.scores("regression", np.ones(4), np.ones(4)) == {"corr": None, "corr_pvalue": None}


def test_nested_in_tasks_and_by_spark(spark, monkeypatch):
    rows = [(i, f"g{i % 12}", i % 2, float(i % 2) + (i % 7) / 10, float(i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, g string, y int, a double, b double")
    pred, results = models.nested(df, "k", "g", ["a", "b"], "binary", outer=2, inner=2, testing=True)
    assert pred.count() == 120 and results.count() == 2 * 2 * 2
    assert pred.where("y = prediction").count() > 100
    monkeypatch.setattr(models, "ONE_TASK", 0)
    pred, results = models.nested(df, "k", "g", ["a", "b"], "binary", outer=2, inner=2, testing=True)
    assert pred.count() == 120 and results.count() == 2 * 2 * 2


def test_nested_is_the_same_at_any_size(spark, monkeypatch):
    rows = [(i, f"g{i % 12}", i % 2, float(i % 2) + (i % 7) / 3, float(i * i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, g string, y int, a double, b double")
    got = []
    for numbers in (models.ONE_TASK, 500, 0):  # a table of 600 numbers
        monkeypatch.setattr(models, "ONE_TASK", numbers)
        pred, results = models.nested(df, "k", "g", ["a", "b"], "binary", outer=2, inner=2, testing=True)
        got.append((sorted(map(tuple, pred.collect())), sorted(map(str, results.collect()))))
    assert got[0] == got[1] == got[2] and len(got[0][0]) == 120


def test_kernel_machine_needs_no_kernel_matrix(monkeypatch):
    import tracemalloc

    import numpy as np

    from scriptorium.operators import learners

    x = np.random.default_rng(5).standard_normal((2_000, 3))
    tracemalloc.start()
    got = learners.KernelMachine("binary", 0.1, keep=0).fit(x, (x[:, 0] > 0).astype(float)).predict(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000 < 8 * 2_000 * 2_000 and ((x[:, 0] > 0) == got).mean() > 0.95


def test_grams_of_a_length_are_counted_once(spark):
    from scriptorium.operators import stylometry

    df = spark.createDataFrame([(1, 0, ["The old garden.", "The old tower."]), (2, 0, ["?!?!"])], "doc_id int, chunk_id int, sentences array<string>")
    got = stylometry.all_features(df, ["doc_id"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 3
    row = {r.doc_id: r for r in got.collect()}
    assert (row[1].tokens, row[1].types, row[2].tokens) == (6, 4, None) and row[1].ratio_of_unique_bigrams == 7 / 9
