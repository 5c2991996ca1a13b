from pyspark.sql import functions as F

from scriptorium import session
from scriptorium.sources import readers, sinks


def test_texts_and_reviews(spark, tmp_path):
    (tmp_path / "A_B_C_1800.txt").write_text(" Ein Text.\nZwei. ", encoding="utf-8")
    (tmp_path / "00007_1861_Blatt_rest.txt").write_text("Gut.", encoding="utf-8")
    (tmp_path / "note.md").write_text("no")
    assert {r.file_name for r in readers.texts(spark, str(tmp_path)).collect()} == {"A_B_C_1800", "00007_1861_Blatt_rest"}
    r = readers.reviews(spark, str(tmp_path)).where("text_id is not null").first()
    assert (r.text_id, r.pub_year, r.journal, r.text) == (7, 1861, "Blatt", "Gut.")


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b c",)], "s string")
    sinks.lines(df.coalesce(1), "s", str(tmp_path / "l"))
    assert [r.line for r in readers.lines(spark, str(tmp_path / "l")).orderBy("line_no").collect()] == ["a", "b c"]


def test_feature_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), (None, 2.0), ("a", None)], "file_name string, x double")
    sinks.results(df, str(tmp_path / "r"))
    assert {(r.file_name, r.x) for r in readers.features(spark, str(tmp_path / "r")).where("file_name is not null").collect()} >= {("b", 1.5), ("a", None)}
    sinks.classes(df, str(tmp_path / "c"))
    assert readers.separated(spark, str(tmp_path / "c"), "file_name string, x double").count() == 3


def test_latex(spark):
    t = spark.createDataFrame([("0", "0", 2), ("0", "All", 2), ("All", "0", 2), ("All", "All", 2)], "y_true string, y_pred string, n bigint")
    assert r"All & 2 & 2 \\" in sinks.latex(t)


def test_materialize(spark):
    df = session.materialize(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5
    session.discard(df, None)


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_white_space_and_token_lists(spark, tmp_path):
    from scriptorium.sources import sinks

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "A_B_C_1.txt").write_text("\t\u00a0 Text \r\n", encoding="utf-8")
    assert readers.texts(spark, str(tmp_path / "t")).first().text == "Text"
    df = spark.createDataFrame([(1, [["a", "b"], []])], "k int, t array<array<string>>")
    sinks.token_lists(df, "k", "t", str(tmp_path / "lists"))
    assert [tuple(r) for r in readers.token_lists(spark, str(tmp_path / "lists")).collect()] == [("1", [["a", "b"], []])]


def test_conll(spark, tmp_path):
    (tmp_path / "c.txt").write_text("The DT B-NP\ndog NN I-NP\n\nBarks VBZ B-VP\n", encoding="utf-8")
    got = {tuple(r.words): (r.tags, r.chunks) for r in readers.conll(spark, str(tmp_path / "c.txt")).collect()}
    assert got == {("The", "dog"): (["DT", "NN"], ["B-NP", "I-NP"]), ("Barks",): (["VBZ"], ["B-VP"])}
