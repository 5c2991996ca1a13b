"""Labels of books from reviews and libraries, and data sets joined from features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_outer(a: DataFrame, b: DataFrame, keys: list[str], suffix: str = "_right") -> DataFrame:
    """Full outer join in which null keys meet; columns that clash get a suffix on the right side."""
    r = b.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in b.columns))
    cond = None
    for k in keys:
        c = a[k].eqNullSafe(r[f"__{k}"])
        cond = c if cond is None else cond & c
    j = a.withColumn("__l", F.lit(1)).join(r.withColumn("__r", F.lit(1)), cond, "full_outer")
    left = F.col("__l").isNotNull()
    out = [F.when(left, F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys]
    out += [F.col(f"`{c}`") for c in a.columns if c not in keys]
    out += [F.col(f"__{c}").alias(c + suffix if c in a.columns else c) for c in b.columns if c not in keys]
    return j.select(*out)


def library_label(df: DataFrame, count: str = "sum_libraries", out: str = "y") -> DataFrame:
    """1 for any count but 0; an unknown count is 1."""
    return df.withColumn(out, F.when(F.col(count).isNull() | (F.col(count) != 0), 1).otherwise(0))


def group_mean(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Each row with the mean of its group."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(group)))


def combined_score(cls: Column, polarity: Column, lexicon: Column) -> Column:
    """Score by class: polarity of positive, lexicon score of negative, their mean for others; null for a strange class."""
    return F.when(cls == "positive", polarity).when(cls == "negative", lexicon).when(cls == "not_classified", (polarity + lexicon) / 2)


def class_number(cls: Column) -> Column:
    return F.when(cls == "negative", 1).when(cls == "not_classified", 2).when(cls == "positive", 3)


def undisputed(df: DataFrame, group: str, cls: str) -> DataFrame:
    """Rows of groups that do not hold both positive and negative classes."""
    w = Window.partitionBy(group)
    has = lambda c: F.max(F.when(F.col(cls) == c, 1).otherwise(0)).over(w)
    return df.withColumn("__p", has("positive")).withColumn("__n", has("negative")).where("__p + __n < 2").drop("__p", "__n")


def majority(df: DataFrame, group: str, cls: str) -> DataFrame:
    """(group, cls): a group's commonest class, the last in alphabet among equals."""
    counts = df.where(F.col(cls).isNotNull()).groupBy(group, cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.max_by(cls, F.struct("n", cls)).alias(cls))


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).where("__r = 1").drop("__r")


def labelled(features: DataFrame, labels: DataFrame, key: str, y: str = "y") -> DataFrame:
    """Feature rows that have a label (inner, many to one)."""
    return features.join(labels.select(key, y), key)


def labelled_or_zero(features: DataFrame, labels: DataFrame, key: str, y: str = "y") -> DataFrame:
    """All feature rows, label 0 where there is none."""
    return features.join(labels.select(key, y), key, "left").withColumn(y, F.coalesce(y, F.lit(0)))


def unlabelled(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Feature rows without a label."""
    return features.join(labels.select(key), key, "left_anti")


def within_years(df: DataFrame, year: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of years within bounds; unknown years are out if there is a bound."""
    if first is not None:
        df = df.where(F.col(year) >= first)
    return df if last is None else df.where(F.col(year) <= last)


def renamed_values(c: Column, aliases: dict[str, str]) -> Column:
    """A column with some values replaced by others."""
    if not aliases:
        return c
    m = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(m, c), c)


def label_table(kind: str, reviews: DataFrame | None = None, libraries: DataFrame | None = None, canon: DataFrame | None = None) -> DataFrame:
    """(file_name, y) by kind: canon, library, polarity, lexicon, combined, multiclass or binary. ``reviews`` has file_name,
    classified, polarity and lexicon; ``libraries`` file_name and sum_libraries; ``canon`` file_name and m3."""
    if kind == "canon":
        return canon.select("file_name", F.col("m3").alias("y"))
    if kind == "library":
        return library_label(libraries).select("file_name", "y")
    if kind in ("polarity", "lexicon"):
        return reviews.groupBy("file_name").agg(F.avg(kind).alias("y"))
    if kind == "combined":
        score = combined_score(F.col("classified"), F.col("polarity"), F.col("lexicon"))
        return reviews.withColumn("s", score).groupBy("file_name").agg(F.avg("s").alias("y"))
    if kind == "multiclass":
        return majority(undisputed(reviews, "file_name", "classified"), "file_name", "classified").select("file_name", class_number(F.col("classified")).alias("y"))
    if kind == "binary":
        return reviews.select("file_name", F.lit(1).alias("y")).distinct()
    raise ValueError(f"no such label: {kind}")


# Names of books that the sources write in two ways, new to old, and of authors, alias to author.
BOOK_ALIASES = {
    "Moerike_Eduard_Maler-Nolten_1836": "Moerike_Eduard_Maler-Bolten_1836",
    "Storm_Theodor_Immensee_1850": "Storm_Theodor_Immersee_1850",
    "Tieck_Ludwig_Abdallah_1792": "Tieck_Ludwig_Adbdallah_1792",
    "Hoffmansthal_Hugo_Reitergeschichte_1899": "Hoffmansthal_Hugo-von_Reitergeschichte_1899",
    "Fontane_Theodor_Die-Poggenpuhls_1896": "Fontane_Theodor_Die-Poppenpuhls_1896",
    "Schoenherr_Karl_Allerhand-Kreuzkoepf_1895": "Schoenherr_Karl_Allerhand-Krezkoepf_1895",
    "Hunold_Christian-Friedrich_Die-liebenswuerdige-Adalie_1702": "Hunold_Christian-Friedrich_Die-liebenswuerdige-Adalie_1681",
}
AUTHOR_ALIASES = {
    "Hoffmansthal_Hugo-von": "Hoffmansthal_Hugo",
    "Holz-Schlaf_Arno-Johannes": "Schlaf_Johannes",
    "Arnim-Arnim_Bettina-Gisela": "Arnim_Bettina",
    "Stevenson-Grift_Robert-Louis-Fanny-van-de": "Stevenson_Robert-Louis",
    "Stevenson-Osbourne_Robert-Louis-Lloyde": "Stevenson_Robert-Louis",
}
# Years of the first and last review, and of the last library catalogue, by language.
YEARS = {"eng": (1771, 1914, 1907), "ger": (1785, 1915, 1901)}


def dataset(features: DataFrame, labels: DataFrame, task: str, language: str, years: DataFrame | None = None, key: str = "file_name") -> DataFrame:
    """Feature rows with their label ``y``. Regression keeps the rows that have a label. The other tasks keep all rows, 0 for
    those without, whose year in ``years`` (key, pub_year) lies within the bounds of language and task; book names of labels
    and years are brought to those of the features. A book has one label and one year, or an error is raised by the caller's
    own check of uniqueness; a row whose year is unknown is out."""
    if task == "regression":
        return labelled(features, labels, key)
    aliased = lambda df: df.withColumn(key, renamed_values(F.col(key), BOOK_ALIASES))
    rows = labelled_or_zero(features, aliased(labels), key).join(aliased(years).select(key, F.col("pub_year").alias("__year")), key, "left")
    first, last, library = YEARS[language]
    kept = within_years(rows, "__year", None, library) if task == "library" else within_years(rows, "__year", first, last)
    return kept.drop("__year")


def frame_of(spark, values: dict, key: str = "key", value: str = "value") -> DataFrame:
    """A dictionary as a two-column frame, in the order of its keys' rows."""
    return spark.createDataFrame([(k, v) for k, v in values.items()], [key, value]) if values else spark.createDataFrame([], f"{key} string, {value} string")


def fold_shapes(rows: DataFrame, fold: str, key: str) -> DataFrame:
    """(fold, part, n_rows, n_keys): size of each fold's train and test part, with and without repeated keys. Train sizes are
    the whole less the fold, so that no row is copied into every fold; keys in two folds count in both."""
    per = rows.groupBy(fold, key).agg(F.count(F.lit(1)).alias("n"))
    test = per.groupBy(fold).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    spread_ = per.groupBy(key).agg(F.count(F.lit(1)).alias("folds"), F.min(fold).alias(fold))
    only = spread_.where("folds = 1").groupBy(fold).agg(F.count(F.lit(1)).alias("only"))
    whole = rows.agg(F.count(F.lit(1)).alias("all_rows"), F.countDistinct(key).alias("all_keys"))
    t = test.join(only, fold, "left").join(F.broadcast(whole))  # whole is one row
    train = t.select(fold, F.lit("train").alias("part"), (F.col("all_rows") - F.col("n_rows")).alias("n_rows"), (F.col("all_keys") - F.coalesce("only", F.lit(0))).alias("n_keys"))
    return train.unionByName(t.select(fold, F.lit("test").alias("part"), "n_rows", "n_keys"))
