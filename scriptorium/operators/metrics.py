"""Scores of predictions, choice of models, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import stats
from scriptorium.functions import text as tx


def regression_scores(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """By group: n, Pearson r, its p-value, R2, RMSE and MAE; null where undefined."""
    t, q = F.col(y).cast("double"), F.col(p).cast("double")
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), stats.correlation(t, q).alias("corr"), F.sum((t - q) * (t - q)).alias("__e"), (F.var_pop(t) * F.count(t)).alias("__v"), F.avg(F.abs(t - q)).alias("mae"),
    )
    pv = F.udf(stats.correlation_p, "double")  # one call per group
    return agg.select(*by, "n", "corr", pv("corr", F.col("n").cast("int")).alias("corr_pvalue"), (1 - F.try_divide(F.col("__e"), F.col("__v"))).alias("r2"), F.sqrt(F.col("__e") / F.col("n")).alias("rmse"), "mae")


def confusion_table(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(y_true, y_pred, n) with margins, written All."""
    t = df.select(F.col(y).cast("string").alias("y_true"), F.col(p).cast("string").alias("y_pred"))
    cube = t.cube("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"), F.grouping("y_true").alias("gt"), F.grouping("y_pred").alias("gp"))
    return cube.select(F.when(F.col("gt") == 1, "All").otherwise(F.col("y_true")).alias("y_true"), F.when(F.col("gp") == 1, "All").otherwise(F.col("y_pred")).alias("y_pred"), "n")


def class_report(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(class, precision, recall, f1, support) over all true and predicted classes; 0 where a share is undefined."""
    true = df.groupBy(F.col(y).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("support"), F.sum(F.when(F.col(y) == F.col(p), 1).otherwise(0)).alias("tp"))
    pred = df.groupBy(F.col(p).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("said"))
    j = true.join(pred, "class", "full_outer").na.fill(0, ["support", "tp", "said"])
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "class", z(tx.ratio(F.col("tp"), F.col("said"))).alias("precision"), z(tx.ratio(F.col("tp"), F.col("support"))).alias("recall"),
        z(tx.ratio(2 * F.col("tp"), F.col("said") + F.col("support"))).alias("f1"), "support",
    )


def class_scores(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """One row: accuracy, balanced accuracy, macro and weighted F1."""
    report = class_report(df, y, p)
    hit = df.agg(F.avg(F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0)).alias("accuracy"))
    s = report.agg(
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("f1_macro"),
        tx.ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )
    return hit.join(F.broadcast(s))  # one row


def harmonic_p_values(splits: DataFrame, by: list[str], p: str = "pvalue") -> DataFrame:
    """(by, harmonic_pvalue) over cross-validation splits."""
    return splits.groupBy(*by).agg(stats.harmonic_p(F.col(p)).alias("harmonic_pvalue"))


def refit_choice(results: DataFrame, by: list[str], metric: str, p: str = "harmonic_pvalue", threshold: float = 0.1, tie: str = "combo_id") -> DataFrame:
    """One row per group: the best metric among significant rows, else the best metric of all; first of equals."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.when(F.col(p) < threshold, 1).otherwise(0)), F.desc_nulls_last(metric), tie))
    return results.withColumn("__r", rank).where("__r = 1").drop("__r")


def evaluation_choice(results: DataFrame, by: list[str], metric: str, p: str = "harmonic_pvalue", threshold: float = 0.1) -> DataFrame:
    """The best rows per group, all of equals: the best metric among significant rows, else the least p-value."""
    w = Window.partitionBy(*by)
    some = F.max(F.when(F.col(p) < threshold, 1).otherwise(0)).over(w)
    value = F.when(F.col("__some") == 1, F.when(F.col(p) < threshold, F.col(metric))).otherwise(-F.col(p))
    return results.withColumn("__some", some).withColumn("__v", value).withColumn("__b", F.max("__v").over(w)).where("__v = __b").drop("__some", "__v", "__b")


def best_feature_level(best: DataFrame, level: str, fold: str, metric: str) -> DataFrame:
    """(level, mean) of the feature level whose best models score best, one row per fold."""
    once = best.groupBy(level, fold).agg(F.max(metric).alias("m"))
    means = once.groupBy(level).agg(F.avg("m").alias("mean_inner_score"))
    return means.orderBy(F.desc("mean_inner_score"), level).limit(1)


def draw(key, seed: int, salt: int):
    """A number in [0, 1) that depends on key, seed and salt only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(salt)))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


BASELINES = ("all_zero", "uniform", "by_frequency", "two_largest", "three_largest")


def baselines(df: DataFrame, y: str = "y_true", key: str = "row_id", seed: int = 8) -> DataFrame:
    """``df`` with random predictions: all 0, uniform over the classes, by class frequency, and by given shares of the three
    largest classes (1/2, 1/4, 1/4) and of the two largest (1/2, 1/2). A row's draws depend on its key and the seed only.
    Classes stand in an array of one row; a draw is looked up in the array of their summed shares."""
    counts = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "c"))).alias("o"))  # a row per class
    cs = ordered.select(F.transform("o", lambda x: x["c"]).alias("__c"), F.transform("o", lambda x: -x["m"]).alias("__n"))
    upto = lambda shares: F.transform(F.sequence(F.lit(1), F.greatest(F.size(shares), F.lit(1))), lambda i: F.aggregate(F.slice(shares, 1, i), F.lit(0.0), lambda s, x: s + x))
    equal = F.transform("__n", lambda x: F.lit(1.0) / F.size("__n"))
    whole = F.aggregate("__n", F.lit(0).cast("bigint"), lambda s, x: s + x)
    shares = {"uniform": equal, "by_frequency": F.transform("__n", lambda x: x.cast("double") / whole), "two_largest": F.array(F.lit(0.5), F.lit(0.5)), "three_largest": F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))}
    bounds = cs.select("__c", *(upto(v).alias(f"__{k}") for k, v in shares.items()))
    j = df.join(F.broadcast(bounds)).withColumn("all_zero", F.lit(0))  # one row
    for salt, name in enumerate(shares, 1):
        u = draw(key, seed, salt)
        at = F.size(F.filter(f"__{name}", lambda b: b <= u)) + 1
        j = j.withColumn(name, F.get("__c", F.least(at, F.size("__c")) - 1))
    return j.drop("__c", *(f"__{k}" for k in shares))


def baseline_scores(predicted: DataFrame, y: str = "y_true") -> DataFrame:
    """(baseline, accuracy, balanced_accuracy, f1_macro, f1_weighted) of the predictions that ``baselines`` adds."""
    out = None
    for name in BASELINES:
        one = class_scores(predicted, y, name).withColumn("baseline", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def scored(df: DataFrame, task: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(metric, value): the metrics of a task, rounded to three digits."""
    if task == "regression":
        s, names = regression_scores(df, [], y, p), ["corr", "corr_pvalue"]
    else:
        s, names = class_scores(df, y, p), ["balanced_accuracy"] if task in ("binary", "library") else ["f1_macro", "f1_weighted"]
    return s.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.bround(n, 3))))).alias("metric", "value"))


def evaluation(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> dict[str, DataFrame]:
    """What is written about a classification: table with margins, report by class, scores, and scores of the baselines."""
    return {"crosstab": confusion_table(df, y, p), "report": class_report(df, y, p), "scores": class_scores(df, y, p), "baselines": baseline_scores(baselines(df, y), y)}


def axis_limits(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(by, least, greatest, limit) over true and predicted values; limit is the greatest magnitude of all groups."""
    ends = df.groupBy(*by).agg(F.least(F.min(y), F.min(p)).alias("least"), F.greatest(F.max(y), F.max(p)).alias("greatest"))
    most = ends.agg(F.max(F.greatest(F.abs("least"), F.abs("greatest"))).alias("limit"))
    return ends.join(F.broadcast(most))  # one row


def from_counts(counts: DataFrame, label: str, n: str = "n") -> DataFrame:
    """A row per counted label."""
    return counts.where(F.col(n) > 0).select(F.explode(F.array_repeat(F.col(label), F.col(n).cast("int"))).alias(label))


def positional(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two files joined by fold and row number."""
    return a.join(b, keys, "full_outer")
