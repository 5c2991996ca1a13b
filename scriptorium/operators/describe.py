"""Descriptive series: histograms over years, shares, distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as tx


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n) of values that are not null."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def year_series(spark: SparkSession, first: int, last: int, series: dict[str, DataFrame]) -> DataFrame:
    """A row per year from first to last and per year outside that a series holds; 0 where a series has none. Series are
    (year, n)."""
    out = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    for name, s in series.items():
        out = out.join(s.select("year", F.col("n").alias(name)), "year", "full_outer")
    return out.na.fill(0, list(series))


def share(df: DataFrame, flag: str, out: str = "percentage") -> DataFrame:
    """One row: percentage of rows with a true flag."""
    return df.agg((F.avg(F.when(F.col(flag), 1.0).otherwise(0.0)) * 100).alias(out))


def distinct_ratio(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: distinct values of ``a`` that occur in ``b``, distinct values of ``a``, and the percentage."""
    d = a.where(F.col(column).isNotNull()).select(column).distinct()
    hit = d.join(b.where(F.col(column).isNotNull()).select(column).distinct().withColumn("__h", F.lit(1)), column, "left")
    return hit.agg(F.count("__h").alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("percentage", 100 * tx.ratio(F.col("matched"), F.col("total")))


def mean_with_gaps(df: DataFrame, column: str, out: str = "mean") -> DataFrame:
    """One row: sum over all rows divided by their number, unknown values counting as 0 in the sum."""
    return df.agg(tx.ratio(F.coalesce(F.sum(column), F.lit(0)), F.count(F.lit(1))).alias(out))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n) over equal bins between the least and greatest value; the greatest falls into the last bin."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col("x") - F.col("lo")) / F.try_divide(F.col("hi") - F.col("lo"), F.lit(float(bins)))) + 1))
    return x.join(F.broadcast(ends)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # ends is one row
