"""Joins with keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def salted_join(rows: DataFrame, per_key: DataFrame, key: str, spread_by: list[str], salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row per key; the rows of a key are spread over ``salts`` tasks."""
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    spread = per_key.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(spread, [key, "__s"]).drop("__s")


def hashed_rank(rows: DataFrame, by: list[str], key: str, seed: int | str = "", out: str = "rank") -> DataFrame:
    """``rows`` with their rank, from 1, within the groups ``by`` in the order of the MD5 of key and seed. Ranks are told within
    the 256 parts that the hash's first byte makes of a group, so that no task orders a whole group. Keys are unique in a group."""
    h = rows.withColumn("__hash", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("__byte", F.substring("__hash", 1, 2))
    before = h.groupBy(*by, "__byte").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__byte")) - F.col("__n")).drop("__n")
    ranked = h.withColumn("__place", F.row_number().over(Window.partitionBy(*by, "__byte").orderBy("__hash")))
    return ranked.join(before, [*by, "__byte"]).withColumn(out, F.col("__place") + F.col("__before")).drop("__hash", "__byte", "__place", "__before")
