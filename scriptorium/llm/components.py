"""Connected components of a graph given as an edge table.

Large-star and small-star steps alternate until no edge changes. Every step is an aggregation of minima, which are
combined before the shuffle, and one join of edges with minima, whose keys are salted so that a node with a third of
all edges is spread over tasks. Each step is written to the shared folder; nothing is collected but one checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import discard, materialize

SALTS = 8


def salted_join(rows: DataFrame, per_key: DataFrame, key: str, spread_by: str) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row per key. The rows of a key are spread over SALTS tasks."""
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    spread = per_key.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(spread, [key, "__s"]).drop("__s")


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return salted_join(edges, least, "u", "v").select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that occurs in ``edges`` (u, v), component being the least node reached.

    Nodes are of one comparable type. Edges with a null end are dropped, loops keep their node, repeated edges count
    once; an empty table gives an empty result.
    """
    clean = edges.where("u is not null and v is not null")
    now = materialize(clean.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u or u = v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.distinct()
        with_least = _least_neighbour(small)
        star = with_least.select(F.col("v").alias("u"), F.col("m").alias("v")).union(with_least.select("u", F.col("m").alias("v")))
        new = materialize(star.distinct(), "edges")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        discard(now)
        now = new
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
