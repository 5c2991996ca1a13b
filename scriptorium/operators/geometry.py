"""Geometry of embeddings: centroids, spread, steps, overlap and outliers of groups (books) of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import vectors as vx

#: Centroids that go to the executors at a time; more are done in blocks, one pass over the vectors per block.
BLOCK = 4096


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, n, centroid) over complete vectors; sums by position are combined before the shuffle."""
    rows = vectors.where(vx.complete(F.col(vec))).select(group, F.posexplode(vx.doubles(F.col(vec))).alias("i", "x"))
    mean = rows.groupBy(group, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def spread(vectors: DataFrame, group: str, vec: str, name: str = "intra_textual_variance") -> DataFrame:
    """(group, name): mean distance of a group's vectors from its centroid."""
    own = vectors.where(vx.complete(F.col(vec))).join(centroids(vectors, group, vec), group)
    return own.groupBy(group).agg(F.avg(vx.distance(F.col(vec), F.col("centroid"))).alias(name))


def stepwise(vectors: DataFrame, group: str, order: str, vec: str, name: str = "stepwise_distance") -> DataFrame:
    """(group, name): mean distance between consecutive vectors of a group, 0 for a single one."""
    w = Window.partitionBy(group).orderBy(order)
    step = vx.distance(F.col(vec), F.lag(vec).over(w))
    return vectors.where(vx.complete(F.col(vec))).withColumn("step", step).groupBy(group).agg(F.coalesce(F.avg("step"), F.lit(0.0)).alias(name))


def _blocks(cents: DataFrame, group: str) -> Iterator[tuple[list, list[int], np.ndarray]]:
    blocks = max(1, -(-cents.count() // BLOCK))
    for b in range(blocks):
        rows = cents.where(F.pmod(F.xxhash64(group), F.lit(blocks)) == b).collect()
        if rows:
            yield [r[group] for r in rows], [r["n"] for r in rows], np.array([r["centroid"] for r in rows])


def _bins(v: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Bin of the squared distance of each row of ``v`` from each row of ``matrix``: the float's exponent and eight bits more, so
    that bins are in the order of distances and each is 1/256 of its distance wide."""
    d = np.maximum((v * v).sum(axis=1)[:, None] + (matrix * matrix).sum(axis=1)[None] - 2 * (v @ matrix.T), 0.0)
    return d.view(np.int64) >> 44


def nearest_of_groups(vectors: DataFrame, group: str, key: str, vec: str) -> DataFrame:
    """(grp, n, d, owner, key): of each group the n vectors nearest to its centroid, n being the group's size. A first pass counts
    distances by bin, which tells a distance within which n vectors lie; a second one sends on only those, so that about as
    many rows meet as there are vectors."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = vectors.sparkSession
    rows = vectors.where(vx.complete(F.col(vec))).select(F.col(group).alias("owner"), F.col(key).alias("key"), vx.doubles(F.col(vec)).alias("v"))
    kinds = dict(rows.dtypes)
    owner_type, key_type = (to_arrow_type(rows.schema[c].dataType) for c in ("owner", "key"))
    arrow = pa.schema([("grp", owner_type), ("n", pa.int64()), ("d", pa.float64()), ("owner", owner_type), ("key", key_type)])
    schema = f"grp {kinds['owner']}, n bigint, d double, owner {kinds['owner']}, key {kinds['key']}"
    out = None
    for names, sizes, matrix in _blocks(centroids(vectors, group, vec), group):
        shared = spark.sparkContext.broadcast((names, sizes, matrix))

        def parts(batch: pa.RecordBatch, matrix: np.ndarray):
            v = np.array(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, matrix.shape[1]))
            for at in range(0, len(v), 512):
                yield at, v[at : at + 512], _bins(v[at : at + 512], matrix)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            _, _, matrix = shared.value
            total: dict[tuple[int, int], int] = {}
            for batch in batches:
                for _, _, b in parts(batch, matrix):
                    pairs, n = np.unique(b + (np.arange(len(matrix), dtype=np.int64) << 20)[None], return_counts=True)
                    for p, k in zip(pairs.tolist(), n.tolist()):
                        total[p] = total.get(p, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([p >> 20 for p in total], pa.int32()), pa.array([p & 0xFFFFF for p in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["c", "bin", "n"])

        counted = rows.select("v").mapInArrow(count, "c int, bin int, n bigint").groupBy("c", "bin").agg(F.sum("n").alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("c").orderBy("bin")))
        size = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "c int, size bigint")
        limits = {r.c: r.bin for r in upto.join(F.broadcast(size), "c").where(F.col("upto") >= F.col("size")).groupBy("c").agg(F.min("bin").alias("bin")).collect()}  # BLOCK rows
        bound = spark.sparkContext.broadcast(np.array([limits.get(i, 0xFFFFF) + 1 for i in range(len(names))]))  # a bin more, as products round

        def send(batches: Iterator[pa.RecordBatch], shared=shared, bound=bound) -> Iterator[pa.RecordBatch]:
            names, sizes, matrix = shared.value
            for batch in batches:
                owners, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                flat: list[list] = [[], [], [], [], []]
                for at, v, b in parts(batch, matrix):
                    i, c = np.nonzero(b <= bound.value[None])
                    d = np.sqrt(((v[i] - matrix[c]) ** 2).sum(axis=1))
                    for col, values in zip(flat, ([names[x] for x in c], [sizes[x] for x in c], d.tolist(), [owners[at + x] for x in i], [keys[at + x] for x in i])):
                        col += values
                yield pa.RecordBatch.from_pydict(dict(zip(("grp", "n", "d", "owner", "key"), flat)), schema=arrow)

        part = rows.mapInArrow(send, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("d", "key"))
    return out.withColumn("rank", rank).where("rank <= n").drop("rank")


def overlap(vectors: DataFrame, group: str, key: str, vec: str, name: str = "overlap_score") -> DataFrame:
    """(group, name): share of foreign vectors among the group-size nearest to a group's centroid."""
    near = nearest_of_groups(vectors, group, key, vec)
    return near.groupBy(F.col("grp").alias(group)).agg(F.avg(F.when(F.col("owner") == F.col("grp"), 0.0).otherwise(1.0)).alias(name))


def outlier(vectors: DataFrame, group: str, vec: str, name: str = "outlier_score") -> DataFrame:
    """(group, name): distance of a group's centroid from the nearest other one, null for the only group."""
    cents = centroids(vectors, group, vec)
    kind = dict(cents.dtypes)[group]
    out = cents.select(group, F.lit(None).cast("double").alias(name))
    for names, _, matrix in _blocks(cents, group):
        shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for batch in batches:
                far = []
                for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    d = np.sqrt(((matrix - np.array(c)) ** 2).sum(axis=1))
                    others = [x for x, o in zip(d.tolist(), names) if o != g]
                    far.append(min(others) if others else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.float64())], names=[group, name])

        out = out.unionByName(cents.select(group, "centroid").mapInArrow(run, f"`{group}` {kind}, `{name}` double"))
    return out.groupBy(group).agg(F.min(name).alias(name))
