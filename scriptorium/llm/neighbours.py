"""Most similar vectors for every vector (problem 2).

Method: NN-descent. A neighbour graph is seeded from a few random-projection trees, whose leaves are compared within
themselves, and improved by joins of neighbours of neighbours: whatever two vectors share a neighbour and never shared a
leaf are compared. New vectors are searched for by greedy walks over the graph, a join per step.

The trees are fitted on a sample of at most SAMPLE vectors per field; every vector is indexed. A leaf holds about LEAF
vectors, halves being cut at the sample's median, so that a dense region is cut as finely as its share of the vectors
asks. A leaf that has got more than FULL vectors is cut again by a tree fitted on a sample of its own, until none is full,
so that leaves don't grow with the number of vectors. Rounds go on until fewer than DELTA of all edges change; after the
first, only pairs with an edge that changed are compared. Equal vectors are one node of the graph, with the smallest of
their keys, as many as can be anyone's neighbours.

Results for special inputs: null vectors and vectors with null, NaN or infinite elements take no part; vectors of different
length are never neighbours; repeated rows of a key count once; ties go to the smaller key; fewer vectors than neighbours
give all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import discard, materialize

K = 5
#: Edges kept per node, trees, vectors in a leaf, sampled vectors per field, sampled vectors in a leaf at least, and the
#: share of edges below which a round's changes end the descent.
KEPT, TREES, LEAF, SAMPLE, LEAF_SAMPLE, DELTA = 10, 3, 400, 30_000, 8, 0.001
#: Vectors above which a leaf is cut again; sampled vectors and new leaves of such a cut at most; vectors in one task.
FULL, INNER_SAMPLE, INNER_LEAVES, PART = 1_000, 2_048, 256, 50_000
#: Reverse edges that a node passes on in a round.
REVERSE = 10


def vector_table(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(field, key, vec) of several (table, key column, vector column); vec holds the bytes of 4-byte floats."""
    rows = None
    for df, key, column in parts:
        one = df.select(F.lit(column).alias("field"), F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<float>").alias("v"))
        rows = one if rows is None else rows.unionByName(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            ends = v.offsets.to_numpy() - v.offsets[0].as_py()
            out = [flat[a:b].tobytes() if b > a and np.isfinite(flat[a:b]).all() else None for a, b in zip(ends[:-1], ends[1:])]
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["field", "key", "vec"])
            yield made.filter(pa.array([x is not None for x in out], pa.bool_()))

    return rows.where("v is not null and key is not null").mapInArrow(run, "field string, key bigint, vec binary")


class Tree:
    """A random-projection tree: a node's plane halves the sample between two of its vectors at the median."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        planes, cuts, sides = [], [], []
        self.leaves = 0

        def build(rows: np.ndarray, depth: int) -> int:
            if len(rows) <= max(leaf, 1) or depth > 40:
                self.leaves += 1
                return -self.leaves
            a, b = sample[rng.choice(rows, 2, replace=False)]
            plane = a - b
            if not plane.any():
                plane = rng.standard_normal(sample.shape[1])
            plane = (plane / np.linalg.norm(plane)).astype(np.float32)
            at = sample[rows] @ plane
            cut = np.float32(np.median(at))
            right = at > cut
            if right.all() or not right.any():
                right = rng.random(len(rows)) < 0.5
            node = len(planes)
            planes.append(plane)
            cuts.append(cut)
            sides.append([0, 0])
            sides[node] = [build(rows[~right], depth + 1), build(rows[right], depth + 1)]
            return node

        self.root = build(np.arange(len(sample)), 0)
        self.planes = np.array(planes, np.float32).reshape(len(planes), sample.shape[1])
        self.cuts, self.sides = np.array(cuts, np.float32), np.array(sides, np.int64).reshape(len(planes), 2)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf number, from 0, of each row."""
        node = np.full(len(x), self.root)
        while (open_ := np.flatnonzero(node >= 0)).size:
            n = node[open_]
            right = np.einsum("ij,ij->i", x[open_], self.planes[n]) > self.cuts[n]
            node[open_] = self.sides[n, right.astype(int)]
        return -node - 1


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _by_length(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the length written behind the field, as only vectors of one length can be neighbours."""
    return vectors.withColumn("field", F.concat("field", F.lit("|"), (F.octet_length("vec") / 4).cast("int").cast("string")))


def _plain_field(c: str = "field"):
    return F.regexp_replace(c, r"\|\d+$", "")


def fit_trees(nodes: DataFrame, seed: int = 17) -> dict[str, tuple[int, list[Tree]]]:
    """By field: (length of its vectors, its trees), from a bounded sample of the nodes (field, key, vec)."""
    out = {}
    for field, n, size in sorted((r.field, r.n, r.size) for r in nodes.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length("vec")).alias("size")).collect()):
        pick = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))
        rows = nodes.where((F.col("field") == field) & pick).select("vec").limit(2 * SAMPLE).collect() if n > LEAF else []
        x = np.frombuffer(b"".join(r.vec for r in rows), np.float32).reshape(-1, size // 4)
        leaf = max(LEAF_SAMPLE if len(x) < n else 1, LEAF * len(x) // max(n, 1))
        out[field] = (size // 4, [Tree(x, leaf, seed + t) for t in range(TREES if len(x) else 1)])
    return out


def _with_leaves(nodes: DataFrame, shared) -> DataFrame:
    """(field, key, vec, leaves): a leaf's number is unique over a field's trees. Vectors of an unknown field are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            fields = batch.column(0).to_pylist()
            for field in sorted(set(fields) & set(trees)):
                width, own = trees[field]
                part = batch.filter(pa.array(np.array(fields) == field))
                x = _matrix(part.column(2), width)
                base = np.cumsum([0, *(t.leaves for t in own)])
                leaves = np.stack([t.leaf_of(x) + b for t, b in zip(own, base)], axis=1).astype(np.int64)
                ends = np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(leaves.ravel()))], names=["field", "key", "vec", "leaves"])

    return nodes.select("field", "key", "vec").mapInArrow(run, "field string, key bigint, vec binary, leaves array<bigint>")


def _inner_tree(size: int):
    """The tree that cuts a full leaf into leaves of ``size``, from a sample of its vectors."""

    def run(group: pa.Table) -> pa.Table:
        vec, n, leaf = group.column("vec").to_pylist(), group.column("n")[0].as_py(), group.column("leaf")[0].as_py()
        x = np.frombuffer(b"".join(vec), np.float32).reshape(len(vec), -1)
        tree = Tree(x, max(1, len(x) // min(INNER_LEAVES // 2, -(-n // size))), leaf % (1 << 31))
        return pa.table({"field": group.column("field")[:1], "leaf": pa.array([leaf], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def _inner_leaves(size: int):
    """The vectors of a part of a full leaf in the leaves of its tree; without one, by a hash of the key."""

    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        leaf, vec = rows.column("leaf").to_numpy(), rows.column("vec").to_pylist()
        if not vec:
            sub = np.empty(0, np.int64)
        elif trees.num_rows:
            sub = pickle.loads(trees.column("tree")[0].as_py()).leaf_of(np.frombuffer(b"".join(vec), np.float32).reshape(len(vec), -1))
        else:
            sub = rows.column("h").to_numpy() % np.minimum(INNER_NUMBERS - 1, -(-rows.column("n").to_numpy() // size))
        return pa.table([rows.column("field"), rows.column("key"), rows.column("at"), pa.array(leaf * INNER_NUMBERS + sub + FIRST_INNER)], names=["field", "key", "at", "leaf"])

    return run


#: Numbers of the leaves of an inner tree: more than a tree has leaves, and above all numbers of outer leaves.
INNER_NUMBERS, FIRST_INNER = 512, 1 << 20


def _cut_full_leaves(placed: DataFrame) -> DataFrame:
    """``placed`` with leaves of at most FULL vectors. Two levels are cut by trees; vectors that these can't part, as they lie
    closer together than planes tell, are then parted by a hash. A full leaf is cut in parts of about PART vectors a task."""
    long = placed.select("field", "key", F.posexplode("leaves").alias("at", "leaf"))
    first = long
    for level in range(5):
        full = materialize(long.groupBy("field", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL), "full-leaves")
        if full.isEmpty():
            discard(full)
            break
        parts = F.ceil(F.col("n") / PART).cast("bigint")
        rows = long.join(full, ["field", "leaf"]).join(placed.select("field", "key", "vec"), ["field", "key"]).withColumn("h", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1 << 30)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(-1)), parts))
        picked = rows.where(F.col("h") < F.lit(float(1 << 30)) * F.least(F.lit(1.0), INNER_SAMPLE / F.col("n")))
        trees = picked.groupBy("field", "leaf").applyInArrow(_inner_tree(LEAF), "field string, leaf bigint, tree binary") if level < 2 else full.select("field", "leaf", F.lit(b"").alias("tree")).limit(0)
        trees = trees.join(full, ["field", "leaf"]).select("field", "leaf", "tree", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
        cut = rows.groupBy("field", "leaf", "part").cogroup(trees.groupBy("field", "leaf", "part")).applyInArrow(_inner_leaves(LEAF), "field string, key bigint, at int, leaf bigint")
        new = materialize(long.join(full, ["field", "leaf"], "left_anti").select("field", "key", "at", "leaf").unionByName(cut), "leaves")
        discard(full, *([] if long is first else [long]))
        long = new
    else:
        raise RuntimeError("leaves stayed full after five cuts")
    if long is first:
        return placed
    lists = long.groupBy("field", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "leaf"))), lambda s: s["leaf"]).alias("leaves"))
    return placed.drop("leaves").join(lists, ["field", "key"])


def _leaf_edges(group: pa.Table) -> pa.Table:
    """The KEPT nearest of each vector within a leaf."""
    group = group.combine_chunks()
    vec = group.column("vec").to_pylist()
    keys = group.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    x = np.frombuffer(b"".join(vec[i] for i in order), np.float32).reshape(len(vec), -1).astype(np.float64)
    n = len(x)
    k = min(KEPT, n - 1)
    frm, to, far = [], [], []
    norm = (x * x).sum(axis=1)
    for a in range(0, n if k > 0 else 0, 1024):
        b = min(n, a + 1024)
        d = norm[a:b, None] + norm[None] - 2 * (x[a:b] @ x.T)
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(d, axis=1)[:, :k]
        exact = ((x[a:b, None, :] - x[near]) ** 2).sum(axis=2)
        frm.append(np.repeat(np.arange(a, b), k))
        to.append(near.ravel())
        far.append(exact.ravel())
    i, j, d = (np.concatenate(c) if c else np.empty(0, t) for c, t in ((frm, np.int64), (to, np.int64), (far, np.float64)))
    leaves = group.column("leaves").take(pa.array(order)).take(pa.array(j))
    field = pa.array([group.column("field")[0].as_py()] * len(i), pa.string())
    return pa.table([field, pa.array(keys[i]), pa.array(keys[j]), pa.array(d), leaves.combine_chunks() if isinstance(leaves, pa.ChunkedArray) else leaves], names=["field", "key", "other", "d", "leaves"])


EDGE = "field string, key bigint, other bigint, d double, leaves array<bigint>"


def _nearest(edges: DataFrame, k: int, *more: str) -> DataFrame:
    """(field, key, near): the k nearest others of each node, nearest first, as (d, other, leaves, ``more``). Each task ranks
    its own rows before they meet, so that a node that many hold for near brings no more than k from each."""
    order = Window.partitionBy("field", "key").orderBy("d", "other")
    best = edges.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k)  # repeated edges share a rank
    return best.groupBy("field", "key").agg(F.array_sort(F.collect_set(F.struct("d", "other", "leaves", *more))).alias("near"))


def _distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges in both directions for pairs (field, a, b)."""
    of = nodes.select("field", "key", "vec", "leaves")
    x, y = (of.select("field", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "vec", "leaves"))) for s in "ab")
    both = pairs.withColumnsRenamed({"a": "key_a", "b": "key_b"}).join(x, ["field", "key_a"]).join(y, ["field", "key_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            va, vb = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            d = np.empty(len(va))
            sizes = np.array([len(v) for v in va])
            for s in set(sizes.tolist()):
                at = np.flatnonzero(sizes == s)
                for c in range(0, len(at), 4096):
                    part = at[c : c + 4096]
                    p, q = (np.frombuffer(b"".join(v[i] for i in part), np.float32).reshape(len(part), -1).astype(np.float64) for v in (va, vb))
                    d[part] = ((p - q) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(d), batch.column(6)], names=["field", "key", "other", "d", "leaves"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(d), batch.column(5)], names=["field", "key", "other", "d", "leaves"])

    return both.select("field", "key_a", "key_b", "vec_a", "vec_b", "leaves_a", "leaves_b").mapInArrow(run, EDGE)


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("field", "key", F.explode("near").alias("e")).select("field", "key", "e.*")


def _strangers(graph: DataFrame) -> DataFrame:
    """(field, a, b) with a < b of nodes that share a neighbour, in either direction, over a changed edge, and no leaf."""
    own = graph.select("field", "key", F.col("own").alias("leaves"))
    back = _edges(graph).drop("leaves").join(own, ["field", "key"]).select("field", F.col("other").alias("key"), F.col("key").alias("other"), "d", "leaves", "fresh")
    behind = _nearest(back, REVERSE, "fresh").withColumnRenamed("near", "behind")
    around = graph.join(behind, ["field", "key"], "left").select("field", F.array_distinct(F.concat("near", F.coalesce("behind", F.array().cast(graph.schema["near"].dataType)))).alias("n"))
    met = lambda x: lambda y: (y["other"] > x["other"]) & (x["fresh"] | y["fresh"]) & ~F.arrays_overlap(y["leaves"], x["leaves"])
    crossed = around.select("field", F.explode("n").alias("x"), "n").select("field", F.col("x.other").alias("a"), F.explode(F.transform(F.filter("n", met(F.col("x"))), lambda y: y["other"])).alias("b"))
    return crossed.distinct()


def _graph(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(field, key, own, near) of nodes (field, key, own, known): near holds (d, other, leaves, fresh), an edge being fresh if
    it leads to none of ``known``."""
    near = F.transform("near", lambda e: F.struct(e["d"].alias("d"), e["other"].alias("other"), e["leaves"].alias("leaves"), (~F.array_contains("known", e["other"])).alias("fresh")))
    return materialize(own.join(_nearest(edges, KEPT), ["field", "key"], "left").select("field", "key", "own", near.alias("near")), "graph")


def neighbour_graph(vectors: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, tuple[int, list[Tree]]]]:
    """(nodes, graph, trees) of vectors (field, key, vec). nodes: (field, key, vec, keys, tops, leaves), one per different
    vector, key being its smallest key and keys the K + 1 smallest, tops its leaves in ``trees``, leaves those after full ones
    were cut; graph: (field, key, own, near). The field of these is that of the vectors with their length."""
    spark = vectors.sparkSession
    order = Window.partitionBy("field", "vec").orderBy("key")
    smallest = _by_length(vectors).withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= K + 1)  # each task ranks its own rows first
    whole = smallest.groupBy("field", "vec").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    nodes = materialize(whole.select("field", F.col("keys")[0].alias("key"), "vec", "keys"), "vectors")
    trees = fit_trees(nodes)
    shared = spark.sparkContext.broadcast(trees)
    tops = materialize(_with_leaves(nodes, shared), "tops")
    with_keys = tops.select("field", "key", F.col("leaves").alias("tops")).join(nodes.select("field", "key", "keys"), ["field", "key"])
    placed = materialize(_cut_full_leaves(tops).join(with_keys, ["field", "key"]), "nodes")
    discard(nodes, tops)
    seeds = placed.select("field", "key", "vec", "leaves", F.explode("leaves").alias("leaf")).groupBy("field", "leaf").applyInArrow(_leaf_edges, EDGE)
    own = placed.select("field", "key", F.col("leaves").alias("own"))
    graph = _graph(own.withColumn("known", F.array().cast("array<bigint>")), seeds)
    while True:  # an edge is only exchanged for a nearer one, so that changes end
        found = materialize(_distances(_strangers(graph), placed), "found")
        new = _graph(graph.select("field", "key", "own", F.coalesce(F.col("near.other"), F.array().cast("array<bigint>")).alias("known")), _edges(graph).drop("fresh").unionByName(found))
        edges, changed = new.agg(F.sum(F.size("near")), F.sum(F.size(F.filter("near", lambda e: e["fresh"])))).first()
        discard(graph, found)
        graph = new
        if (changed or 0) <= DELTA * (edges or 0):
            return placed, graph, trees


def nearest_pairs(vectors: DataFrame, k: int = K) -> DataFrame:
    """(vec_field, key_a, key_b), smaller key first, of each two keys of which one is among the other's k nearest (k <= K)."""
    nodes, graph, _ = neighbour_graph(vectors)
    listed = graph.join(nodes.select("field", "key", "keys"), ["field", "key"])
    # a node's own keys come first, at distance 0, then those of the nodes near it
    edges = _edges(listed).select("field", "key", "other", "d")
    keys_of = nodes.select("field", F.col("key").alias("other"), "keys")
    many = keys_of.where("size(keys) > 1")  # most nodes stand for one key
    reached = edges.join(many, ["field", "other"], "left").select("field", "key", "d", F.explode(F.coalesce("keys", F.array("other"))).alias("other"))
    itself = nodes.where("size(keys) > 1").select("field", "key", F.lit(0.0).alias("d"), F.explode("keys").alias("other"))
    lists = reached.unionByName(itself).groupBy("field", "key").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k + 1).alias("near"))
    first = nodes.select("field", "key", "keys").join(lists, ["field", "key"]).select("field", F.explode("keys").alias("key"), "near")
    beyond = _by_length(vectors).join(nodes.where(F.size("keys") > K).select("field", "vec", "key", "keys").withColumnRenamed("key", "node"), ["field", "vec"]).where(~F.array_contains("keys", F.col("key")))
    beyond = beyond.select("field", "key", F.transform("keys", lambda x: F.struct(F.lit(0.0).alias("d"), x.alias("other"))).alias("near"))
    top = first.unionByName(beyond).select("field", "key", F.slice(F.filter("near", lambda e: e["other"] != F.col("key")), 1, k).alias("near"))
    pairs = top.select(_plain_field().alias("vec_field"), "key", F.explode("near.other").alias("other"))
    return pairs.select("vec_field", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


#: Nodes of a leaf that a search compares first, at most, so that of a leaf that isn't full all are; candidates it keeps; and
#: queries of a leaf in one task.
ENTRIES, BEAM, ASKED = FULL, 40, 10_000


def _doors(nodes: pa.Table, queries: pa.Table) -> pa.Table:
    """The BEAM nodes of a leaf nearest to each query that falls into it."""
    schema = pa.schema([("field", pa.string()), ("q", pa.int64()), ("other", pa.int64()), ("d", pa.float64()), ("done", pa.bool_())])
    if not nodes.num_rows or not queries.num_rows:
        return schema.empty_table()
    x, y = (np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(t.num_rows, -1).astype(np.float64) for t in (nodes, queries))
    keys, q, out = nodes.column("key").to_numpy(), queries.column("q").to_numpy(), []
    k = min(BEAM, len(x))
    for a in range(0, len(y), 256):
        part = y[a : a + 256]
        d = (part * part).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * (part @ x.T)
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) else np.argsort(d, axis=1)
        exact = ((part[:, None, :] - x[near]) ** 2).sum(axis=2)
        out.append((np.repeat(q[a : a + 256], k), keys[near].ravel(), exact.ravel()))
    q, other, d = (np.concatenate(c) for c in zip(*out))
    field = pa.array([nodes.column("field")[0].as_py()] * len(q), pa.string())
    return pa.Table.from_arrays([field, pa.array(q), pa.array(other), pa.array(d), pa.array([False] * len(q), pa.bool_())], schema=schema)


def _to_queries(pairs: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(field, q, other, d, done) for pairs (field, q, other)."""
    x, y = queries.select("field", F.col("key").alias("q"), F.col("vec").alias("vq")), nodes.select("field", F.col("key").alias("other"), F.col("vec").alias("vo"))
    both = pairs.join(x, ["field", "q"]).join(y, ["field", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            d = [float(((np.frombuffer(a, np.float32).astype(np.float64) - np.frombuffer(b, np.float32)) ** 2).sum()) for a, b in zip(va, vb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(d, pa.float64()), pa.array([False] * len(d), pa.bool_())], names=["field", "q", "other", "d", "done"])

    return both.select("field", "q", "other", "vq", "vo").mapInArrow(run, "field string, q bigint, other bigint, d double, done boolean")


def search(index: tuple[DataFrame, DataFrame, dict], queries: DataFrame, k: int = K) -> DataFrame:
    """(field, q, other, d), the field with the length: for each query vector (field, key, vec) the k nearest nodes of
    ``neighbour_graph`` that a greedy walk finds: from the nearest nodes of the query's leaves over the graph's edges in both
    directions, always keeping the BEAM nearest, until all of those have passed on their neighbours. A step is a join for
    all queries at once."""
    nodes, graph, trees = index
    placed = materialize(_with_leaves(_by_length(queries).dropDuplicates(["field", "key"]), queries.sparkSession.sparkContext.broadcast(trees)), "queries")
    asked = placed.select("field", F.col("key").alias("q"), "vec", F.explode("leaves").alias("leaf"))
    parts = F.ceil(F.count(F.lit(1)) / ASKED).cast("bigint").alias("parts")
    per_leaf = materialize(asked.groupBy("field", "leaf").agg(parts), "asked")
    order = Window.partitionBy("field", "leaf").orderBy(F.xxhash64("key"), "key")
    doors = nodes.select("field", "key", "vec", F.explode("tops").alias("leaf")).join(per_leaf, ["field", "leaf"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= ENTRIES)
    doors = doors.select("field", "leaf", "key", "vec", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    asked = asked.join(per_leaf, ["field", "leaf"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")))
    first = doors.groupBy("field", "leaf", "part").cogroup(asked.groupBy("field", "leaf", "part")).applyInArrow(_doors, "field string, q bigint, other bigint, d double, done boolean")
    edges = _edges(graph)
    back = edges.select("field", F.col("other").alias("at"), F.col("key").alias("other"), "d")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("field", "at").orderBy("d", "other"))).where(F.col("r") <= REVERSE)
    near = materialize(edges.select("field", F.col("key").alias("at"), "other").union(back.select("field", "at", "other")).distinct(), "ways")
    state = materialize(first.distinct(), "search")
    entry = F.struct("d", "other", "done")
    while True:  # the kept candidates get nearer in each step or end the walk
        best = materialize(state.groupBy("field", "q").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, BEAM).alias("b")).select("field", "q", F.explode("b").alias("e")).select("field", "q", "e.other", "e.d", "e.done"), "search")
        discard(state)
        state = best
        reached = best.where("not done").select("field", "q", F.col("other").alias("at")).join(near, ["field", "at"]).select("field", "q", "other").distinct()
        new = reached.join(best.select("field", "q", "other"), ["field", "q", "other"], "left_anti")
        grown = materialize(best.withColumn("done", F.lit(True)).unionByName(_to_queries(new, nodes, placed)), "search")
        discard(best)
        state = grown
        if state.where("not done").isEmpty():
            break
    top = state.groupBy("field", "q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k).alias("b"))
    return top.select("field", "q", F.explode("b").alias("e")).select("field", "q", "e.other", "e.d")


def search_keys(index: tuple[DataFrame, DataFrame, dict], queries: DataFrame, k: int = K) -> DataFrame:
    """(field, q, other, d): for each query vector the k nearest keys other than its own (k <= K) that ``search`` finds, those
    of equal vectors included."""
    nodes = index[0].select("field", F.col("key").alias("other"), "keys")
    keys = search(index, queries, k + 1).join(nodes, ["field", "other"]).select("field", "q", "d", F.explode("keys").alias("other")).where("q <> other")
    top = keys.groupBy("field", "q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k).alias("b"))
    return top.select(_plain_field().alias("field"), "q", F.explode("b").alias("e")).select("field", "q", "e.other", "e.d")
