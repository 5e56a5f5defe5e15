"""Operator 12, centroid clustering: kd-tree filtering.

Vectors become integers, floor(scale * x), and each task packs its vectors into kd-trees: a node holds the count, the integer
sums and the box of its vectors, and the vectors lie in leaf order. The trees are stored once. In each round a task goes down
its trees, level by level, with the centroids that may still be nearest: of two centroids the one is strictly dominated by
the other if every place of the box is nearer to the other (a linear form, whose least value over a box is known), and leaves
the list. A node with one centroid left is assigned whole, by its count and sums; at a leaf the remaining centroids are compared
with every vector. Only sums for each centroid leave a task. Everything is integer arithmetic, so the result is exact and does
not depend on how rows are partitioned.

Centroids start as the k vectors whose salted identifiers have the smallest hashes. A round ends by replacing every centroid
that has vectors by the floor of their mean; the others stay. Vectors are assigned once more at the end. Equal distances go to
the centroid with the smaller number.

Defined results: a vector that is null, has another number of components, or one that is null or not finite, is left out. Rows
repeated under one identifier count each; a null identifier counts as an empty one and is kept; starts with equal hashes are
ordered by their components. With fewer than k vectors there are as many centroids, without vectors the result is empty. A
component beyond 2^27 after scaling raises an error: distances would leave the range of a long. Further columns are not
carried, whatever their names: the result has a row for each vector, to be joined by its identifier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.packaging import ship

from .common import stored

#: Fixed value: beyond this a squared distance of 64 components could leave the range of a long.
LARGEST = 2**27
#: Below this, products of two components summed over a vector are exact in double arithmetic.
EXACT_DOUBLE = 2**22


@dataclass(frozen=True)
class ClusterParams:
    """k centroids (at most a few thousand: they travel with every task), rounds, components of a vector, scale and salt;
    vectors of a tree and of a leaf."""

    k: int = 16
    rounds: int = 3
    size: int = 64
    scale: int = 64
    salt: str = "1:"
    tree: int = 4096
    leaf: int = 32


def _rows(batches: Iterator[pa.RecordBatch], size: int, limit: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Identifiers and vectors of a task, `limit` at a time."""
    ids, vectors, held = [], [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, limit - held)
            ids.append(part.column(0))
            vectors.append(np.asarray(part.column(1).flatten(), np.int32).reshape(-1, size))
            held, at = held + part.num_rows, at + part.num_rows
            if held == limit:
                yield pa.concat_arrays(ids), np.concatenate(vectors)
                ids, vectors, held = [], [], 0
    if held:
        yield pa.concat_arrays(ids), np.concatenate(vectors)


class Tree:
    """A kd-tree over integer vectors: `order` puts them in leaf order; the nodes of level d are the 2^d stretches between
    cuts[d], halved along the widest side of their box."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        order, self.cuts = np.arange(len(vectors)), [np.array([0, len(vectors)])]
        while np.diff(self.cuts[-1]).max() > leaf:
            cuts = self.cuts[-1]
            halves = (cuts[:-1] + cuts[1:]) // 2
            for a, m, b in zip(cuts[:-1], halves, cuts[1:]):
                here = vectors[order[a:b]]
                side = np.argmax(here.max(0).astype(np.int64) - here.min(0))
                order[a:b] = order[a:b][np.argpartition(here[:, side], m - a)]
            self.cuts.append(np.insert(cuts, np.arange(1, len(cuts)), halves))
        self.order, self.vectors = order, vectors[order]
        self.nodes = [self._nodes(cuts) for cuts in self.cuts]

    def _nodes(self, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts, sums, lower and upper sides of the boxes."""
        first = cuts[:-1]
        sums = np.add.reduceat(self.vectors.astype(np.int64), first)
        return np.diff(cuts), sums, np.minimum.reduceat(self.vectors, first), np.maximum.reduceat(self.vectors, first)


def pack(tree: Tree) -> dict[str, bytes]:
    return {
        "vectors": tree.vectors.tobytes(), "cuts": np.concatenate(tree.cuts).astype(np.int32).tobytes(),
        "sums": np.concatenate([n[1] for n in tree.nodes]).tobytes(), "boxes": np.concatenate([np.stack(n[2:], 1) for n in tree.nodes]).tobytes(),
    }


def unpack(row: dict[str, bytes], size: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[np.ndarray, ...]]]:
    """Vectors in leaf order, cuts and nodes of each level."""
    cuts, levels, at = np.frombuffer(row["cuts"], np.int32).astype(np.int64), [], 0
    while at < len(cuts):
        n = (1 << len(levels)) + 1
        levels.append(cuts[at : at + n])
        at += n
    sums = np.frombuffer(row["sums"], np.int64).reshape(-1, size)
    boxes = np.frombuffer(row["boxes"], np.int32).reshape(-1, 2, size)
    nodes, at = [], 0
    for c in levels:
        n = len(c) - 1
        nodes.append((np.diff(c), sums[at : at + n], boxes[at : at + n, 0], boxes[at : at + n, 1]))
        at += n
    return np.frombuffer(row["vectors"], np.int32).reshape(-1, size), levels, nodes


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector and a column for each centroid."""
    x, c = vectors.astype(np.int64), centroids
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT_DOUBLE:
        cross = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        cross = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * cross + (c * c).sum(1)[None, :]


def undominated(low: np.ndarray, high: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of the open centroids of each box those that no other is nearer than at every place of the box. Each box is tried
    with the centroid nearest to its middle: d(x, z) - d(x, c) = |z|^2 - |c|^2 - 2 x (z - c) is linear in x, so its greatest
    value over the box takes each side where it is greatest."""
    far = np.iinfo(np.int64).max
    middle = (low.astype(np.int64) + high) // 2
    nearest = np.where(open_, squared(middle, centroids), far).argmin(1)
    norm = (centroids * centroids).sum(1)
    away = centroids[nearest][:, None, :] - centroids[None, :, :]
    least = np.where(away > 0, away * low[:, None, :], away * high[:, None, :]).sum(2)
    return open_ & ~(norm[nearest][:, None] - norm[None, :] - 2 * least < 0)


def assign(vectors: np.ndarray, cuts: list[np.ndarray], nodes: list[tuple[np.ndarray, ...]], centroids: np.ndarray):
    """Down one tree: yields (centroid, count, sums, first, end) of whole nodes, and of the resolved vectors of leaves with the
    places of these vectors: (centroids, None, None, places, None)."""
    at, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    for level, (counts, sums, low, high) in enumerate(nodes):
        open_ = undominated(low[at], high[at], open_, centroids)
        whole = open_.sum(1) == 1
        for node, c in zip(at[whole], open_[whole].argmax(1)):
            yield c, counts[node], sums[node], cuts[level][node], cuts[level][node + 1]
        at, open_ = at[~whole], open_[~whole]
        if not len(at):
            return
        if level == len(nodes) - 1:
            sizes = counts[at]
            places = np.repeat(cuts[level][at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            distance = np.where(np.repeat(open_, sizes, 0), squared(vectors[places], centroids), np.iinfo(np.int64).max)
            yield distance.argmin(1), None, None, places, None
        at, open_ = np.stack([2 * at, 2 * at + 1], 1).ravel(), np.repeat(open_, 2, 0)


def build_trees(kept: DataFrame, params: ClusterParams) -> DataFrame:
    """A row for each tree, stored: identifiers in leaf order, vectors, cuts, sums and boxes."""
    size, limit, leaf = params.size, params.tree, params.leaf
    kind = kept.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("vectors", "cuts", "sums", "boxes")]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _rows(batches, size, limit):
            tree = Tree(vectors, leaf)
            packed = pack(tree)
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(tree.order)))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([packed[c]], pa.binary()) for c in schema.names[1:]]], schema.names)

    return stored(kept.mapInArrow(build, schema), "trees")


def _trees(batches: Iterator[pa.RecordBatch], size: int):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, unpack({c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("vectors", "cuts", "sums", "boxes")}, size)


def _moved(trees: DataFrame, centroids: np.ndarray, params: ClusterParams) -> np.ndarray:
    """The centroids after one round: k rows of sums for each task are added up by Spark, k rows come to the driver."""
    size = params.size

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
        for _, _, (vectors, cuts, nodes) in _trees(batches, size):
            for c, n, s, places, _ in assign(vectors, cuts, nodes, centroids):
                if n is None:
                    count += np.bincount(c, minlength=len(centroids))
                    np.add.at(total, c, vectors[places])
                else:
                    count[c] += n
                    total[c] += s
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], ["c", "n", "total"])

    rows = trees.mapInArrow(sums, "c int, n bigint, total array<bigint>").select("c", "n", F.posexplode("total").alias("at", "x"))
    added = rows.groupBy("c", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    moved = centroids.copy()
    for r in added.collect():  # one row for each centroid and component
        moved[r.c, r["at"]] = r.x // r.n
    return moved


def cluster(df: DataFrame, params: ClusterParams = ClusterParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each kept vector: its identifier, cluster, distance, cluster_inertia, inertia, and the final centroid's
    components as centroid."""
    spark = df.sparkSession
    ship(spark)
    good = (F.size(vector_col) == params.size) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(params.scale))))
    large = F.exists("vector", lambda x: F.abs(x) > LARGEST)
    kept = df.filter(good).select(F.col(id_col).alias("id"), scaled.alias("vector"))
    checked = F.when(large, F.raise_error(F.lit("a component is beyond 2^27 after scaling"))).otherwise(F.col("vector"))
    kept = kept.select("id", checked.cast("array<int>").alias("vector"))
    salted = F.sha2(F.concat(F.lit(params.salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(salted, "vector").limit(params.k).collect()  # k rows
    centroids = np.array([r.vector for r in first], np.int64).reshape(-1, params.size)
    trees = build_trees(kept, params)
    for _ in range(params.rounds):
        centroids = _moved(trees, centroids, params)
    size = params.size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, (vectors, cuts, nodes) in _trees(batches, size):
            chosen = np.zeros(len(vectors), np.int32)
            for c, n, _, first, end in assign(vectors, cuts, nodes, centroids):
                chosen[first if n is None else slice(first, end)] = c
            apart = vectors.astype(np.int64) - centroids[chosen]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(chosen), pa.array((apart * apart).sum(1))], ["id", "cluster", "distance"])

    schema = T.StructType([kept.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    rows = stored(trees.mapInArrow(judge, schema), "assigned")
    of_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = [(c, row.tolist()) for c, row in enumerate(centroids)]
    final = spark.createDataFrame(told, "cluster int, centroid array<bigint>")
    totals = stored(of_cluster.join(F.broadcast(final), "cluster"), "inertia")  # at most k rows on both sides
    inertia = totals.agg(F.sum("cluster_inertia")).first()[0]  # one number
    rows = rows.join(F.broadcast(totals), "cluster")  # at most k rows
    return rows.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid")


def centroid_digest(components: list[int]) -> str:
    """sha256 of the components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
