"""Centroid clustering with a vantage-point tree over the centroids.

Vectors become integer points, ``floor(scale * x)`` per component. In each round the driver builds a vantage-point tree over the centroids
(their number and dimensions are the only things that it holds) and broadcasts it; every vector searches it best first: the open node
with the least possible distance is taken next, and what can only be farther than the nearest found is pruned. The pruning radius
is inclusive, so that equally near centroids are all compared; distances are exact integers and ties go to the smaller number.
A task adds up its vectors per cluster, so that one row per cluster leaves it, whatever the size of a cluster.

Rows: vectors that are null, of another length, or with null or non-finite components take no part, neither do those with an integer
beyond ``LARGEST``, whose squared distances do not fit a long. Vectors without an id are clustered like others but come last as first
centroids. Repeated rows count each. Ties among the hashes of ids are broken by the points. With fewer vectors than centroids there are as
many centroids as vectors; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscore.llm.storage import saved

LARGEST = 1 << 27  # of an integer component: 64 squares of differences of such numbers fit a long
BATCH = 4_096  # vectors that search together


@dataclass
class VantageTree:
    """Each node has a centroid as vantage point and up to two children: the nearer and the farther half of the rest, with the
    least and largest distance to the vantage point in each."""

    points: np.ndarray
    vantage: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray) -> VantageTree:
        vantage, child, low, high = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            members, parent, side = todo.pop()
            node, own = len(vantage), int(members[0])
            vantage.append(own)
            child.append([-1, -1])
            low.append([0.0, 0.0])
            high.append([0.0, 0.0])
            if parent >= 0:
                child[parent][side] = node
            rest = members[1:]
            far = np.sqrt(((points[rest] - points[own]) ** 2).sum(axis=1).astype(float))
            order = np.argsort(far, kind="stable")
            half = (len(rest) + 1) // 2
            for k, part in enumerate((order[:half], order[half:])):
                if len(part):
                    low[node][k], high[node][k] = float(far[part[0]]), float(far[part[-1]])
                    todo.append((np.sort(rest[part]), node, k))
        return cls(points, np.array(vantage), np.array(child), np.array(low), np.array(high))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row, and how many distances were computed."""
        best, number = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(self.points))
        bounds, nodes = np.full((len(rows), 1), 0.0), np.zeros((len(rows), 1), np.int64)
        live, computed = np.arange(len(rows)), 0
        while len(live):
            at = bounds[live].argmin(axis=1)
            least = bounds[live, at]
            reach = np.sqrt(best[live].astype(float)) * (1 + 1e-9) + 1e-6  # inclusive: rounding never prunes a tie
            going = least <= reach
            live, at, least = live[going], at[going], least[going]
            node = nodes[live, at]
            bounds[live, at] = np.inf
            own = self.vantage[node]
            distance = ((rows[live] - self.points[own]) ** 2).sum(axis=1)
            computed += len(live)
            better = (distance < best[live]) | ((distance == best[live]) & (own < number[live]))
            best[live[better]], number[live[better]] = distance[better], own[better]
            d = np.sqrt(distance.astype(float))
            pushed, which = np.full((len(rows), 2), np.inf), np.zeros((len(rows), 2), np.int64)
            for side in (0, 1):
                child = self.child[node, side]
                lower = np.maximum.reduce([least, self.low[node, side] - d, d - self.high[node, side]])
                pushed[live, side] = np.where(child >= 0, lower, np.inf)
                which[live, side] = child
            bounds, nodes = np.concatenate([bounds, pushed], axis=1), np.concatenate([nodes, which], axis=1)
            live = live[np.isfinite(bounds[live]).any(axis=1)]
        return number, best, computed


def integer_points(rows: DataFrame, scale: int, size: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, point``: the vectors that take part, as integers."""
    own = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < LARGEST))
    kept = own.where((F.size("vector") == size) & F.coalesce(good, F.lit(False)))
    return kept.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("int")).alias("point"))


def _points(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("point").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def assign(points: DataFrame, tree: VantageTree) -> DataFrame:
    """``vec_id, cluster, distance`` of every point."""
    shared = points.sparkSession.sparkContext.broadcast(tree)  # the centroids
    size = tree.points.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), BATCH):
                batch = whole.slice(a, BATCH)
                number, distance, _ = shared.value.nearest(_points(batch, size))
                columns = [batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.mapInArrow(search, f"vec_id {kind}, cluster int, distance long")


def sums(points: DataFrame, tree: VantageTree) -> DataFrame:
    """``cluster, n, total``: number and componentwise sum of the points of each non-empty cluster."""
    shared = points.sparkSession.sparkContext.broadcast(tree)  # the centroids
    size = tree.points.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(tree_shape, np.int64), np.zeros(tree_shape[0], np.int64)
        for whole in batches:
            for a in range(0, len(whole), BATCH):
                rows = _points(whole.slice(a, BATCH), size)
                number, _, _ = shared.value.nearest(rows)
                np.add.at(total, number, rows)
                n += np.bincount(number, minlength=len(n))
        some = np.flatnonzero(n)
        columns = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "total"])

    tree_shape = tree.points.shape
    parts = points.select("point").mapInArrow(add, "cluster int, n long, total array<long>")
    added = F.array(*(F.sum(F.col("total")[i]) for i in range(size)))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), added.alias("total"))


def first_centroids(points: DataFrame, count: int, seed: str) -> np.ndarray:
    """The ``count`` points with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    hashed = points.select("point", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"))
    chosen = hashed.orderBy(F.asc_nulls_last("h"), "point").limit(count).collect()
    return np.array([row[0] for row in chosen], np.int64)


def cluster(rows: DataFrame, centroids: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, seed: str = "1") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part."""
    points = saved(integer_points(rows, scale, size), "cluster-points")
    held = first_centroids(points, centroids, seed)
    if len(held):
        for _ in range(rounds):
            moved = held.copy()
            for row in sums(points, VantageTree.over(held)).collect():  # one row per centroid at most
                moved[row["cluster"]] = [total // row["n"] for total in row["total"]]
            held = moved
        placed = saved(assign(points, VantageTree.over(held)), "cluster-placed")
    else:
        placed = points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    inertia = {row[0]: row[1] for row in placed.groupBy("cluster").agg(F.sum("distance")).collect()}  # one row per centroid at most
    digests = [hashlib.sha256(",".join(map(str, point)).encode()).hexdigest() for point in held.tolist()]
    totals = rows.sparkSession.createDataFrame(
        [(c, inertia[c], sum(inertia.values()), digests[c]) for c in sorted(inertia)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
