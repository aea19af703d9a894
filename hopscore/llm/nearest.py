"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced splits of a bounded sample of the vectors. Every vector stands in the list of its nearest centroid
and, if it lies at a boundary, in those of further centroids of nearly the same distance. A query searches the centroids by a
graph of their neighbours, held in memory, and keeps the lists whose distance is at most ``ratio`` times the least. Lists
are cut into shards of bounded size and the queries of a list into groups; each pair of them is one unit of work, in
which the exact cosines are computed in double precision. ``ratio`` is chosen by the recall of the sample against brute force.
A query first meets its nearest lists alone; the k-th best score found there is its floor, and units of the other lists return only
what reaches the floor, so that the rows of results follow the queries and not the lists.

Rows of an embedding table: vectors that are null, zero, hold null or non-finite components or have another
length than most take no part, neither do rows without an id. Rows that repeat an id count as one candidate, by their best
cosine. Ties go to the smaller id. Fewer candidates than ``k`` give as many rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopscore.llm.storage import saved

SAMPLE = 20_000  # vectors the centroids are fitted on, at most
LISTS = 1_024  # centroids, at most
PER_LIST = 128  # vectors a list is planned for while there are fewer than LISTS
REPLICAS, BOUNDARY = 4, 1.08  # lists a vector may stand in, and how much farther than the nearest they may be
NEIGHBOURS, BEAM = 24, 48
SHARD, GROUP = 2_048, 1_024  # vectors and queries of a unit of work
FIRST = 4  # lists that a query meets before it has a floor
RECALL, TRIALS = 0.97, 200  # of the sample, and the queries it is measured with
RATIOS = (1.0, 1.02, 1.04, 1.06, 1.08, 1.1, 1.13, 1.16, 1.2, 1.25, 1.3, 1.4, 1.6, 2.0, 10.0)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


def balanced_centroids(units: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of ``lists`` parts of nearly equal size: parts are split in two halves along the line between two means."""
    random = np.random.default_rng(seed)
    heap = [(-len(units), 0, np.arange(len(units)))]
    while len(heap) < min(lists, len(units)):
        size, order, part = heapq.heappop(heap)
        if size > -2:
            heapq.heappush(heap, (size, order, part))
            break
        own = units[part]
        a, b = own[random.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = own @ (a - b)
            half = side >= np.median(side)
            if half.all() or not half.any():
                half = np.arange(len(own)) < len(own) // 2
            a, b = own[half].mean(axis=0), own[~half].mean(axis=0)
        rank = np.argsort(-(own @ (a - b)), kind="stable")
        for number, half in enumerate((rank[: len(own) // 2], rank[len(own) // 2 :])):
            heapq.heappush(heap, (-len(half), 2 * order + 1 + number, part[half]))
    means = np.stack([units[part].mean(axis=0) for _, _, part in sorted(heap, key=lambda x: x[1])])
    norms = np.linalg.norm(means, axis=1, keepdims=True)
    return np.where(norms > 1e-9, means / np.maximum(norms, 1e-9), means)


@dataclass
class Lists:
    """Centroids and the graph that connects each with its neighbours; both are bounded by LISTS."""

    centroids: np.ndarray
    graph: np.ndarray
    ratio: float = RATIOS[-1]

    @classmethod
    def over(cls, centroids: np.ndarray) -> Lists:
        order = np.argsort(_distances(centroids, centroids), axis=1, kind="stable")
        return cls(centroids, order[:, 1 : NEIGHBOURS + 1])

    def place(self, units: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector: of its nearest centroid, and across a boundary."""
        far = _distances(units, self.centroids)
        near = np.argsort(far, axis=1, kind="stable")[:, :REPLICAS]
        least = np.take_along_axis(far, near, axis=1)
        inside = least <= BOUNDARY * least[:, :1]
        return [row[keep] for row, keep in zip(near, inside, strict=True)]

    def search(self, unit: np.ndarray, ratio: float | None = None) -> list[int]:
        """Lists within ``ratio`` of the nearest found, by best-first search of the graph; nearest first."""
        ratio = self.ratio if ratio is None else ratio
        far = lambda some: np.sqrt(np.maximum(2 - 2 * self.centroids[some] @ unit, 0))
        entries = np.unique(np.linspace(0, len(self.centroids) - 1, 16).astype(int))
        known = dict(zip(entries.tolist(), far(entries).tolist(), strict=True))
        frontier = [(d, c) for c, d in known.items()]
        heapq.heapify(frontier)
        best, done = frontier[0][0], 0
        while frontier:
            distance, at = heapq.heappop(frontier)
            if done >= BEAM and distance > ratio * best:
                break
            done += 1
            new = [c for c in self.graph[at].tolist() if c not in known]
            if new:
                for c, d in zip(new, far(np.array(new)).tolist(), strict=True):
                    known[c] = d
                    best = min(best, d)
                    heapq.heappush(frontier, (d, c))
        return [c for d, c in sorted((d, c) for c, d in known.items()) if d <= ratio * best]


def fit_lists(vectors: np.ndarray, total: int, k: int = 5) -> Lists:
    """Centroids for ``total`` vectors from a sample, and the least ratio that finds RECALL of the sample's neighbours."""
    units = _units(vectors)
    count = max(1, min(LISTS, total // PER_LIST, len(units) // 8))
    lists = Lists.over(balanced_centroids(units, count))
    members: list[list[int]] = [[] for _ in range(len(lists.centroids))]
    for i, placed in enumerate(lists.place(units)):
        for c in placed:
            members[c].append(i)
    trials = np.linspace(0, len(units) - 1, min(TRIALS, len(units))).astype(int)
    near = units[trials] @ units.T
    near[np.arange(len(trials)), trials] = -2
    wanted = np.argsort(-near, axis=1)[:, :k]
    for ratio in RATIOS:
        found = 0
        for query, want in zip(trials, wanted, strict=True):
            seen = set().union(*(members[c] for c in lists.search(units[query], ratio)))
            found += sum(int(x) in seen for x in want)
        if found >= RECALL * wanted.size:
            lists.ratio = ratio
            break
    return lists


def _valid(rows: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0].n if lengths else 0))


def _sample(rows: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` different vectors, those of the smallest hashes."""
    hashed = rows.select("vector", F.xxhash64("vector").alias("h"))
    bound = hashed.select("h").distinct().orderBy("h").limit(count).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= bound).dropDuplicates(["h"]).orderBy("h").toPandas()
    return np.array(chosen["vector"].tolist(), float).reshape(len(chosen), -1)


def search(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query among all other rows."""
    valid = _valid(rows)
    kind = valid.schema["vec_id"].dataType.simpleString()
    total = valid.count()
    if not total:
        empty = {"query_id": kind, "rank": "int", "score": "double"}
        return valid.select("vec_id").withColumns({n: F.lit(None).cast(t) for n, t in empty.items()}).select(
            "query_id", "rank", "vec_id", "score"
        )
    lists = fit_lists(_sample(valid, SAMPLE), total, k)
    own = rows.sparkSession.sparkContext.broadcast(lists)  # LISTS centroids and their graph

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 1_000):
                some = frame.iloc[a : a + 1_000]
                yield some.assign(list=own.value.place(_units(np.array(some["vector"].tolist())))).explode("list")

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = dict(sizes)
        for frame in frames:
            found = []
            for unit in _units(np.array(frame["vector"].tolist())) if len(frame) else []:
                near = own.value.search(unit)
                while sum(held.get(c, 0) for c in near) < REPLICAS * (k + 1) and len(near) < len(own.value.centroids):
                    rest = sorted(set(range(len(own.value.centroids))) - set(near))
                    near = [*near, *(rest if len(near) > BEAM else rest[: 2 * len(near)])]
                found.append(near)
            nearest = [list(range(len(near))) for near in found]
            yield frame.assign(list=found, place=nearest).explode(["list", "place"])

    def compare(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(queries):
            ids, held = vectors["vec_id"].to_numpy(), np.array(vectors["vector"].tolist())
            norms = np.sqrt((held * held).sum(axis=1))
            floors = queries["floor"].fillna(-np.inf)
            for query_id, query, floor in zip(queries["vec_id"], queries["vector"], floors, strict=True):
                # row by row, so that equal vectors have equal scores whatever stands beside them
                score = (held * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))
                score[ids == query_id] = -np.inf
                top = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
                top = top[np.lexsort((ids[top], -score[top]))][:k]
                top = top[(score[top] > -np.inf) & (score[top] >= floor)]
                out["query_id"] += [query_id] * len(top)
                out["vec_id"] += ids[top].tolist()
                out["score"] += score[top].tolist()
        return pd.DataFrame(out)

    unit = f"vec_id {kind}, vector array<double>, list int"
    postings = saved(valid.mapInPandas(place, unit), "nearest-lists")
    sizes = {row[0]: row[1] for row in postings.groupBy("list").count().collect()}  # at most LISTS rows
    probes = saved(valid.where(is_query).mapInPandas(probe, unit + ", place int"), "nearest-probes")
    shard, group = F.pmod(F.xxhash64("vec_id", "vector"), "shards").cast("int"), F.pmod(F.xxhash64("vec_id"), "groups").cast("int")
    by = ["list", "shard", "group"]

    def meet(asking: DataFrame) -> DataFrame:
        """``query_id, vec_id, score`` of the units in which these probes meet their lists."""
        asked = {row[0]: row[1] for row in asking.groupBy("list").count().collect()}  # at most LISTS rows
        pieces = [(c, -(-n // SHARD), -(-asked[c] // GROUP)) for c, n in sizes.items() if c in asked] or [(-1, 1, 1)]
        grid = F.broadcast(rows.sparkSession.createDataFrame(pieces, "list int, shards int, groups int"))
        left = postings.join(grid, "list").select(
            "list", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "vec_id", "vector"
        )
        right = asking.join(grid, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), group.alias("group"), "vec_id", "vector", "floor"
        )
        schema = f"query_id {kind}, vec_id {kind}, score double"
        return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(compare, schema)

    no_floor = F.lit(None).cast("double").alias("floor")
    first = saved(meet(probes.where(F.col("place") < FIRST).select("vec_id", "vector", "list", no_floor)), "nearest-first")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    floors = distinct.withColumn("n", F.row_number().over(ranked)).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    others = probes.where(F.col("place") >= FIRST).join(floors, "vec_id", "left").select("vec_id", "vector", "list", "floor")
    found = first.unionByName(meet(saved(others, "nearest-others")))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
