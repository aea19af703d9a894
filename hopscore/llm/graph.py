"""Connected components of an edge table, and complete runs of sorted keys inside Python workers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscore.llm.storage import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the edges ``(a, b)``: the smallest node it is connected with.

    In each round a node takes the least label of itself and its neighbours, then the label of the node it is named
    after, so that the distance to the least node halves. Labels are written between rounds; nothing is collected.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    both = saved(both, "component-edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        names = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = saved(taken.join(names, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        settled = jumped.where("old != label").isEmpty()
        discard(labels)
        labels = jumped.select("node", "label")
        if settled:
            discard(both)
            return labels


def runs(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key together, from batches of rows sorted by the keys."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        columns = [frame[key].to_numpy() for key in keys]
        change = np.zeros(len(frame), bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(frame)]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(column[a] for column in columns)
            if held and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(frame.iloc[a:b])
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


class Forest:
    """Joins items 0 .. size - 1 and remembers the pairs that joined two parts."""

    def __init__(self, size: int):
        self.parent = list(range(size))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))
