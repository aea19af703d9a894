"""Similarity join of documents by the Jaccard index of their word 5-grams, with chosen paths.

Every different set of shingles is a point; equal sets are merged first and weigh as many documents. A point is sampled
by its SKETCH smallest shingle hashes, which similar sets share. In each run a point goes to the buckets of the tokens of its sample that
the run's hash chooses, each with probability 1 / (threshold * sample size); a bucket of more than SMALL points is split again
by tokens chosen for that bucket, up to DEPTH times. A pair at the threshold meets in a run with the survival probability of this
branching process, and the runs are as many as the target recall needs. Buckets are searched by brute force on the samples:
small ones at once, those that remain large in pairs of blocks. Before a large bucket is split, its members are compared
with one of them, the pivot: those near it are connected through it and need not meet again, unless others lie at a distance
from which the triangle inequality of the Jaccard distance allows a link.

What this finds are candidate clusters. Inside each the exact index of all pairs is computed on the whole sets, in blocks, so
that links are counted exactly once and no pair is written out: the result has one row per document.

Rows of a document table: words are separated by ASCII white space; a text of fewer than five words has one shingle. A null
text or one without words is linked with nothing. Rows with equal or null ids are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscore.llm.graph import Forest, components, runs
from hopscore.llm.storage import discard, released, saved
from hopscore.llm.words import mix, shingle_sets
from hopscore.session import broadcast_if_small

THRESHOLD, RECALL = 0.8, 0.999
SKETCH = 48
SMALL, BLOCK, DEPTH = 64, 256, 3
NONE = np.uint32(0xFFFFFFFF)


def miss(number: int, branchings: int, threshold: float = THRESHOLD) -> float:
    """Probability that a pair at the threshold never meets in ``number`` runs, even if each level had to split.

    All runs choose from the same samples, so it is the mean over the tokens that the samples share: each of SKETCH with ``threshold``.
    """
    total = 0.0
    for shared in range(SKETCH + 1):
        alive = 1.0
        for _ in range(branchings):
            alive = 1 - math.exp(-alive * shared / (threshold * SKETCH))
        total += math.comb(SKETCH, shared) * threshold**shared * (1 - threshold) ** (SKETCH - shared) * (1 - alive) ** number
    return total


def run_count(recall: float = RECALL, depth: int = DEPTH, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``: the first choice and ``depth`` more branch."""
    number = 1
    while miss(number, depth + 1, threshold) > 1 - recall:
        number += 1
    return number


def bounds(threshold: float = THRESHOLD) -> tuple[float, float]:
    """Of samples: the index of candidates, and the one under which the triangle inequality excludes a link with a candidate's."""
    near = max(0.1, threshold - 0.3)
    return near, near - (1 - threshold) - 0.18


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard index of pairs of samples (rows of sorted hashes, filled up with NONE); exact for sets within the sample."""
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    filled = both != NONE
    rank = np.cumsum(filled & ~again, axis=1)
    inside = rank <= SKETCH
    return (again & filled & inside).sum(axis=1) / np.maximum(1, np.minimum(rank[:, -1], SKETCH))


def _matrix(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint32).reshape(len(sketches), SKETCH)


def choose(paths: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child paths of the tokens chosen at each node: a token by the same hash for every set."""
    filled = sketches != NONE
    limit = 1.0 / (threshold * np.maximum(1, filled.sum(axis=1)))
    drawn = mix(sketches.astype(np.uint64) ^ mix(paths.astype(np.uint64))[:, None], 5)
    rows, columns = np.nonzero(filled & ((drawn >> np.uint64(11)) * 2.0**-53 < limit[:, None]))
    return rows, mix(drawn[rows, columns], 6).astype(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, digest, words, sketch`` per document; ``digest`` is that of the set, null for an empty one."""

    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests, sizes, sketches = [], [], []
            for values in shingle_sets(frame["text"].tolist()):
                sample = np.full(SKETCH, NONE, np.uint32)
                few = np.unique(mix(values, 9) >> np.uint64(32))[:SKETCH].astype(np.uint32)
                few = few[few != NONE]
                sample[: len(few)] = few
                digests.append(hashlib.md5(values.tobytes()).hexdigest() if len(values) else None)
                sizes.append(len(values))
                sketches.append(sample.tobytes())
            yield frame.drop(columns="text").assign(digest=digests, words=sizes, sketch=sketches)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).withColumn("text_key", F.md5("text"))
    return rows.mapInPandas(released(signed), f"doc_id {kind}, text_key string, digest string, words long, sketch binary")


def _forest(groups: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Edges that connect the candidates of each bucket, or of each pair of blocks."""
    edges: list[tuple[str, str]] = []
    least, _ = bounds(threshold)
    for group in groups:
        names, size = group["digest"].to_numpy(), len(group)
        if size < 2:
            continue
        sample, words, side = _matrix(group["sketch"]), group["words"].to_numpy(), group["side"].to_numpy()
        forest = Forest(size)
        for i in range(size - 1):
            low, high = np.minimum(words[i], words[i + 1 :]), np.maximum(words[i], words[i + 1 :])
            others = i + 1 + np.flatnonzero((low >= threshold * high) & ((side[i] != side[i + 1 :]) | (side[i] < 0)))
            others = np.array([x for x in others.tolist() if forest.find(x) != forest.find(i)], int)
            if len(others):
                near = estimates(np.broadcast_to(sample[i], (len(others), SKETCH)), sample[others]) >= least
                for x in others[near].tolist():
                    forest.join(i, x)
        edges += [(names[a], names[b]) for a, b in forest.edges]
        if len(edges) > 20_000:
            yield pd.DataFrame(edges, columns=["a", "b"])
            edges = []
    if edges:
        yield pd.DataFrame(edges, columns=["a", "b"])


def _candidates(points: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges ``(a, b)`` that connect all points which meet in a bucket and have similar samples."""
    number = run_count(recall, DEPTH, threshold)
    least, far = bounds(threshold)

    def roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sample, names = _matrix(frame["sketch"]), frame["digest"].to_numpy()
            for run in range(number):
                rows, paths = choose(np.full(len(frame), run + 1), sample, threshold)
                yield pd.DataFrame({"path": paths, "digest": names[rows]})

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, paths = choose(frame["path"].to_numpy().astype(np.int64), _matrix(frame["sketch"]), threshold)
            yield pd.DataFrame({"path": paths, "digest": frame["digest"].to_numpy()[rows]})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = estimates(_matrix(frame["sketch"]), _matrix(frame["pivot_sketch"])) if len(frame) else np.zeros(0)
            yield frame.drop(columns="pivot_sketch").assign(near=near)

    samples = points.select("digest", "words", "sketch")
    sized = lambda rows: rows.join(
        saved(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path-sizes"), "path"
    )
    level = saved(points.mapInPandas(released(roots), "path long, digest string"), "path-0")
    small, found = [], []
    for depth in range(DEPTH + 1):
        level = saved(sized(level).join(samples, "digest"), f"path-{depth}-members")
        small.append(level.where(F.col("n") <= SMALL).select("path", "digest", "words", "sketch"))
        large = level.where(F.col("n") > SMALL)
        if depth == DEPTH or large.isEmpty():
            break
        pivots = large.groupBy("path").agg(F.min(F.struct("digest", "sketch")).alias("pivot"))
        pivots = saved(pivots.select("path", F.col("pivot.digest").alias("pivot"), F.col("pivot.sketch").alias("pivot_sketch")), "pivots")
        compared = large.join(pivots, "path").mapInPandas(
            compare, "path long, digest string, n long, words long, sketch binary, pivot string, near double"
        )
        compared = saved(compared, "path-compared")
        found.append(compared.where((F.col("near") >= least) & (F.col("digest") != F.col("pivot"))).select("pivot", "digest"))
        between = compared.where((F.col("near") >= far) & (F.col("near") < least)).select("path").distinct()
        # those near the pivot meet again only where others lie between; those very near cannot be linked with such
        near = F.col("near") <= 1 - (1 - least - (1 - threshold)) + 0.15
        once_more = compared.where((F.col("near") >= least) & near).join(saved(between, "path-open"), "path", "left_semi")
        again = compared.where(F.col("near") < least).unionByName(once_more)
        level = saved(again.mapInPandas(released(split), "path long, digest string"), f"path-{depth + 1}")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    paired = (
        large.withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "path", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
            F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("side"), "digest", "words", "sketch",
        )
    )
    lone = F.lit(0)
    members = paired
    for rows in small:
        members = members.unionByName(rows.withColumns({"i": lone, "j": lone, "side": F.lit(-1)}))
    keys = ["path", "i", "j"]
    ordered = members.repartition(*keys).sortWithinPartitions(*keys)
    edges = ordered.mapInPandas(released(lambda frames: _forest(runs(frames, keys), threshold)), "a string, b string")
    for rows in found:
        edges = edges.union(rows)
    return edges.where("a != b").distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of the incidence matrix of the shingles that occur more than once."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[code] > 1
    owner, code = owner[keep], rank[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4_096
    for a in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        x, y = np.searchsorted(code, [a, a + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[x:y], code[x:y] - a] = 1
        total += part @ part.T
    return total


def _verify(groups: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Per block pair: the links of each point as ``(a, null, links)``, and edges ``(a, b, 0)`` that connect linked points."""
    out: list[tuple[str, str | None, int]] = []
    for group in groups:
        if len(group) < 2:
            continue
        names, weight, side = (group[c].to_numpy() for c in ("digest", "weight", "side"))
        sets = list(shingle_sets(group["text"].tolist()))
        sizes = np.array([len(x) for x in sets], float)
        overlap = _overlaps(sets).astype(float)
        linked = overlap >= threshold * (sizes[:, None] + sizes[None, :] - overlap) - 1e-9
        np.fill_diagonal(linked, False)
        linked &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
        counts = linked @ weight
        out += [(names[i], None, int(counts[i])) for i in np.flatnonzero(counts)]
        forest = Forest(len(group))
        for a, b in np.argwhere(np.triu(linked)).tolist():
            forest.join(a, b)
        out += [(names[a], names[b], 0) for a, b in forest.edges]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["a", "b", "links"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["a", "b", "links"])


def _classes(docs: DataFrame, signed: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``(digest, label, links, weight)`` of the points that are linked or stand for several documents."""
    points = saved(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.any_value("words").alias("words"),
            F.any_value("sketch").alias("sketch"),
            F.count("*").alias("weight"),
            F.min("text_key").alias("text_key"),
        ),
        "join-points",
    )
    clusters = components(_candidates(points, threshold, recall))
    sizes = clusters.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = clusters.withColumnRenamed("node", "digest").join(points.select("digest", "weight", "text_key"), "digest")
    members = saved(members.join(saved(sizes, "cluster-sizes"), "label"), "join-members")
    texts = docs.select(F.col("text").alias("text"), F.md5("text").alias("text_key")).where("text is not null")
    wanted = broadcast_if_small(members.select("text_key"), "text_key")  # few texts are in a cluster; the others stay where they are
    texts = texts.join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.any_value("text").alias("text"))
    mine = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    paired = (
        members.join(texts, "text_key").withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
            F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("side"), "digest", "weight", "text",
        )
    )
    keys = ["label", "i", "j"]
    ordered = paired.repartition(*keys).sortWithinPartitions(*keys)
    verified = saved(
        ordered.mapInPandas(released(lambda frames: _verify(runs(frames, keys), threshold)), "a string, b string, links long"), "join-links"
    )
    labels = components(verified.where("b is not null").select("a", "b"))
    links = verified.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    linked = labels.withColumnRenamed("node", "digest").join(links, "digest")
    several = points.select("digest", "weight").join(linked, "digest", "left").where("weight > 1 or label is not null")
    classes = several.select("digest", F.coalesce("label", "digest").alias("label"), F.coalesce("links", F.lit(0)).alias("links"), "weight")
    classes = saved(classes, "join-classes")
    discard(members, verified)
    return classes


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links``: the least id connected with a document, and the documents directly linked with it."""
    signed = saved(sign(docs), "join-signed")
    classes = _classes(docs, signed, threshold, recall)
    mine = signed.select("doc_id", "digest").join(classes, "digest", "left")
    least = mine.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return mine.join(saved(least, "join-least"), "label", "left").select(
        "doc_id",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One text of each class stays, that of the least id (then of the least digest), with all columns of its rows."""
    signed = saved(sign(docs), "join-signed")
    classes = _classes(docs, signed, threshold, recall)
    mine = signed.select("doc_id", "text_key", "digest").join(classes.select("digest", "label"), "digest")
    kept = mine.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("kept"))
    kept = saved(kept.select("label", F.col("kept.text_key").alias("kept")), "join-kept")
    dropped = saved(mine.join(kept, "label").where("text_key != kept").select("text_key").distinct(), "join-dropped")
    rows = docs.select(F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row"), F.md5("text").alias("text_key"))
    dropped = broadcast_if_small(dropped, "text_key")  # mostly few beside the rows, which then stay where they are
    return rows.join(dropped, "text_key", "left_anti").select("row.*")
