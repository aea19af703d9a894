"""Prefix trie of conversations by a skeleton of splitter paths.

A path is the turns of a conversation, each as 16 bytes of the SHA-256 of role and text and 4 bytes with the number of words; as the steps have
a fixed width, the byte order of paths is the order of a depth-first walk through the trie. Equal conversations become one path first.
Paths are dealt to shards by splitters, a sample's quantiles cut at ``DEEPEST`` turns. A node whose members stand in more than
one shard is a prefix of a splitter; the trie of the splitters, the skeleton, is broadcast (at most ``SHARDS * DEEPEST`` nodes). Each shard
walks its sorted paths with a stack and finishes all nodes that are not in the skeleton; for those it adds up what lies directly below, and
these parts are reduced by node and summed up from the leaves of the skeleton.

Rows: conversations without an id take no part; null roles and texts are empty ones. Turns stand in order of ``turn``, null first,
ties in order of the digest of role and text; repeated rows are turns of their own. An empty table has no root. Other columns are not
read. A conversation is a record: its steps (20 bytes a turn), not its texts, are held in one row.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscore.llm.storage import saved

STEP = 20  # bytes of a turn in a path
SHARDS, DEEPEST = 1_000, 64  # shards at most, and turns of a splitter
SAMPLED = 32  # paths sampled per shard
BLOCK = 12  # ids of 2**BLOCK numbers are hashed as one text
NOTHING = hashlib.sha256(b"").hexdigest()


def steps(rows: DataFrame) -> DataFrame:
    """``conv_id, steps``: the turns of every conversation in order, as hexadecimal steps."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    words = F.lpad(F.lower(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")))), 8, "0")
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.concat(digest, words).alias("step")).alias("turn")
    )
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.col("turns.step").alias("steps"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation ``c`` with its first ``h`` turns replaced by those of conversation ``c - c % every``; ``h`` is the CRC-32 of the
    decimal id modulo ``most``. Fewer turns there give as many, a missing conversation gives none."""
    base = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("steps", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = conversations.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    head = F.coalesce("head", F.array().cast("array<string>"))
    return joined.select("conv_id", F.concat(F.slice(head, F.lit(1), h), F.slice("steps", h + 1, F.greatest(F.size("steps"), F.lit(1)))).alias("steps"))


def paths(conversations: DataFrame) -> DataFrame:
    """``path, low, n, ends``: each distinct path, its smallest id, the number of its conversations and the SHA-256 of their ids.

    Ids are gathered in blocks of neighbouring numbers, so that no row holds all ids of a large group; the hash of a path of several blocks
    reads them in order, one at a time.
    """
    ids = conversations.select(F.unhex(F.array_join("steps", "")).alias("path"), "conv_id", F.shiftright("conv_id", BLOCK).alias("block"))
    blocks = ids.groupBy("path", "block").agg(
        F.min("conv_id").alias("low"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    blocks = saved(blocks, "trie-blocks")
    counts = blocks.groupBy("path").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.count("*").alias("blocks"), F.max("ids").alias("ids"))
    single = counts.where("blocks = 1").select("path", "low", "n", F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))
    several = counts.where("blocks > 1").select("path", "low", "n")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, sha = None, None
        for frame in frames:
            for own, ids in zip(frame["path"], frame["ids"], strict=True):
                if own != path:
                    if sha is not None:
                        yield pd.DataFrame({"path": [path], "ends": [sha.hexdigest()]})
                    path, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha is not None:
            yield pd.DataFrame({"path": [path], "ends": [sha.hexdigest()]})

    wide = blocks.join(several.select("path"), "path", "left_semi").select("path", "block", "ids")
    hashed = wide.repartition("path").sortWithinPartitions("path", "block").select("path", "ids").mapInPandas(digest, "path binary, ends string")
    return single.union(several.join(hashed, "path").select("path", "low", "n", "ends"))


class Skeleton:
    """The trie of the splitters: ``number`` of a child by parent and step; a parent's number is smaller than its child's."""

    def __init__(self, sample: list[bytes], shards: int):
        ordered = sorted(sample)
        self.splitters = sorted({ordered[len(ordered) * i // shards] for i in range(1, shards)} - {b""}) if ordered else []
        self.number: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.words = [-1], [0], [0]
        for path in self.splitters:
            node = 0
            for i in range(0, len(path), STEP):
                key = (node, path[i : i + STEP])
                if key not in self.number:
                    self.number[key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(i // STEP + 1)
                    self.words.append(words_of(key[1]))
                node = self.number[key]

    def shard(self, path: bytes) -> int:
        return bisect.bisect_right(self.splitters, path)


def words_of(step: bytes) -> int:
    return int.from_bytes(step[-4:], "big")


def common_steps(a: bytes, b: bytes) -> int:
    """How many steps two paths share at their beginning."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * STEP : middle * STEP] == b[low * STEP : middle * STEP]:
            low = middle
        else:
            high = middle - 1
    return low


class Walk:
    """A depth-first walk over sorted paths. ``out`` gathers finished nodes and, with ``skeleton`` set, parts of skeleton nodes."""

    COLUMNS = ("skeleton", "conv_id", "depth", "parent_conv_id", "parent_skeleton", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")

    def __init__(self, skeleton: Skeleton):
        self.number = skeleton.number
        self.out: list[tuple] = []
        self.stack: list[dict] = []
        self.last = b""

    def _open(self, number: int | None, words: int) -> None:
        self.stack.append({"number": number, "words": words, "low": None, "n": 0, "children": 0, "leaves": 0, "saved": 0, "ends": None, "below": []})

    def add(self, path: bytes, low: int, n: int, ends: str) -> None:
        keep = common_steps(path, self.last) if self.stack else 0
        if not self.stack:
            self._open(0, 0)
        while len(self.stack) > keep + 1:
            self._close()
        for i in range(keep * STEP, len(path), STEP):
            above, step = self.stack[-1]["number"], path[i : i + STEP]
            self._open(None if above is None else self.number.get((above, step)), words_of(step))
        own = self.stack[-1]
        own["low"], own["n"], own["ends"] = low if own["low"] is None else min(low, own["low"]), own["n"] + n, ends
        self.last = path

    def _close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        if node["number"] is not None:  # what lies above a skeleton node is summed up from the reduced parts
            self.out.append((node["number"], node["low"], depth, None, None, node["n"], node["children"], node["leaves"], node["saved"], node["ends"]))
            return
        leaves, spared = node["leaves"] or 1, node["saved"] + (node["n"] - 1) * node["words"]
        self.out += [(*row[:3], node["low"], *row[4:]) for row in node["below"]]
        above = self.stack[-1]
        row = (None, node["low"], depth, None, above["number"], node["n"], node["children"], leaves, spared, node["ends"])
        (above["below"] if above["number"] is None else self.out).append(row)
        above["low"] = node["low"] if above["low"] is None else min(above["low"], node["low"])
        above["n"] += node["n"]
        above["children"] += 1
        above["leaves"] += leaves
        above["saved"] += spared

    def end(self) -> None:
        while self.stack:
            self._close()
        self.last = b""

    def take(self) -> pd.DataFrame:
        frame = pd.DataFrame(self.out, columns=self.COLUMNS, dtype=object)
        self.out = []
        return frame


def combined(skeleton: Skeleton, parts: dict[int, tuple]) -> list[tuple]:
    """The skeleton's nodes, complete: parts ``(low, n, children, leaves, saved, ends)`` summed up from the deepest."""
    size = len(skeleton.parent)
    low, n, children, leaves, spared, ends = ([parts[i][k] if i in parts else None for i in range(size)] for k in range(6))
    n, children, leaves, spared = ([x or 0 for x in column] for column in (n, children, leaves, spared))
    for node in range(size - 1, -1, -1):
        leaves[node] = leaves[node] if children[node] else 1
        spared[node] += (n[node] - 1) * skeleton.words[node]
        above = skeleton.parent[node]
        if above >= 0 and n[node]:
            low[above] = low[node] if low[above] is None else min(low[above], low[node])
            n[above] += n[node]
            children[above] += 1
            leaves[above] += leaves[node]
            spared[above] += spared[node]
    names = [low[above] if above >= 0 else None for above in skeleton.parent]
    return [(i, low[i], skeleton.depth[i], names[i], n[i], children[i], leaves[i], spared[i], ends[i]) for i in range(size) if n[i]]


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conv_id, steps``: smallest member, depth, the parent's smallest member, and counts."""
    spark = conversations.sparkSession
    distinct = saved(paths(conversations), "trie-paths")
    shards = min(SHARDS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    drawn = distinct.select(F.substring("path", 1, STEP * DEEPEST).alias("path"), F.xxhash64("path").alias("h"))
    sample = [bytes(row[0]) for row in drawn.orderBy("h", "path").limit(SAMPLED * shards).collect()]  # paths of at most DEEPEST turns
    skeleton = Skeleton(sample, shards)
    shared = spark.sparkContext.broadcast(skeleton)  # at most SHARDS * DEEPEST nodes

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(shard=[shared.value.shard(bytes(path)) for path in frame["path"]])

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk, shard = Walk(shared.value), None
        for frame in frames:
            for own, *row in zip(frame["shard"], frame["path"], frame["low"], frame["n"], frame["ends"], strict=True):
                if own != shard:
                    walk.end()
                    shard = own
                walk.add(bytes(row[0]), *row[1:])
            yield walk.take()
        walk.end()
        yield walk.take()

    dealt = distinct.mapInPandas(deal, "path binary, low long, n long, ends string, shard int")
    sharded = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path")
    counted = "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
    nodes = sharded.mapInPandas(finish, f"skeleton int, conv_id long, depth long, parent_conv_id long, parent_skeleton int, {counted}")
    nodes = saved(nodes, "trie-nodes")
    parts = nodes.where("skeleton is not null").groupBy("skeleton").agg(
        F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("ends")
    )
    whole = combined(skeleton, {row[0]: tuple(row[1:]) for row in parts.collect()})  # at most SHARDS * DEEPEST rows
    top = spark.createDataFrame(whole, f"skeleton int, conv_id long, depth long, parent_conv_id long, {counted}")
    names = F.broadcast(top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above")))
    rest = nodes.where("skeleton is null").join(names, "parent_skeleton", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(columns)
    every = top.select(columns).union(rest)
    return every.select(*columns[:-1], ends_digest(F.col("ends")).alias("ends_sha256"))


def ends_digest(ends: Column) -> Column:
    """Nodes at which no conversation ends have the digest of no ids."""
    return F.coalesce(ends, F.lit(NOTHING))
