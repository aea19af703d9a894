"""Benchmark decontamination as a prefix-filtered set join of item windows with documents.

Words are maximal runs of digits, letters a-z (after lower-casing A-Z) and characters beyond ASCII. A window is a run of ten words of an
item; an item of fewer words is one window. Every window is a set of five-word shingles (a shorter one is one shingle), and a
document contains it only if it holds all of them, so one necessary shingle, the rarest, is enough to join on. The steps:

1. Documents are read once; shingles that no window has are dropped by a bitmap of fixed size. What is left is counted.
2. Each window keeps its rarest shingle by these counts; a window with a shingle of count 0 occurs nowhere.
3. Occurrences meet windows by that shingle; bounds on length and position and then all words of the window are compared.

Nothing that grows with the documents or the benchmark goes through the driver: only the bitmap, at most ``MOST_BITS`` bits. Equal
texts are matched once. Rows: a null or empty text has no words and no hits, a null id is kept, a repeated row is answered as often
as it stands there. An item without an id hits documents but is in no list of items; items that repeat an id count once, with the
windows of all their rows. An item without words and an empty benchmark match nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopscore.llm.storage import saved
from hopscore.llm.words import hash_words, in_parts, mix

WIDTH, SHINGLE = 10, 5  # words of a window and of a shingle
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 25, 1 << 28, 4_096  # of the bitmap, and how many are wanted per shingle
BUCKET = 1 << 15  # bits in a row of bitmap_construct_agg

#: Bytes of words as they are, in lower case, and everything else as blanks; all bytes of characters beyond ASCII belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PLACES = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


class Folded:
    """The words of several texts: byte ranges in ``raw``, and ``first`` word per text."""

    def __init__(self, texts: list[str | None]):
        encoded = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
        self.raw = b"\n".join(encoded).translate(_FOLD)
        offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in encoded])))
        self.hashes, self.starts, self.ends = hash_words(self.raw)
        self.first = np.searchsorted(self.starts, offsets)
        self.keys = encoded

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all runs of ``length`` words that lie in one text."""
        count = max(len(self.hashes) - length + 1, 0)
        with np.errstate(over="ignore"):
            sums = np.zeros(count, np.uint64)
            for i in range(length):
                sums += self.hashes[i : count + i] * _PLACES[i]
        inside = np.ones(count, bool)
        for tail in range(1, length):
            at = self.first[1:] - tail
            inside[at[(at >= 0) & (at < count)]] = False
        places = np.flatnonzero(inside)
        return places, mix(sums[places], 100 + length)

    def words(self, a: int, b: int) -> str:
        return b" ".join(self.raw[self.starts[i] : self.ends[i]] for i in range(a, b)).decode("utf-8", "surrogatepass")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, window, n, grams``: every window of every item as its words, their number and the hashes of its shingles."""
    kind = items.schema[item_id].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, texts = frame["item_id"].tolist(), frame["text"].tolist()
            for a, b in in_parts(texts):
                folded = Folded(texts[a:b])
                hashes = {length: dict(zip(*(x.tolist() for x in folded.grams(length)), strict=True)) for length in range(1, SHINGLE + 1)}
                for i in range(b - a):
                    low, high = int(folded.first[i]), int(folded.first[i + 1])
                    n = min(WIDTH, high - low)
                    length = min(n, SHINGLE)
                    rows = [
                        (ids[a + i], folded.words(s, s + n), n, [_signed(hashes[length][s + o]) for o in range(n - length + 1)])
                        for s in (range(low, high - n + 1) if n else ())
                    ]
                    yield pd.DataFrame(rows, columns=["item_id", "window", "n", "grams"])

    chosen = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return chosen.mapInPandas(cut, f"item_id {kind}, window string, n int, grams array<bigint>")


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def bitmap_of(grams: DataFrame) -> np.ndarray:
    """Bits of the hashes in column ``gram``, as bytes; a power of two of them, at most ``MOST_BITS``."""
    wanted = BITS_EACH * grams.agg(F.approx_count_distinct("gram")).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(wanted).bit_length()))
    place = F.col("gram").bitwiseAND(F.lit(bits - 1)) + 1
    parts = grams.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = np.zeros(bits // 8, np.uint8)
    for bucket, part in parts.collect():  # at most MOST_BITS / BUCKET rows
        out[(bucket - 1) * BUCKET // 8 : bucket * BUCKET // 8] = np.frombuffer(part, np.uint8)[: len(out)]
    return out


def occurrences(docs: DataFrame, bitmap: np.ndarray, lengths: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its number of words and, where shingles pass the bitmap, a digest of its text with their places,
    hashes and surrounding words."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # at most MOST_BITS
    before, behind = WIDTH - SHINGLE, WIDTH

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        mask = np.uint64(8 * len(bits) - 1)
        for frame in frames:
            ids, texts = frame["doc_id"], frame["text"].tolist()
            for a, b in in_parts(texts):
                folded = Folded(texts[a:b])
                counts = np.diff(folded.first)
                found: dict[int, list[list]] = {}
                for length in lengths:
                    places, hashes = folded.grams(length)
                    at = hashes & mask
                    passed = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                    owners = np.searchsorted(folded.first, places[passed], side="right") - 1
                    for place, value, i in zip(places[passed].tolist(), hashes[passed].view(np.int64).tolist(), owners.tolist(), strict=True):
                        low, high = int(folded.first[i]), int(folded.first[i + 1])
                        own = found.setdefault(i, [[], [], []])
                        own[0].append(place - low)
                        own[1].append(value)
                        own[2].append(folded.words(max(low, place - before), min(high, place + behind)))
                keys = [hashlib.sha256(folded.keys[i]).digest() if i in found else None for i in range(b - a)]
                columns = [[found[i][c] if i in found else None for i in range(b - a)] for c in range(3)]
                yield pd.DataFrame(
                    {"doc_id": ids.iloc[a:b].to_numpy(), "n_words": counts, "text_key": keys, "at": columns[0], "gram": columns[1], "around": columns[2]}
                )

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, n_words long, text_key binary, at array<int>, gram array<bigint>, around array<string>"
    return chosen.mapInPandas(scan, schema)


def necessary(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """``window, n, gram, offset``: the rarest shingle of each window by ``counts``; windows with a shingle that never occurs are left out."""
    each = distinct.select("window", "n", F.posexplode("grams").alias("offset", "gram"))
    rated = each.join(counts, "gram", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    least = rated.groupBy("window", "n").agg(F.min_by(F.struct("count", "gram", "offset"), F.struct("count", "gram", "offset")).alias("least"))
    return least.where("least.count > 0").select("window", "n", "least.gram", "least.offset")


def _starts_here() -> Column:
    """All words of the window stand at ``start``: bounds first, then the words."""
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    shift = F.greatest(start - F.greatest(F.col("at") - (WIDTH - SHINGLE), F.lit(0)) + 1, F.lit(1))
    return inside & (F.array_join(F.slice(F.split("around", " "), shift, F.col("n")), " ") == F.col("window"))


def find_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with the digest of their text if any shingle passed; hits ``text_key, start, n, window``; and ``window, item_id``."""
    held = saved(windows(items), "bench-windows")
    distinct = held.select("window", "n", "grams").dropDuplicates(["window"])
    grams = distinct.select(F.explode("grams").alias("gram"))
    lengths = sorted(row[0] for row in held.select(F.least("n", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE rows
    scanned = saved(occurrences(docs, bitmap_of(grams), lengths), "bench-occurrences")
    texts = scanned.where("text_key is not null").dropDuplicates(["text_key"])
    each = texts.select("text_key", "n_words", F.explode(F.arrays_zip("at", "gram", "around")).alias("x"))
    each = each.select("text_key", "n_words", "x.at", "x.gram", "x.around")
    chosen = necessary(distinct, each.groupBy("gram").count())
    hits = each.join(chosen, "gram").where(_starts_here())
    hits = saved(hits.select("text_key", (F.col("at") - F.col("offset")).alias("start"), "n", "window"), "bench-hits")
    return scanned, hits, held.select("window", "item_id").distinct()


def spans(hits: DataFrame) -> DataFrame:
    """``text_key, first, end``: the merged ranges of hit words of each text."""
    order = Window.partitionBy("text_key").orderBy("start", "n")
    ends = hits.select("text_key", "start", "n", F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"))
    opens = ends.withColumn("part", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(order))
    return opens.groupBy("text_key", "part").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("n")).alias("end")).drop("part")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items`` (sorted as text) and ``contaminated``."""
    scanned, hits, owners = find_windows(docs, items)
    hit = spans(hits).groupBy("text_key").agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"))
    named = hits.select("text_key", "window").distinct().join(owners, "window").where("item_id is not null")
    lists = named.groupBy("text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = hit.join(lists, "text_key", "left")
    touched = scanned.where("text_key is not null").select("doc_id", "n_words", "text_key").join(found, "text_key", "left")
    clean = scanned.where("text_key is null").select("doc_id", "n_words", F.lit(0).alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    rows = touched.select("doc_id", "n_words", "n_hit", "items").union(clean)
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), (n_hit > 0).alias("contaminated"))


def contamination_digests(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The result of :func:`contamination` with the number and the SHA-256 of the items instead of their list."""
    found = contamination(docs, items)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")
