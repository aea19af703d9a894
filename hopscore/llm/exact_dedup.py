"""Exact duplicates by an extendible-hash index in shared files, with DataFrame operations only.

Rows of a document table: a null text counts as empty; texts are equal when their bytes are. Of equal texts the one with the
largest id stays; rows that repeat id and text are the same document, and all of them count and carry the same result. A
null id loses against any other; a group with null ids only keeps them. Other columns are not read.

The index has one entry for each distinct text, under the 64-bit hash of its bytes. A bucket is a prefix of that hash. While a bucket has
more than ``capacity`` hashes it splits, that is, its prefix grows by one bit; where a prefix outgrows the directory, the directory doubles. Its
places point to buckets, and every row, when the index is built as well as when it is read, goes to its bucket by the place of its hash. The owner
task of a bucket chains the texts of equal hash and decides groups: hashes and digests travel first, and only texts whose digest occurs
several times follow, merged per task, to be compared byte by byte. A lookup meets the entries of its bucket and hash only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopscore.llm.storage import discard, saved

CAPACITY = 50_000  # hashes in a bucket
DEEPEST = 24  # bits of the directory at most: 2**24 places of 50,000 hashes; with such a directory buckets grow instead
FEW_BYTES = 64 << 20  # most measured bytes of repeated digests that are broadcast, so that no other text is shuffled
ENTRY_BYTES = 64  # of a broadcast hash and digest

BUCKET = ["depth", "slot"]


def _rows(docs: DataFrame, hashed: Callable[[Column], Column], carried: Sequence[str] = ("doc_id",)) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*carried).alias("carried"), F.col("doc_id").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"key": hashed(F.col("text")).cast("long"), "digest": F.unhex(F.sha2("text", 256))})


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


@dataclass
class Index:
    """``entries``: ``depth, slot, key, chain, digest, text, keep_id, group_size``, one row for each distinct text, in files of the owners.
    ``places``: ``place, depth, slot``, the directory of ``2**bits`` places."""

    entries: DataFrame
    places: DataFrame
    bits: int

    def routed(self, rows: DataFrame) -> DataFrame:
        """Rows with the bucket that the directory sends their hash to."""
        return rows.withColumn("place", _slot(self.bits)).join(self.places, "place").drop("place")


def split_buckets(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory of distinct hashes (column ``key``) and its bits. In each round the overfull buckets split and the directory doubles."""
    bits, pending, closed = 0, keys.select("key"), []
    while True:
        loads = saved(pending.groupBy(_slot(bits).alias("slot")).agg(F.count("*").alias("keys")), "bucket-loads")
        overfull = loads.where(F.col("keys") > capacity) if bits < DEEPEST else loads.limit(0)
        done = loads.where(F.col("keys") <= capacity) if bits < DEEPEST else loads
        closed.append(done.select(F.lit(bits).alias("depth"), "slot"))
        if overfull.isEmpty():
            break
        pending = pending.withColumn("slot", _slot(bits)).join(overfull.select("slot"), "slot", "left_semi").select("key")
        bits += 1
    buckets = reduce(DataFrame.unionByName, closed)
    wide = F.lit(bits) - F.col("depth")
    first, end = F.call_function("shiftleft", F.col("slot"), wide), F.call_function("shiftleft", F.col("slot") + 1, wide)
    return saved(buckets.select(F.explode(F.sequence(first, end - 1)).alias("place"), *BUCKET), "directory"), bits


def build_index(docs: DataFrame, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> Index:
    """Entries of all texts. ``chain`` numbers the texts of one hash from 0. ``digest`` is null in the entries of texts that share
    hash and digest with another text; they carry their ``text``, which is null elsewhere."""
    rows = _rows(docs, hashed)
    seen = rows.groupBy("key", "digest").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    seen = saved(seen, "index-seen")  # merged in each task before the shuffle: hashes, digests and ids, no text
    places, bits = split_buckets(seen.select("key").distinct(), capacity)
    index = Index(seen, places, bits)
    routed = index.routed(seen)
    single = routed.where("group_size = 1").withColumn("text", F.lit(None).cast("string"))
    repeated = routed.where("group_size > 1").select(*BUCKET, "key", "digest")
    few = repeated.count() * ENTRY_BYTES <= FEW_BYTES
    again = rows.join(F.broadcast(repeated) if few else repeated, ["key", "digest"])
    texts = again.groupBy(*BUCKET, "key", "digest", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    # Owners: all entries of a bucket meet in one task, which chains them; equal texts have become one entry on the way.
    same = Window.partitionBy(*BUCKET, "key", "digest")
    compared = texts.withColumn("clash", F.count("*").over(same) > 1)
    compared = compared.withColumns(
        {"digest": F.when(~F.col("clash"), F.col("digest")), "text": F.when(F.col("clash"), F.col("text"))}
    )
    columns = [*BUCKET, "key", "digest", "text", "group_size", "keep_id"]
    entries = compared.select(columns).unionByName(single.select(columns)).repartition(*BUCKET)
    order = Window.partitionBy(*BUCKET, "key").orderBy("digest", "text")
    chained = entries.withColumn("chain", (F.row_number().over(order) - 1).cast("long"))
    index.entries = saved(chained.sortWithinPartitions(*BUCKET, "key", "chain"), "index")
    discard(seen)
    return index


def _found(docs: DataFrame, index: Index, hashed: Callable[[Column], Column], carried: Sequence[str]) -> DataFrame:
    """Every row with the entry of its text where that stands for several rows: from its bucket, by hash and digest, or by its text in the
    chain of a hash where digests do not tell. Joins that adaptive execution can split."""
    rows = index.routed(_rows(docs, hashed, carried))
    columns = ["carried", "doc_id", "digest", "keep_id", "group_size"]
    held = index.entries.where("group_size > 1 or digest is null")
    groups = held.where("digest is not null").select(*BUCKET, "key", "digest", "keep_id", "group_size")
    chained = held.where("digest is null").select(*BUCKET, "key", "text", "keep_id", "group_size")
    if chained.isEmpty():
        return rows.drop("text").join(groups, [*BUCKET, "key", "digest"], "left").select(columns)
    names = chained.select(*BUCKET, "key", "text")
    alone = rows.join(names, [*BUCKET, "key", "text"], "left_anti").drop("text").join(groups, [*BUCKET, "key", "digest"], "left")
    return alone.select(columns).unionByName(rows.join(chained, [*BUCKET, "key", "text"]).select(columns))


def lookup(index: Index, text: str, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The entry of one text, if it has one: its bucket is found in the directory, and only entries of that bucket and hash are read."""
    spark = index.entries.sparkSession
    asked = index.routed(_rows(spark.createDataFrame([(None, text)], "doc_id long, text string"), hashed)).first()
    if asked is None:
        return index.entries.limit(0)
    here = index.entries.where((F.col("depth") == asked.depth) & (F.col("slot") == asked.slot) & (F.col("key") == asked.key))
    return here.where((F.col("digest") == F.lit(bytes(asked.digest))) | (F.col("digest").isNull() & (F.col("text") == text)))


def _stays() -> Column:
    return F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))


def exact_duplicates(
    docs: DataFrame, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per document, found in the index by its hash."""
    return _found(docs, build_index(docs, capacity, hashed), hashed, ["doc_id"]).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        _stays().alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """The documents that stay, with all their columns."""
    return _found(docs, build_index(docs, capacity, hashed), hashed, docs.columns).where(_stays()).select("carried.*")
