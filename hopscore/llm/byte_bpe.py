"""Byte-level BPE of whole texts: overlapping chunks are pre-tokenised in parallel, stitched, encoded in pieces, and decoded.

A text longer than a chunk is cut into chunks that overlap. Each chunk is pre-tokenised from its own first character. The first
chunk starts at a true boundary; a later one does not, but as a match depends only on where it starts and on what follows, the
two agree from the first boundary on that both have in their overlap. There the text is cut, if the character before is no white space:
what a run of white space becomes depends on whether a word follows it, and a piece must not end in one. Where an overlap
has no such boundary (one run of letters longer than the overlap), the rest of the text stays one piece. Pieces are
encoded apart, each pre-token alone, and the ids and bytes of a text's pieces are put together in order.

Rows of a document table: a null or empty text has no ids. Rows with a null or repeated id are encoded like any other. Equal
long texts are encoded once, by their digest. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 32_768  # characters
OVERLAP = 1_024
MARGIN = 64  # characters at the end of a chunk whose boundaries are not trusted

_encodings: dict[tuple[str, str], object] = {}


def encoding(ranks: str, pattern: str):
    """The worker's tiktoken encoding for a file of ranks."""
    if (ranks, pattern) not in _encodings:
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _encodings[ranks, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[ranks, pattern]


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens of ``text`` start, if it is matched from its first character."""
    import regex

    return [match.start() for match in regex.finditer(pattern, text)]


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def cut_positions(long: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(digest, cuts)``: the positions at which the pre-tokens of a long text allow it to be cut."""

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for digest, text in zip(frame["digest"], frame["text"], strict=True):
                starts = range(0, len(text), chunk)
                for first in range(0, len(starts), 64):
                    some = starts[first : first + 64]
                    yield pd.DataFrame(
                        {"digest": digest, "start": list(some), "text": [text[s : s + chunk + overlap] for s in some]}
                    )

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heads, tails = [], []
            for start, text in zip(frame["start"], frame["text"], strict=True):
                found = boundaries(text, pattern)
                heads.append([start + x for x in found if x <= overlap])
                safe = len(text) - min(MARGIN, overlap // 4)
                tails.append([start + x for x in found if chunk <= x < safe and not text[x - 1].isspace()])
            yield pd.DataFrame({"digest": frame["digest"], "start": frame["start"], "head": heads, "tail": tails})

    spread = long.mapInPandas(chunks, "digest string, start long, text string").repartition("digest", "start")
    found = spread.mapInPandas(matched, "digest string, start long, head array<long>, tail array<long>")
    order = Window.partitionBy("digest").orderBy("start")
    joint = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    cuts = found.select("digest", "start", joint.alias("cut"), F.lead("start").over(order).alias("next"))
    broken = F.max(F.when(F.col("next").isNotNull() & F.col("cut").isNull(), 1).otherwise(0))
    proven = broken.over(order.rowsBetween(Window.unboundedPreceding, 0)) == 0
    cuts = cuts.withColumn("proven", proven).where("proven and cut is not null")
    return cuts.groupBy("digest").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))


def encode_documents(
    docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids in decimal and of the bytes decoded from them."""
    rows = _numbered(docs)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoding(ranks, pattern)
        for frame in frames:
            counts, ids_digests, byte_digests = [], [], []
            for text in frame["text"]:
                ids = bpe.encode_ordinary(text)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                byte_digests.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"], "n_tokens": counts, "ids_sha256": ids_digests, "decoded_sha256": byte_digests}
            )

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for digest, text, cuts in zip(frame["digest"], frame["text"], frame["cuts"], strict=True):
                ends = [0, *([] if cuts is None else cuts), len(text)]
                for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    yield pd.DataFrame({"digest": [digest], "piece": [i], "text": [text[a:b]]})

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoding(ranks, pattern)
        for frame in frames:
            ids = [bpe.encode_ordinary(text) for text in frame["text"]]
            yield pd.DataFrame(
                {
                    "digest": frame["digest"],
                    "piece": frame["piece"],
                    "n": [len(x) for x in ids],
                    "ids": [" ".join(map(str, x)) for x in ids],
                    "raw": [bpe.decode_bytes(x) for x in ids],
                }
            )

    def stitched(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece")
        ids_digest, byte_digest = hashlib.sha256(), hashlib.sha256()
        for i, (ids, raw) in enumerate(zip(frame["ids"], frame["raw"], strict=True)):
            ids_digest.update((" " * (i > 0) + ids).encode())
            byte_digest.update(raw)
        found = [frame["digest"].iloc[0], int(frame["n"].sum()), ids_digest.hexdigest(), byte_digest.hexdigest()]
        return pd.DataFrame([found], columns=["digest", "n_tokens", "ids_sha256", "decoded_sha256"])

    results = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    types = dict(docs.dtypes)
    short = rows.where(F.length("text") <= chunk).mapInPandas(whole, f"doc_id {types['doc_id']}, {results}")
    long = rows.where(F.length("text") > chunk).withColumn("digest", F.sha2("text", 256))
    texts = long.select("digest", "text").groupBy("digest").agg(F.any_value("text").alias("text"))  # equal texts once
    cut = texts.join(cut_positions(texts, pattern, chunk, overlap), "digest", "left")
    spread = cut.mapInPandas(pieces, "digest string, piece long, text string").repartition("digest", "piece")
    parts = spread.mapInPandas(encoded, "digest string, piece long, n long, ids string, raw binary")
    whole_texts = parts.groupBy("digest").applyInPandas(stitched, f"digest string, {results}")
    return short.unionByName(long.select("doc_id", "digest").join(whole_texts, "digest").drop("digest"))


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Rows with ``ids`` (array of int) to the same rows with ``raw``, the bytes of their tokens in a row."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoding(ranks, pattern)
        for frame in frames:
            yield frame.assign(raw=[None if ids is None else bpe.decode_bytes(list(ids)) for ids in frame["ids"]])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes if name != "raw")
    return encoded.drop("raw").mapInPandas(decode, f"{fields}, raw binary")
