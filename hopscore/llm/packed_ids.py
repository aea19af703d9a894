"""Token ids in fixed-width bit-packed files with block offsets, written in ascending order of documents and read back.

A file holds the documents of one range of ids: ``HIDS``, the packed blocks, an index and a footer. Every id takes ``width``
bits, the fewest that hold the largest id of the vocabulary; bit k of an id is bit k of the stream (least
significant first). A block holds BLOCK ids, so that it fills whole bytes; the index has the byte offset of each block, the
document ids and the running count of their tokens. With it any document is read from its own blocks alone.

Rows of a document table: a null or empty text has only the end id. A null doc_id comes first. Rows that repeat an id stand in
the same file, next to each other. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopscore.llm.storage import file_system, released, saved, shared_folder
from hopscore.llm.tokens import encoder
from hopscore.llm.words import in_parts

BLOCK = 65_536  # ids; a multiple of 8, so that a block ends at a byte
MAGIC = b"HIDS"


def bit_width(vocabulary: int) -> int:
    """The bits that ids below ``vocabulary`` need."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as a stream of ``width`` bits each; the last byte is filled with zeros."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(ids, f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, count: int, width: int) -> np.ndarray:
    """The first ``count`` ids of a stream."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class IdsWriter:
    """Writes documents in order; only the block in hand and the index are held."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.rest: list[np.ndarray] = []
        self.pending, self.at = 0, len(MAGIC)
        self.blocks, self.doc_ids, self.ends = [], [], []
        self.total = 0
        stream.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.width)
        self.blocks.append(self.at)
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.total += len(ids)
        self.ends.append(self.total)
        self.rest.append(ids)
        self.pending += len(ids)
        if self.pending >= BLOCK:
            stream = np.concatenate(self.rest)
            whole = len(stream) // BLOCK * BLOCK
            for a in range(0, whole, BLOCK):
                self._block(stream[a : a + BLOCK])
            self.rest, self.pending = [stream[whole:]], len(stream) - whole

    def close(self) -> None:
        if self.pending:
            self._block(np.concatenate(self.rest))
        named = np.array([x is not None for x in self.doc_ids], np.uint8)
        self.stream.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.stream.write(named.tobytes())
        self.stream.write(np.array(self.ends, "<u8").tobytes())
        self.stream.write(np.array(self.blocks, "<u8").tobytes())
        self.stream.write(struct.pack("<QQQB4s", self.at, len(self.doc_ids), len(self.blocks), self.width, MAGIC))


class IdsReader:
    """Random access to the documents of a file."""

    def __init__(self, stream, size: int):
        tail = struct.calcsize("<QQQB4s")
        stream.seek(size - tail)
        at, docs, blocks, self.width, magic = struct.unpack("<QQQB4s", stream.read(tail))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        stream.seek(at)
        ids = np.frombuffer(stream.read(8 * docs), "<i8")
        named = np.frombuffer(stream.read(docs), np.uint8)
        self.doc_ids = [int(x) if known else None for x, known in zip(ids, named, strict=True)]
        self.ends = np.frombuffer(stream.read(8 * docs), "<u8").astype(np.int64)
        self.blocks = np.concatenate((np.frombuffer(stream.read(8 * blocks), "<u8").astype(np.int64), [at]))
        self.stream = stream

    def __len__(self) -> int:
        return len(self.doc_ids)

    def span(self, doc: int) -> tuple[int, int]:
        """Where the ids of a document start and end, counted from the start of the file."""
        return int(self.ends[doc - 1]) if doc else 0, int(self.ends[doc])

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids in positions ``first`` to ``last``, from the blocks that hold them."""
        if first >= last:
            return np.empty(0, np.uint32)
        low, high = first // BLOCK, (last - 1) // BLOCK
        self.stream.seek(int(self.blocks[low]))
        raw = self.stream.read(int(self.blocks[high + 1] - self.blocks[low]))
        count = min((high + 1) * BLOCK, int(self.ends[-1])) - low * BLOCK
        return unpack(raw, count, self.width)[first - low * BLOCK : last - low * BLOCK]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, start, ids)`` in order, by runs of documents of about 16 blocks."""
        doc = 0
        while doc < len(self):
            start = self.span(doc)[0]
            last = max(doc + 1, int(np.searchsorted(self.ends, start + 16 * BLOCK, side="right")))
            ids = self.ids(start, int(self.ends[last - 1]))
            for i in range(doc, last):
                a, b = self.span(i)
                yield self.doc_ids[i], a, ids[a - start : b - start]
            doc = last


def write_ids(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int | None = None) -> DataFrame:
    """Write one file per range of doc_id; returns ``(part, file, bytes, docs, tokens)`` of the files of tasks that ended.

    A task that runs again writes a file of another name, and the list names one file for each range.
    """
    width = bit_width(vocabulary)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        name = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.bin"
        system, path = file_system(name)
        tokens, writer, stream = encoder(tokenizer), None, None
        for frame in frames:
            for a, b in in_parts(texts := frame["text"].tolist()):
                for key, ids in zip(frame["doc_id"].iloc[a:b], tokens.encode(texts[a:b]), strict=True):
                    if writer is None:
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        stream = system.open_output_stream(path, compression=None)
                        writer = IdsWriter(stream, width)
                    ids = ids if end_id is None else np.append(ids, np.uint32(end_id))
                    writer.add(None if pd.isna(key) else int(key), ids)
        tokens.forget()
        if writer is not None:
            writer.close()
            stream.close()
            size = system.get_file_info(path).size
            columns = {"part": part, "file": name, "bytes": size, "docs": len(writer.doc_ids), "tokens": writer.total}
            yield pd.DataFrame({k: [v] for k, v in columns.items()})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInPandas(released(write), "part long, file string, bytes long, docs long, tokens long")


def read_ids(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents of written files; ``start`` counts all ids before a document."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, size, base in zip(frame["file"], frame["bytes"], frame["base"], strict=True):
                system, path = file_system(name)
                with system.open_input_file(path) as stream:
                    rows = []
                    for doc_id, start, ids in IdsReader(stream, size):
                        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
                        rows.append((doc_id, base + start, len(ids), crc))
                        if len(rows) == 20_000:
                            yield _table(rows)
                            rows = []
                    yield _table(rows)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row per file
    based = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    each = based.select("file", "bytes", "base").repartition(max(1, files.count()), "file")  # a stated number is never merged to fewer
    return each.mapInPandas(released(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return frame.astype({"doc_id": "Int64"})


def read_document(name: str, place: int) -> np.ndarray:
    """The ids of one document of a file by its place in it."""
    system, path = file_system(name)
    with system.open_input_file(path) as stream:
        reader = IdsReader(stream, system.get_file_info(path).size)
        return reader.ids(*reader.span(place))


def vocabulary_size(tokenizer: str) -> int:
    """Ids of a tokenizer file, with those of its special tokens."""
    with open(tokenizer, encoding="utf-8") as file:
        found = json.load(file)
    return 1 + max(*found["model"]["vocab"].values(), *(x["id"] for x in found["added_tokens"]))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """Write the ids of all documents to a shared folder and read them back."""
    folder = shared_folder(spark, "packed-ids")
    return read_ids(saved(write_ids(docs, folder, tokenizer, vocabulary_size(tokenizer), end_id), "packed-ids-files"))
