"""Packs documents, in their order, into training sequences: cuts chosen by dynamic programming.

The documents of a partition form one stream of tokens. A cut may fall at the end of a document (free), at the end of a sentence
or line, at a comma, or at any STEP-th token, at rising penalties for the truncated text. A sequence between two cuts has at
most ``length`` tokens, and each token short of it is padding and costs one. The least total cost up to a cut c is

    best(c) = penalty(c) + length - c + min(best(b) + b)  over the cuts b with c - length <= b < c,

and as the range of b only moves forward, a queue with rising values holds the minima: each cut enters and leaves it once.
The stream is worked off in segments; the last sequence of a segment is open and starts the next one, so that only the
last sequence of a partition is filled up. Partitions are those of the scan: nothing is shuffled.

Rows of a document table: a null or empty text has only the end id. Null and repeated ids stay as they are; each row is packed
once. Other columns are not read. Lengths that are powers of two count as padded too, which can only overstate the padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscore.llm.storage import released
from hopscore.llm.tokens import encoder
from hopscore.llm.words import in_parts

LENGTH = 2_048
SEGMENT = 400_000  # tokens worked off at once
STEP = 32
SENTENCE, COMMA, ANYWHERE = 8.0, 16.0, 32.0  # penalties, in tokens of padding

_kinds: dict[str, np.ndarray] = {}


def token_penalties(tokenizer: str) -> np.ndarray:
    """By id: the penalty of a cut after the token, 0 where it ends neither a sentence, a line nor a clause."""
    if tokenizer not in _kinds:
        library = encoder(tokenizer).tokenizer
        table = np.zeros(library.get_vocab_size(with_added_tokens=True) + 1)
        for i in range(len(table) - 1):
            text = library.decode([i], skip_special_tokens=False)
            if text.endswith((".", "!", "?", "\n")):
                table[i] = SENTENCE
            elif text.endswith((",", ";", ":")):
                table[i] = COMMA
        _kinds[tokenizer] = table
    return _kinds[tokenizer]


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices of the cuts of least cost. ``positions`` rise from 0 by at most ``length``; the first and last are cuts."""
    places, costs = positions.tolist(), (penalties + length).tolist()
    back = [0] * len(places)
    values, cuts_of, head = [0.0], [0], 0  # the queue: best(b) + b, and b; what stands before ``head`` has left it
    for i in range(1, len(places)):
        reach = places[i] - length
        while places[cuts_of[head]] < reach:
            head += 1
        back[i] = cuts_of[head]
        value = values[head] + costs[i]
        while len(values) > head and values[-1] > value:
            values.pop()
            cuts_of.pop()
        values.append(value)
        cuts_of.append(i)
    cuts = [len(places) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, table: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a stream may be cut, from 0 to its end, and the penalty of each; ``ends`` are those of documents."""
    cost = table[np.minimum(ids, len(table) - 1)]
    cost = np.concatenate(([0.0], cost))
    allowed = cost > 0
    cost[~allowed] = ANYWHERE
    allowed[::step] = True
    allowed[ends], cost[ends] = True, 0.0
    allowed[[0, -1]], cost[0] = True, 0.0
    positions = np.flatnonzero(allowed)
    return positions, cost[positions]


class Packer:
    """Takes documents in order and gives the pieces of finished sequences."""

    def __init__(self, table: np.ndarray, first_sequence: int, length: int, segment: int):
        self.table, self.sequence, self.length, self.segment = table, first_sequence, length, segment
        self.docs: deque[tuple[object, np.ndarray, int]] = deque()  # id, ids, tokens already in finished sequences
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)
        if self.held >= self.segment:
            yield from self._work(False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._work(True)

    def _work(self, final: bool) -> Iterator[tuple]:
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        positions, penalties = candidates(stream, ends, self.table, min(STEP, self.length))
        cuts = positions[choose_cuts(positions, penalties, self.length)].tolist()
        for a, b in zip(cuts, cuts[1:] if final else cuts[1:-1], strict=False):
            yield from self._sequence(b - a)

    def _sequence(self, size: int) -> Iterator[tuple]:
        offset = 0
        while offset < size:
            doc_id, ids, done = self.docs.popleft()
            take = min(size - offset, len(ids) - done)
            crc = zlib.crc32(np.ascontiguousarray(ids[done : done + take], "<u4"))
            yield doc_id, done, take, crc, len(ids), self.sequence, offset
            if done + take < len(ids):
                self.docs.appendleft((doc_id, ids, done + take))
            offset += take
        self.held -= size
        self.sequence += 1


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, segment: int = SEGMENT
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: the pieces of documents, and where they lie.

    Sequence ids are unique and rise within a partition; they leave gaps between partitions.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"} if kind in ("bigint", "int") else {})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(tokenizer)
        packer = Packer(token_penalties(tokenizer), TaskContext.get().partitionId() << 33, length, segment)
        rows: list[tuple] = []
        for frame in frames:
            keys = [None if pd.isna(x) else x for x in frame["doc_id"]]
            for a, b in in_parts(texts := frame["text"].tolist()):
                for key, ids in zip(keys[a:b], tokens.encode(texts[a:b]), strict=True):
                    rows.extend(packer.add(key, np.append(ids, np.uint32(end_id))))
                if len(rows) > 10_000:
                    yield table(rows)
                    rows = []
        tokens.forget()
        rows.extend(packer.finish())
        if rows:
            yield table(rows)

    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInPandas(
        released(pack),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
