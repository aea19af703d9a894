"""Token ids by public tokenizer files, inside Python workers: a worker encodes a recurring piece of text once.

A piece is a run of spaces and line feeds with what follows it up to the next one. Neither tokenizer lets a token hold white
space after another character, so that the ids of a text are those of its pieces in a row. A text that holds other white
space is encoded as a whole.

Most pieces are a short word after one space. Their bytes are two integers, and all of them in a batch are looked up at once in a table of as many
slots as memory allows, by these integers themselves; a word that is new there takes the place of the one before. Other pieces are remembered by name.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from unicodedata import is_normalized

import numpy as np

from hopscore.llm.words import mix, word_edges

SLOT_BITS, SHORT, FEW_IDS = 20, 16, 8  # of the table of words: its places (49 bytes each), most bytes of a word and most ids
ENTRIES = 200_000  # other pieces in each of the two generations that a worker remembers: mostly about 200 bytes each, at most 700
PIECE = 64  # characters; longer pieces are not remembered
JOINED, TEXTS = 256, 64  # pieces in a text for the library, and texts in a call

# White space by Unicode or by Python other than space and line feed, and the mark of a text's first piece.
OTHER = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"
FIRST = "\0"

# Fixed values of the files: how a space and the end of a word are written in their vocabularies.
SPACE, WORD_END = "\u0120", "</w>"

_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first bytes of eight, by their number
_loaded: dict[str, Encoder] = {}


class _Pieces:
    """Where the pieces of texts lie in their bytes ``raw``: ``begin`` of its white space, ``start`` and ``end`` of what follows; ``first`` piece of each text."""

    def __init__(self, texts: list[str]):
        encoded = [text.encode() for text in texts]
        self.raw = b"\n".join(encoded)
        self.at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in encoded])))
        starts, ends = word_edges(self.raw)
        first = np.searchsorted(starts, self.at)
        begin = np.append(0, ends)[:-1]
        some = np.diff(first) > 0
        begin[first[:-1][some]] = self.at[:-1][some]
        last = self.at[:-1].copy()
        last[some] = ends[first[1:][some] - 1]
        stop = self.at[1:] - 1
        blank = np.flatnonzero(last < stop)  # texts that end with white space: a piece by itself
        place = first[1:][blank]
        self.begin, self.start, self.end = (np.insert(x, place, y[blank]) for x, y in ((begin, last), (starts, stop), (ends, stop)))
        self.first = first + np.append(0, np.cumsum(last < stop))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces that are a short word after one space, and their bytes as two integers; no byte is 0."""
        data = np.frombuffer(self.raw + bytes(SHORT), np.uint8)
        size = self.end - self.start
        short = np.flatnonzero((self.start - self.begin == 1) & (data[self.begin] == 32) & (size > 0) & (size <= SHORT))
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        start, size = self.start[short], size[short]
        return short, eight[start] & _LOW[np.minimum(size, 8)], eight[start + 8] & _LOW[np.maximum(size - 8, 0)]

    def names(self, which: np.ndarray) -> list[str]:
        """Pieces by their names: a word after one space is named without it, a piece without white space by FIRST and itself."""
        out = []
        for begin, start, end in zip(self.begin[which].tolist(), self.start[which].tolist(), self.end[which].tolist(), strict=True):
            if begin == start:
                out.append(FIRST + self.raw[start:end].decode())
            elif start - begin == 1 and self.raw[begin] == 32 and start < end:
                out.append(self.raw[start:end].decode())
            else:
                out.append(self.raw[begin:end].decode())
        return out


def _piece(key: str) -> str:
    return key[1:] if key[0] == FIRST else key if key[0] in " \n" else " " + key


def _fold(text: str) -> str:
    """The text with A-Z lowered, where that changes nothing of what normalising and lowering make of it: both spellings are normal already."""
    if text.isascii():
        return text.lower()
    low = text.encode().lower().decode()  # bytes lower A-Z only
    return low if is_normalized("NFC", text) and is_normalized("NFC", low) else text


class Encoder:
    """``encode`` gives the ids of texts as unsigned 32-bit integers, exactly those of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the names of special tokens are text like any other
        self.low = self.high = self.sizes = self.ids = np.zeros(0, np.uint64)
        self.forget()
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.folds = self._library(list(letters)) == self._library(list(letters.lower()))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts, self.ends = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        self.starts[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.gap = self._library([FIRST])[0]

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _joined(self, words: list[str], between: str, spans: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        """Ids of words after a space. The library gets many as one text, as most of its time for a short text is not spent on the text;
        ``spans`` finds first and last places of the words in its ids. Where it doesn't find one span for each word, they are encoded with
        marks between them or else one by one."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out = []
        for i in range(0, len(groups), TEXTS):
            some = groups[i : i + TEXTS]
            for group, raw in zip(some, self._library([" " + between.join(group) for group in some]), strict=True):
                first, last = spans(np.frombuffer(raw, np.uint32))
                if len(first) == len(group):
                    out += [raw[a:b] for a, b in zip((4 * first).tolist(), (4 * last).tolist(), strict=True)]
                elif spans == self._by_ends:
                    out += self._joined(group, f" {FIRST} ", self._by_gaps)
                else:
                    out += self._library([" " + word for word in group])
        return out

    def _by_starts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.starts[ids])
        return at, np.append(at[1:], len(ids))

    def _by_ends(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.ends[ids]) + 1
        return np.append(0, at)[:-1], at

    def _by_gaps(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(ids == np.frombuffer(self.gap, np.uint32))
        return np.append(0, at + 1), np.append(at, len(ids))

    def _encode_new(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces by name. Words are told apart by the tokens that begin with their space, if tokens keep spaces, else by the tokens that end
        words of letters, and by a mark that no word holds between others."""
        words = [k for k in new if k[:1] not in "\0 \n"]
        odd = [k for k in new if k[:1] in "\0 \n"]
        found = dict(zip(odd, self._library([_piece(k) for k in odd]), strict=True))
        if self.ends.any() and len(self.gap) == 4:
            letters, others = [k for k in words if k.isalpha()], [k for k in words if not k.isalpha()]
            found.update(zip(letters, self._joined(letters, " ", self._by_ends), strict=True))
            found.update(zip(others, self._joined(others, f" {FIRST} ", self._by_gaps), strict=True))
        else:
            found.update(zip(words, self._joined(words, " ", self._by_starts), strict=True))
        return found

    def _named(self, names: list[str]) -> dict[str, bytes]:
        """Ids of pieces by name, from memory or from the library."""
        new = set(names).difference(self.young)
        if len(self.young) + len(new) > ENTRIES:
            self.young, self.old = {}, self.young
            new = set(names)
        seen = new.intersection(self.old) if self.old else set()
        self.young.update((k, self.old[k]) for k in seen)
        self.young.update(self._encode_new(new - seen))
        return self.young

    def _learn(self, found: dict[str, bytes], low: np.ndarray, high: np.ndarray, slots: np.ndarray) -> None:
        """Put words into their slots."""
        sizes = np.fromiter((len(x) // 4 for x in found.values()), np.int64, len(found))
        few = np.flatnonzero(sizes <= FEW_IDS)
        self.low[slots[few]] = 0  # of words with one slot the last one written stays, whole
        rows = np.frombuffer(b"".join(x.ljust(4 * FEW_IDS, b"\0") for x in found.values() if len(x) <= 4 * FEW_IDS), np.uint32)
        last = np.unique(slots[few][::-1], return_index=True)[1]
        last = len(few) - 1 - last
        few = few[last]
        self.low[slots[few]], self.high[slots[few]], self.sizes[slots[few]] = low[few], high[few], sizes[few]
        self.ids[slots[few]] = rows.reshape(-1, FEW_IDS)[last]

    def _encode_pieces(self, texts: list[str]) -> list[np.ndarray]:
        pieces = _Pieces(texts)
        short, low, high = pieces.words()
        if not len(self.low):  # made when first needed
            self.low, self.high = (np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(2))
            self.sizes, self.ids = np.zeros(1 << SLOT_BITS, np.uint8), np.zeros((1 << SLOT_BITS, FEW_IDS), np.uint32)
        slots = (mix(low ^ mix(high, 11), 12) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = (self.low[slots] == low) & (self.high[slots] == high)
        there, size = slots[known], np.empty(len(pieces.begin), np.int64)
        size[short[known]] = self.sizes[there]
        rows = self.ids[there][np.arange(FEW_IDS) < self.sizes[there][:, None]]
        is_known, is_new = (np.zeros(len(size), bool) for _ in range(2))
        is_known[short[known]], is_new[short[~known]] = True, True
        others = np.flatnonzero(~is_known)
        names, new = pieces.names(others), is_new[others]
        found = self._encode_new(set(words := [k for k, x in zip(names, new.tolist(), strict=True) if x]))
        one = dict(zip(words, np.flatnonzero(~known).tolist(), strict=True))
        at = np.array([one[k] for k in found], np.int64)
        self._learn(found, low[at], high[at], slots[at])
        odd = [k for k, x in zip(names, new.tolist(), strict=True) if not x]
        named = self._named(odd)
        raw = [found[k] if x else named[k] for k, x in zip(names, new.tolist(), strict=True)]
        size[others] = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat, whence = np.empty(int(size.sum()), np.uint32), np.repeat(is_known, size)
        flat[whence], flat[~whence] = rows, np.frombuffer(b"".join(raw), np.uint32)
        for k in {k for k in odd if len(k) > PIECE}:
            del named[k]
        ends = np.append(0, np.cumsum(size))[pieces.first].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        alone = [not text or FIRST in text or any(c in text for c in OTHER) for text in texts]
        fold = _fold if self.folds else str
        others = [fold(text) for text, whole in zip(texts, alone, strict=True) if not whole]
        pieced = iter(self._encode_pieces(others) if others else [])
        return [
            next(pieced) if not whole else np.frombuffer(self._library([text])[0] if text else b"", np.uint32) for text, whole in zip(texts, alone, strict=True)
        ]

    def forget(self) -> None:
        """Give the memory of named pieces back; called at the end of a partition, as idle workers stay. The table of words, whose size is fixed, is kept
        for the next one: many of its words have been met before."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
