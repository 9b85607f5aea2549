"""SentencePiece encoding and decoding by vectorised merge rounds.

The symbols of all distinct words of a batch lie in one numpy array. In each round the least
pair rank of every word is found by a segmented minimum, all its occurrences are merged at
once, leftmost first and without overlap, and the arrays are compacted; words without a pair
in the vocabulary leave. The result is that of merging one pair at a time, best score first
and leftmost of equals: where a merge makes a pair that is not worse, the word's later
occurrences wait for the next round. Words are cut between characters that no piece of the
vocabulary holds next to each other, as no merge reaches across.

Supported are BPE models with byte fallback, a dummy prefix and no further normalisation, with
no user-defined pieces; others raise a ValueError.

Defined results: a null or empty text has no ids and decodes to an empty text. Rows are
neither matched nor merged, so repeated rows and null or repeated keys give a row each, and
further columns pass by unread. Texts are read whole; an empty table gives an empty result.
When decoded, U+2581 comes back as a blank, as in the library.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import slices
from tidemill.llm.units import Remembered, counted, flat, led, strings

SPACE = "▁"
#: kinds of pieces in a model file
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = np.int64(1) << 40
SHIFT = np.int64(21)  # a symbol is a piece, or a character beyond the pieces


@dataclass(frozen=True)
class PieceSettings:
    model: str = ""  # path of the model file
    batch_bytes: int = 4 << 20
    remembered: int = 300_000  # words whose ids a worker keeps


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 0x7F) << shift, shift + 7, at + 1
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


class Pieces:
    """The vocabulary of a model file as tables for merging and decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        entries = [dict(_fields(value)) for number, value in message if number == 1]
        self.names = [e.get(1, b"").decode() for e in entries]
        self.kinds = np.array([e.get(3, NORMAL) for e in entries])
        scores = np.array([e.get(2, 0.0) for e in entries])
        trainer = dict(_fields(next((v for n, v in message if n == 2), b"")))
        cleaning = dict(_fields(next((v for n, v in message if n == 3), b"")))
        if (
            trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or cleaning.get(2)
            or not cleaning.get(3, 1) or cleaning.get(4, 1) or not cleaning.get(5, 1)
            or not np.isin(self.kinds, (NORMAL, UNKNOWN, CONTROL, BYTE)).all()
        ):
            raise ValueError("only BPE models with byte fallback, dummy prefix and no normalisation")
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.names[i][3:5], 16)] = i
        self._merges(scores)
        self._surfaces()

    def _merges(self, scores: np.ndarray) -> None:
        size = len(self.names)
        normal = np.flatnonzero(self.kinds == NORMAL)
        index = {self.names[i]: i for i in normal.tolist()}
        self.symbols = np.arange(size, size + 0x110000, dtype=np.int64)  # of characters
        ranks = np.unique(-scores, return_inverse=True)[1].tolist()
        pairs, chars, self.unsafe = {}, set(), np.zeros(size, bool)
        for name, i in index.items():
            if len(name) == 1:
                self.symbols[ord(name)] = i
        for name, i in index.items():
            chars.update(zip(name, name[1:]))
            for k in range(1, len(name)):
                sides = [index.get(x, size + ord(x) if len(x) == 1 else None) for x in (name[:k], name[k:])]
                if None not in sides:
                    pairs[sides[0] << int(SHIFT) | sides[1]] = (ranks[i], i)
                    for x in sides:
                        if x < size and ranks[x] >= ranks[i] and len(self.names[x]) > 1:
                            self.unsafe[x] = True  # merging it can make a pair that is not worse
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks, self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64).reshape(-1, 2).T.copy()
        self.near = np.array(sorted(ord(a) << int(SHIFT) | ord(b) for a, b in chars), np.int64)
        # the same for pairs of characters below 256, as tables
        low = np.arange(256)
        left, right = np.repeat(low, 256), np.tile(low, 256)
        self.low_near = np.isin(left << SHIFT | right, self.near)
        self.low_pairs = self._pair(self.symbols[left], self.symbols[right])
        # of bytes: what may be one word; a blank stands for the space mark
        known = [(ord(a.replace(SPACE, " ")), ord(b.replace(SPACE, " "))) for a, b in chars]
        self.joins = (left >= 0x80) & (right >= 0x80)
        for a, b in known:
            if a < 0x80 and b < 0x80:
                self.joins[a << 8 | b] = True
            elif a < 0x80:
                self.joins[(a << 8) + 0x80 : (a << 8) + 0x100] = True
            elif b < 0x80:
                self.joins[b + (0x80 << 8) :: 256] = True
        self.run = self._blanks(index, ranks)

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Begins of words in a buffer of texts: no piece holds the bytes on both sides of one."""
        start = np.ones(len(data), bool)
        start[1:] = ~self.joins[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        start[bounds[:-1][np.diff(bounds) > 0]] = True
        return np.flatnonzero(start)

    def _blanks(self, index: dict[str, int], ranks: list[int]) -> int:
        """Length of the longest piece of blanks if long runs are taken by it from the left, else 0.

        That holds if all pieces of blanks are alike and worse than every other merge, which
        makes the leftmost one grow first, and if what follows a longest one starts anew.
        """
        self.run = 0
        blanks = [n for n in index if not n.strip(SPACE) and len(n) > 1]
        alike, most = {ranks[index[n]] for n in blanks}, max(map(len, blanks), default=0)
        others = max((ranks[i] for n, i in index.items() if n.strip(SPACE) and len(n) > 1), default=-1)
        mixed = any(n.startswith(2 * SPACE) and n.strip(SPACE) for n in index)
        if len(alike) != 1 or min(alike) <= others or mixed:
            return 0
        ids = {k: self.encode([" " * k])[0].tolist() for k in range(2 * most + 2)}
        return most * all(ids[most + k] == ids[most] + ids[k] for k in range(most + 2))

    def _surfaces(self) -> None:
        surface = {UNKNOWN: lambda n: " ⁇ ", CONTROL: lambda n: "", NORMAL: lambda n: n.replace(SPACE, " ")}
        parts = [
            bytes([int(n[3:5], 16)]) if k == BYTE else surface[k](n).encode() for n, k in zip(self.names, self.kinds.tolist())
        ]
        self.bytes = pa.array(parts, pa.binary())

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NEVER if no piece, and what it merges to."""
        if not len(self.keys):
            return np.full(len(left), NEVER), np.zeros(len(left), np.int64)
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.merged[at]

    def _segments(self, points: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Number of the segment of each character; `words` are its words' numbers."""
        low = np.minimum(points, 255)
        cut = ~self.low_near[low[:-1] << 8 | low[1:]]
        high = np.flatnonzero((points[:-1] > 255) | (points[1:] > 255))
        key = points[high] << SHIFT | points[high + 1]
        cut[high] = self.near[np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)] != key
        cut |= words[1:] != words[:-1]
        if self.run:
            blank = points == ord(SPACE)
            place = np.arange(len(points))
            first = blank & np.append(True, ~blank[:-1] | (words[1:] != words[:-1]))
            within = place - np.maximum.accumulate(np.where(first, place, 0))
            cut |= (blank & (within > 0) & (within % self.run == 0))[1:]
        return np.append(0, np.cumsum(cut))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each has."""
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        if not len(points):
            return np.zeros(0, np.int64), lengths
        symbol, segment, place = self.symbols[points], self._segments(points, owner), np.arange(len(points))
        out = np.full(len(points), -1)
        rank, merged = self._first_ranks(points, symbol, segment)
        while len(symbol):
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            sizes = np.diff(starts, append=len(segment))
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least < NEVER, sizes)
            out[place[~live]] = symbol[~live]
            least = np.repeat(least, sizes)[live]
            symbol, segment, place, rank, merged = (x[live] for x in (symbol, segment, place, rank, merged))
            if not len(symbol):
                break
            chosen = self._leftmost(np.flatnonzero(rank == least))
            chosen = self._in_time(chosen, symbol, segment, rank, merged)
            symbol[chosen] = merged[chosen]
            fresh = np.zeros(len(symbol), bool)
            fresh[chosen] = True
            fresh[np.maximum(chosen - 1, 0)] = True
            # the left neighbour of a merge may itself be the right half of one
            fresh[np.maximum(chosen - 2, 0)] = True
            stay = np.ones(len(symbol), bool)
            stay[chosen + 1] = False
            symbol, segment, place, rank, merged, fresh = (x[stay] for x in (symbol, segment, place, rank, merged, fresh))
            at = np.flatnonzero(fresh)
            rank[at], merged[at] = self._ranks_at(at, symbol, segment)
        return self._ids(out, owner, points, len(words))

    def _first_ranks(self, points: np.ndarray, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.append(points[1:], 0)
        pair = np.minimum(points, 255) << 8 | np.minimum(after, 255)
        rank, merged = (x[pair] for x in self.low_pairs)
        rank[np.append(segment[1:] != segment[:-1], True)] = NEVER
        high = np.flatnonzero((points > 255) | (after > 255))
        rank[high], merged[high] = self._ranks_at(high, symbol, segment)
        return rank, merged

    def _ranks_at(self, at: np.ndarray, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, merged = self._pair(symbol[at], symbol[after])
        return np.where((segment[at] == segment[after]) & (after > at), rank, NEVER), merged

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of successive positions every other one, so that no two pairs share a symbol."""
        first = np.append(True, at[1:] != at[:-1] + 1)
        order = np.arange(len(at))
        return at[(order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0]

    def _in_time(self, chosen: np.ndarray, symbol: np.ndarray, segment: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Without the pairs of a segment behind a merge that makes a pair not worse than its own."""
        look = np.flatnonzero(self.unsafe[merged[chosen]])
        if not len(look):
            return chosen
        at, last = chosen[look], len(symbol) - 1
        made, own = merged[at], segment[at]
        left = np.where((look > 0) & (chosen[look - 1] == at - 2), merged[chosen[look - 1]], symbol[np.maximum(at - 1, 0)])
        right = np.minimum(at + 2, last)
        before = np.where((at > 0) & (segment[np.maximum(at - 1, 0)] == own), self._pair(left, made)[0], NEVER)
        after = np.where((at + 2 <= last) & (segment[right] == own), self._pair(made, symbol[right])[0], NEVER)
        bad = np.zeros(len(chosen), np.int64)
        bad[look] = np.minimum(before, after) <= rank[at]
        total = np.cumsum(bad) - bad
        first = np.append(True, segment[chosen][1:] != segment[chosen][:-1])
        base = np.maximum.accumulate(np.where(first, total, 0))
        return chosen[total == base]

    def _ids(self, out: np.ndarray, owner: np.ndarray, points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        kept = np.flatnonzero(out >= 0)
        ids, owner = out[kept], owner[kept]
        strange = np.flatnonzero(ids >= len(self.names))  # characters without a piece: their bytes
        if len(strange):
            coded = [self.byte_ids[list(chr(p).encode())] for p in points[kept[strange]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[strange] = [len(x) for x in coded]
            at = np.repeat(np.arange(len(ids)), times)
            spelled = np.isin(at, strange, kind="table")
            ids, owner = ids[at], owner[at]
            ids[spelled] = np.concatenate(coded)
        return ids, np.bincount(owner, minlength=n)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of lists of ids; invalid bytes become U+FFFD one by one."""
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)
        seen = self.kinds[ids] != CONTROL
        split = np.flatnonzero(~seen[1:-1] & (self.kinds[ids[:-2]] == BYTE) & (self.kinds[ids[2:]] == BYTE)) if len(ids) > 2 else ()
        if len(split) or (~seen[1:] & ~seen[:-1]).any():  # control ids may end a run of bytes
            ends = np.cumsum(sizes)
            return pa.array([self._decode_one(ids[b - k : b].tolist()) for b, k in zip(ends.tolist(), sizes.tolist())], pa.string())
        ids, owner = ids[seen], owner[seen]
        sizes = np.bincount(owner, minlength=n)
        parts = self.bytes.take(pa.array(ids))
        data, bounds = flat(parts)
        tokens = np.append(0, np.cumsum(sizes))
        bounds = bounds[tokens]
        first = ids[np.minimum(tokens[:-1], max(len(ids) - 1, 0))] if len(ids) else np.zeros(n, np.int64)
        lead = np.array([x.startswith(SPACE) for x in self.names]) & (self.kinds == NORMAL)
        led = (sizes > 0) & lead[first]
        if led.any():
            stay = np.ones(len(data), bool)
            stay[bounds[:-1][led]] = False
            data, bounds = data[stay], bounds - np.append(0, np.cumsum(led))
        try:
            return strings(data, bounds, pa.binary()).cast(pa.string())  # checks the bytes
        except pa.ArrowInvalid:
            view, pairs = data.tobytes(), zip(bounds[:-1].tolist(), bounds[1:].tolist())
            return pa.array([view[a:b].decode("utf-8", "tidemill_each") for a, b in pairs], pa.string())


    def _decode_one(self, ids: list[int]) -> str:
        text, run, lead = "", b"", False
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.bytes[i].as_py()
                continue
            text, run = text + run.decode("utf-8", "tidemill_each"), b""
            if i is not None:
                part = self.bytes[i].as_py().decode()
                first = bool(self.kinds[i] == NORMAL) and part.startswith(" ") and not text and not lead
                lead |= first
                text += part[int(first) :]
        return text


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tidemill_each", _each_byte)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def _words(path: str, remembered: int) -> Remembered:
    return Remembered(pieces(path).encode, remembered)


def encode_texts(texts: pa.Array, path: str, remembered: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the number of ids of each text."""
    data, bounds = flat(led(pc.replace_substring(texts.fill_null(""), SPACE, " ")))
    starts = pieces(path).starts(data, bounds)
    ids, sizes = _words(path, remembered).ids(strings(data, np.append(starts, len(data))))
    return ids, counted(sizes, starts, bounds)


def encode(docs: DataFrame, key: str, text: str, settings: PieceSettings) -> DataFrame:
    """doc_id and the ids of every row's text."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", s.batch_bytes):
            ids, sizes = encode_texts(batch.column("text"), s.model, s.remembered)
            bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, settings: PieceSettings) -> DataFrame:
    """doc_id, ids and the text that the ids of every row stand for."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", s.batch_bytes):
            lists = batch.column("ids")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pieces(s.model).decode(lists.flatten().to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, texts], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
