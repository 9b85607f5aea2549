"""Flat texts cut into words that are encoded once: what the tokenizing operators share.

A batch of texts is one byte buffer with offsets. It is cut where no token can reach across,
distinct words are found by Arrow's dictionary encoding, and a worker remembers the ids of
those it has met, one after another in one array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = 0x20


def led(texts: pa.Array) -> pa.Array:
    """Texts with a blank before them; an empty or null one stays empty."""
    texts = texts.fill_null("")
    joined = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, joined)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends among them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def strings(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The pieces of a buffer between successive bounds, not copied."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind or pa.string(), len(bounds) - 1, buffers)


def between_words(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Begins of units: where a text begins and at single blanks between two characters that are
    no white space, so that a splitter that takes a blank with what follows splits there."""
    bounds = bounds.astype(np.int64)
    at = np.flatnonzero(data == BLANK)
    padded = np.concatenate((np.full(3, BLANK, np.uint8), data, np.full(3, BLANK, np.uint8)))
    before, after = padded[at + 2], padded[at + 4]
    plain = (before > BLANK) & (before != 0x7F) & (after > BLANK) & (after != 0x7F)
    wide = np.flatnonzero(plain & ((before >= 0x80) | (after >= 0x80)))
    p = at[wide] + 3
    plain[wide] &= ~(_white(padded, p + 1) | (padded[p - 2] == 0xC2) & _white(padded, p - 2) | _white(padded, p - 3))
    start = np.zeros(len(data) + 1, bool)
    start[at[plain]] = True
    start[bounds[1:]] = False  # of the next text, or the end
    start[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.flatnonzero(start[:-1])


def _white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a white space character beyond ASCII begins (Unicode's property White_Space)."""
    a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return (
        (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    )


class Remembered:
    """Ids of words, computed once a worker; emptied when more than `most` words are known."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = (np.zeros(0, k) for k in (np.uint32, np.int64, np.int64))

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each has."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self._forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            ids, sizes = self.encode(new)
            begin = len(self.sizes)
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, ids.astype(np.uint32)))
            self.known.update(zip(new, range(begin, begin + len(new))))
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - ends + n, n) + np.arange(total)], n


def counted(sizes: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the words' sizes for each text; `starts` are the words' begins, ascending."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    return np.diff(total[np.searchsorted(starts, bounds)])
