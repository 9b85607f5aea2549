"""Byte-level tokenizer files: ids of units joined into long strings, and the bytes of every id."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemill.llm.units import Remembered, between_words, counted, flat, strings


def _spelled_bytes() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _class_cuts() -> np.ndarray:
    """Pairs of ASCII bytes between which the splitter always ends a piece: letters, digits and
    marks are pieces of their own; what follows an apostrophe may belong to it."""
    kind = np.zeros(256, np.int64)
    for b in range(0x21, 0x7F):
        kind[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    left, right = kind[:, None], kind[None, :]
    cuts = (left > 0) & (right > 0) & (left != right)
    cuts[ord("'")] = False
    return cuts.reshape(-1)


CUTS = _class_cuts()
BARE = re.compile(r"[A-Za-z0-9]+").fullmatch
NEWLINE = 0x0A


class ByteLevel:
    """A tokenizer that splits before a single blank between two characters that are no white space.

    `special` says whether the strings of special tokens inside texts become special tokens.
    `splits` is False for tokenizers of other kinds: then whole texts have to be encoded.
    """

    TOGETHER = 400  # units that go to the tokenizer as one string

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        vocabulary, spelled = self.tokenizer.get_vocab(), _spelled_bytes()
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        parts = [b""] * (max(vocabulary.values(), default=-1) + 1)
        byte_level = True
        for token, index in vocabulary.items():
            byte_level &= token in added or all(c in spelled for c in token)
            parts[index] = token.encode() if token in added or not byte_level else bytes(map(spelled.__getitem__, token))
        self.bytes = pa.array(parts, pa.binary())
        self.lengths = np.array([len(x) for x in parts], np.int64)
        whole, apart = self._each([" ab 'ce's c.d\ne12f"])[0], self._each([" ab", " '", "ce", "'s", " c", ".", "d", "\n", "e", "12", "f"])
        self.splits = byte_level and whole.tolist() == np.concatenate(apart).tolist()
        self.special = special

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Begins of units: where a piece of the splitter begins whatever stands around it."""
        start = np.zeros(len(data), bool)
        start[between_words(data, bounds)] = True
        if self.special and b"<|" in data.tobytes():
            return np.flatnonzero(start)
        start[1:] |= CUTS[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        # a line end alone between two printable characters is a piece
        at = np.flatnonzero(data[1:-1] == NEWLINE) + 1 if len(data) > 2 else np.zeros(0, np.int64)
        left, right = data[at - 1], data[np.minimum(at + 1, len(data) - 1)]
        ends = np.zeros(len(data) + 1, bool)
        ends[bounds] = True
        at = at[(left > 0x20) & (left < 0x7F) & (right > 0x20) & (right < 0x7F) & ~ends[at] & ~ends[at + 1]]
        start[at], start[at + 1] = True, True
        return np.flatnonzero(start)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._each(texts)
        return np.concatenate([*found, np.zeros(0, np.uint32)]), np.array([len(x) for x in found], np.int64)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, and how many each has.

        Units that begin with a blank and neither touch nor end in white space are encoded many
        to a string, those of ASCII letters and digits with line ends between them; the strings
        are cut by bytes. The others are encoded alone.
        """
        bare = np.fromiter(map(BARE, units), object, len(units)) != None  # noqa: E711
        led = np.fromiter((not b and u[0] == " " and len(u) > 1 and not u[1].isspace() and not u[-1].isspace() and "<|" not in u for u, b in zip(units, bare)), bool, len(units))
        sizes, parts = np.zeros(len(units), np.int64), []
        for group, between in ((led, ""), (bare, "\n"), (~led & ~bare, None)):
            own = [units[i] for i in np.flatnonzero(group).tolist()]
            ids, n = self.whole(own) if between is None else self._together(own, between)
            sizes[group] = n
            parts.append((group, ids))
        out = np.zeros(int(sizes.sum()), np.uint32)
        for group, ids in parts:
            out[np.repeat(group, sizes)] = ids
        return out, sizes

    def _together(self, units: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for units whose pieces do not change when they stand one after another."""
        groups = [units[at : at + self.TOGETHER] for at in range(0, len(units), self.TOGETHER)]
        ids, _ = self.whole(["".join(u + between for u in g) for g in groups])
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum(pc.binary_length(pa.array(units, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) + len(between))
        last = np.searchsorted(ends, wanted)  # the token that ends each unit and what follows it
        if len(wanted) and not (last[-1] < len(ends) and np.array_equal(ends[last], wanted)):
            return self.whole(units)
        sizes = np.diff(np.append(-1, last))
        if between and len(units):
            if not (self.lengths[ids[last]] == len(between)).all():
                return self.whole(units)
            ids, sizes = np.delete(ids, last), sizes - 1
        return ids, sizes


@lru_cache(maxsize=4)
def byte_level(path: str, special: bool) -> ByteLevel:
    return ByteLevel(path, special)


@lru_cache(maxsize=4)
def _units(path: str, special: bool, remembered: int) -> Remembered:
    return Remembered(byte_level(path, special).encode, remembered)


def encode_texts(texts: pa.Array, path: str, special: bool, remembered: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the number of ids of each text; a null text has none."""
    tokenizer, texts = byte_level(path, special), texts.fill_null("")
    if not tokenizer.splits:
        return tokenizer.whole(texts.to_pylist())
    data, bounds = flat(texts)
    starts = tokenizer.starts(data, bounds)
    ids, sizes = _units(path, special, remembered).ids(strings(data, np.append(starts, len(data))))
    return ids, counted(sizes, starts, bounds)
