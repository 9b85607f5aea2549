"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the
corpus. Not every suffix has to be sorted for that: the least of the `gram` hashes inside a
window of `length` bytes marks an anchor, and equal windows have equal anchors at equal
places. Anchors whose gram hash occurs once are dropped; the suffixes at all others are
sorted. Each task sorts runs of its suffixes, front-codes them (length of the prefix shared
with the one before, then the rest) and cuts them at common splitters; a range's runs are
merged by a loser tree whose nodes know the common prefix with the last output, so that no
byte of a known prefix is compared again. The merge hands on the common prefix of neighbours.

Around an anchor, the window that begins d bytes before it repeats if the first length - d
bytes of the suffix and the d bytes before it do. Neighbours' common prefixes give the first
as segments of the sorted order; hashes of the d bytes before the anchor split the segments.
Equal contexts are one in a run and one in the merge, so a text with very many copies costs
its range one entry per run, and verdicts return to all occurrences by a join.

Defined results: a null text is an empty one; texts shorter than `length` lose nothing;
repeated rows are repeats of each other. What is kept may end inside a character, so it is
binary. An empty table gives an empty result. Texts are gone through in pieces.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import materialize
from tidemill.llm.neardup import _mix

PIECE = 1 << 18


@dataclass(frozen=True)
class RepeatSettings:
    length: int = 200
    gram: int = 100
    run_suffixes: int = 50_000  # suffixes that are sorted at once
    range_suffixes: int = 50_000  # of one range, on average
    splitter_bytes: int = 32
    samples_per_range: int = 10
    listed: int = 1_000_000  # rows of a side table that may be broadcast
    seed: int = 9


@lru_cache(maxsize=4)
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
    base = int(rng.integers(1 << 40, 1 << 62)) | 5
    back = pow(base, -1, 1 << 64)

    def powers(x):
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return codes, powers(base), powers(back)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) of every `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(data: bytes, s: RepeatSettings) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of a text."""
    places, hashes, spare = [], [], s.length - s.gram
    for at in range(0, max(0, len(data) - s.length + 1), PIECE):
        own = np.frombuffer(data[at : at + PIECE + s.length - 1], np.uint8)
        codes, powers, back = _powers(PIECE + s.length, s.seed)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes[own] * powers[: len(own)], dtype=np.uint64)))
        gram = _mix((sums[s.gram :] - sums[: -s.gram]) * back[: len(own) - s.gram + 1]) | np.uint64(1)
        least = _sliding(gram, spare + 1, np.minimum)
        padded = np.concatenate((np.zeros(spare, np.uint64), least, np.zeros(spare, np.uint64)))
        found = np.flatnonzero(_sliding(padded, spare + 1, np.maximum) == gram)
        places.append(found + at)
        hashes.append(gram[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where, first = np.unique(np.concatenate(places), return_index=True)
    return where, np.concatenate(hashes)[first]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("data"))
    return rows.withColumn("row", F.xxhash64("doc_id", "data"))


def _anchor_rows(rows: DataFrame, s: RepeatSettings) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for row, data in zip(batch.column("row").to_pylist(), batch.column("data")):
                where, what = anchors(data.as_py(), s)
                own.append(np.full(len(where), row))
                places.append(where)
                hashes.append(what)
            columns = np.concatenate(hashes).view(np.int64), np.concatenate(own), np.concatenate(places)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["hash", "row", "at"])

    return rows.filter(F.octet_length("data") >= s.length).select("row", "data").mapInArrow(find, "hash long, row long, at long")


def _contexts(batch: pa.RecordBatch, s: RepeatSettings) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(row, place, bytes before, suffix) of every anchor of a batch."""
    before = s.length - s.gram
    for row, data, places in zip(batch.column("row").to_pylist(), batch.column("data"), batch.column("places").to_pylist()):
        data = data.as_py()
        for at in places:
            yield row, at, data[max(0, at - before) : at], data[at : at + s.length]


def _context_id(left: bytes, right: bytes) -> bytes:
    return hashlib.blake2b(b"%d:" % len(left) + left + right, digest_size=16).digest()


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree in the first `at` bytes."""
    end = min(len(a), len(b))
    while at + 16 <= end and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < end and a[at] == b[at]:
        at += 1
    return at


def front_code(run: list[tuple[bytes, bytes, int]]) -> bytes:
    """A sorted run of (suffix, before, count): each suffix as what differs from the last one."""
    out, last = [], b""
    for right, left, count in run:
        shared = common_prefix(last, right, 0)
        out.append(struct.pack("<HHHI", shared, len(right) - shared, len(left), count) + right[shared:] + left)
        last = right
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def front_decode(data: bytes) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(prefix shared with the one before, suffix, before, count) of a front-coded run."""
    raw, at, last = zstandard.ZstdDecompressor().decompress(data), 0, b""
    while at < len(raw):
        shared, n, m, count = struct.unpack_from("<HHHI", raw, at)
        at += 10
        last = last[:shared] + raw[at : at + n]
        yield shared, last, raw[at + n : at + n + m], count
        at += n + m


def merge_runs(runs: list[Iterator[tuple[int, bytes, bytes, int]]]) -> Iterator[tuple[int, bytes, bytes, int]]:
    """Sorted runs to one sorted run, by a loser tree that knows common prefixes.

    Every waiting entry carries the length of its common prefix with the last winner. Of two
    entries the one that shares more with it is smaller; only at equal lengths are bytes
    compared, from that length on. The first number of an output is its common prefix with
    the output before it.
    """
    size = 1 << max(0, (len(runs) - 1).bit_length())
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size  # of each head with the last output
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        both = common_prefix(x[1], y[1], shared[a])
        first, second = (a, b) if (x[1][both : both + 1], a) <= (y[1][both : both + 1], b) else (b, a)
        shared[second] = both
        return first, second

    winners = [*([0] * size), *range(size)]
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while heads[top] is not None:
        entry = heads[top]
        yield (shared[top], *entry[1:])
        heads[top] = next(runs[top], None)
        shared[top] = heads[top][0] if heads[top] is not None else 0
        node = (top + size) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1


def verdicts(merged: Iterator[tuple[int, bytes, bytes, int]], s: RepeatSettings) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """(context id, repeated stretches relative to the anchor) from sorted contexts."""
    spare = s.length - s.gram
    rows: dict[tuple[bytes, bytes], int] = {}
    prefixes, last = [], None
    for shared, right, left, count in merged:
        if right != last:
            if last is not None and shared < s.gram:
                yield from _judge(rows, prefixes, s, spare, flush=len(rows) > 20_000)
                if len(rows) > 20_000:
                    rows, prefixes = {}, []
            last = right
        if (right, left) in rows:
            rows[right, left] += count
        else:
            rows[right, left] = count
            prefixes.append(shared)
    yield from _judge(rows, prefixes, s, spare, flush=True)


def _judge(rows: dict, prefixes: list[int], s: RepeatSettings, spare: int, flush: bool) -> Iterator:
    if not flush or not rows:
        return
    keys, counts = list(rows), np.fromiter(rows.values(), np.int64, len(rows))
    shared = np.array(prefixes, np.int64)
    shared[0] = 0
    near = shared >= s.gram
    near[:-1] |= near[1:].copy()
    index = np.flatnonzero(near | (counts > 1))
    if not len(index):
        return
    # leaving others out keeps prefixes: they share less than a gram with both neighbours
    shared, counts = np.where(np.diff(index, prepend=-2) == 1, shared[index], 0), counts[index]
    rights = np.array([len(keys[i][0]) for i in index.tolist()])
    lefts = np.array([len(keys[i][1]) for i in index.tolist()])
    padded = b"".join(keys[i][1].rjust(spare, b"\0") for i in index.tolist())
    before = np.frombuffer(padded, np.uint8).reshape(len(index), spare) if spare else np.zeros((len(index), 0), np.uint8)
    hashed, repeated = np.zeros(len(index), np.uint64), np.zeros((len(index), spare + 1), bool)
    for d in range(spare + 1):
        if d:
            hashed = _mix(hashed * np.uint64(0x9E3779B97F4A7C15) + before[:, spare - d] + np.uint64(1))
        valid = np.flatnonzero((lefts >= d) & (rights >= s.length - d))
        segment = np.cumsum(shared < s.length - d)
        key = _mix(hashed[valid] + segment[valid].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, place = np.unique(key, return_inverse=True)
        repeated[valid, d] = np.bincount(place, weights=counts[valid])[place] > 1
    edges = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    for i, k in enumerate(index.tolist()):
        starts, ends = np.flatnonzero(edges[i] == 1), np.flatnonzero(edges[i] == -1)
        if len(starts):
            # windows that begin from `end - 1` down to `start` bytes before the anchor
            right, left = keys[k]
            yield _context_id(left, right), [(1 - int(b), s.length - int(a)) for a, b in zip(starts, ends)]


def _splitters(sources: DataFrame, total: int, s: RepeatSettings) -> list[bytes]:
    """Beginnings of suffixes that cut the sorted order into ranges of about equal size."""
    ranges = -(-total // s.range_suffixes)
    wanted = ranges * s.samples_per_range

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                right[: s.splitter_bytes]
                for row, at, _, right in _contexts(batch, s)
                if (row * 0x9E3779B97F4A7C15 + at * 0xBF58476D1CE4E5B9) % (1 << 64) < (wanted << 64) // total
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["begin"])

    found = sorted({bytes(r["begin"]) for r in sources.mapInArrow(sample, "begin binary").collect()})
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def repeated_spans(rows: DataFrame, settings: RepeatSettings) -> DataFrame:
    """row and its merged repeated stretches, for rows (row, data) that have any."""
    s = settings
    marked = _anchor_rows(rows, s)
    often = marked.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    places = marked.join(often, "hash").groupBy("row").agg(F.collect_set("at").alias("places"))
    places = materialize(places, "repeat-places")
    found = places.select("row")
    found = F.broadcast(found) if found.count() <= s.listed else found
    sources = rows.select("row", "data").join(found, "row", "left_semi").join(places, "row")
    sources = materialize(sources, "repeat-sources")
    total = sources.agg(F.sum(F.size("places"))).first()[0] or 0
    nothing = "row long, spans array<struct<start:long,stop:long>>"
    if not total:
        return rows.sparkSession.createDataFrame([], nothing)
    cuts = sources.sparkSession.sparkContext.broadcast(_splitters(sources, total, s))

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(seen: dict) -> pa.RecordBatch:
            run = sorted((right, left, n) for (right, left), n in seen.items())
            parts: dict[int, list] = {}
            for entry in run:
                parts.setdefault(bisect_right(cuts.value, entry[0]), []).append(entry)
            coded = [pa.array(list(parts), pa.int32()), pa.array([front_code(p) for p in parts.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(coded, names=["part", "run"])

        seen: dict[tuple[bytes, bytes], int] = {}
        for batch in batches:
            for _, _, left, right in _contexts(batch, s):
                seen[right, left] = seen.get((right, left), 0) + 1
                if len(seen) >= s.run_suffixes:
                    yield cut(seen)
                    seen = {}
        yield cut(seen)

    def merge(part: pa.Table) -> pa.Table:
        runs = [front_decode(run.as_py()) for run in part.column("run")]
        ids, starts, stops = [], [], []
        for context, stretches in verdicts(merge_runs(runs), s):
            for start, stop in stretches:
                ids.append(context)
                starts.append(start)
                stops.append(stop)
        return pa.table({"context": pa.array(ids, pa.binary()), "start": pa.array(starts, pa.int64()), "stop": pa.array(stops, pa.int64())})

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, at, _context_id(left, right)) for row, at, left, right in _contexts(batch, s)]
            columns = zip(*found) if found else ([], [], [])
            kinds = pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "at", "context"])

    runs = sources.mapInArrow(sort_runs, "part int, run binary")
    judged = runs.groupBy("part").applyInArrow(merge, "context binary, start long, stop long")
    judged = materialize(judged, "repeat-verdicts")
    named = sources.mapInArrow(name, "row long, at long, context binary")
    each = named.join(judged, "context").select("row", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop"))
    spans = each.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return spans.mapInArrow(_merge_spans, nothing)


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches that touch or overlap become one."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            merged: list[dict] = []
            for x in spans:
                if merged and x["start"] <= merged[-1]["stop"]:
                    merged[-1]["stop"] = max(merged[-1]["stop"], x["stop"])
                else:
                    merged.append(dict(x))
            out.append(merged)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], names=["row", "spans"])


def remove_repeats(docs: DataFrame, key: str, text: str, settings: RepeatSettings | None = None) -> DataFrame:
    """doc_id, n_bytes, the removed spans and the kept bytes of every row of `docs`."""
    s = settings or RepeatSettings()
    rows = _rows(docs, key, text)
    spans = materialize(repeated_spans(rows, s), "repeat-spans")
    size = spans.agg(F.sum(F.size("spans") + 1)).first()[0] or 0
    joined = rows.join(F.broadcast(spans) if size <= s.listed else spans, "row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for data, spans in zip(batch.column("data"), batch.column("spans").to_pylist()):
                data, parts, at = data.as_py(), [], 0
                for x in spans or []:
                    parts.append(data[at : x["start"]])
                    at = x["stop"]
                kept.append(b"".join([*parts, data[at:]]) if at else data)
            columns = [batch.column(c) for c in ("doc_id", "n_bytes", "spans")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    none = F.array().cast("array<struct<start:long,stop:long>>")
    joined = joined.select("doc_id", F.octet_length("data").cast("bigint").alias("n_bytes"), F.coalesce("spans", none).alias("spans"), "data")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
