"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

Each document's set of word shingles gets a signature of `chunks` x `width` values of b
bits. Two signatures that differ in at most `chunks` x (`errors` + 1) - 1 values have, by
pigeonhole, a chunk in which at most `errors` values differ. So every way of leaving
`errors` values of a chunk out is an index key: signatures within that distance always share
one of chunks x binomial(width, errors) keys. With the defaults, 75 keys find all pairs
within 14 of 30 values; at a similarity of 0.8 a pair lies beyond that less than three times
in ten thousand, and misses all keys once in a hundred thousand.

Links are confirmed on the full shingle sets, and no group is ever compared pair by pair
while it hangs together: (1) documents with equal sets are one; (2) in each key's group
everything is compared with one pivot only, several times with other pivots, and components
are formed; (3) what then shares a key across components is compared, filtered by size and
by 1-bit signatures before any set is fetched: a short one of every document, then a long one
that only the documents left in such groups get. At a similarity of 0.8 the long one rules a
pair out once in fifty million. Of all keys that a pair shares only the first one emits it.
This comparison is still one of all pairs in a group, but of whole arrays of signatures, some
nanoseconds a pair, and large groups are cut into pairs of blocks. A set is sent once to
where its pairs of a group are confirmed.
So pairs are never emitted for a group, only those that the signatures hold for similar; a
group of copies costs one comparison for each member and round.

Defined results: a null text or one without words has an empty set, is linked with nothing
and stays. Fewer words than a shingle make one shingle of all words. Rows that repeat a doc
id are one document that has every link of each of its texts. A row with a null doc id falls
to the class of an equal set and is otherwise linked with nothing and stays. Ties do not
arise: the smallest doc id represents. Texts are read whole; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import components, materialize, release, slices

BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # of bytes: A-Z and nothing else
PRIME = np.uint64(0x9E3779B97F4A7C15)
PLACES = 64  # of a word, whose terms are looked up
SLICE = 512 << 10  # bytes of text whose arrays are made at once, one text at least
CELL = ["key", "low", "high"]
MEETING = ["cell", "low", "high"]
SKETCHES = ["k0", "k1", "k2"]  # 64 values of the 1-bit signature each


@dataclass(frozen=True)
class NearSettings:
    shingle: int = 5
    similarity: int = 80  # per cent
    chunks: int = 5
    width: int = 6  # values in a chunk
    errors: int = 2  # values of a chunk that may differ
    bits: int = 16  # of a signature value
    sketch_distance: int = 43  # of 192 bits; 0.8 differs in 19 +- 4, 0.3 in 67 +- 7
    fine: int = 2048  # bits of the long signature
    fine_distance: int = 280  # of them that may differ; 0.8 differs in 205 +- 14, 0.7 in 307 +- 16
    pivots: int = 2  # rounds of comparing with one member
    listed: int = 250_000  # ids that may be broadcast; more go through a shuffle
    block: int = 8192  # rows of a key that are compared in one task; more go in pairs of blocks
    met: int = 8 << 20  # bytes of sets that are compared in one task; more go in pairs of parts
    held: int = 16 << 20  # bytes of sets that may be broadcast; more go through a shuffle
    seed: int = 5

    @property
    def values(self) -> int:
        return self.chunks * self.width

    @property
    def slots(self) -> list[tuple[int, tuple[int, ...]]]:
        """(chunk, values kept of it) of every key, in order."""
        return [(c, kept) for c in range(self.chunks) for kept in combinations(range(self.width), self.width - self.errors)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TERMS = _mix(np.arange(PLACES << 8, dtype=np.uint64) + np.uint64(1))

def _word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts, the same on every machine, and where each text's begin."""
    texts, n = texts.cast(pa.string()).fill_null(""), len(texts)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    letter = ~BLANK[data]
    head = letter.copy()
    head[1:] &= ~letter[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    head[begins] = letter[begins]
    heads = np.flatnonzero(head)
    if not len(heads):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    places = np.flatnonzero(letter)
    data, starts = LOWER[data[places]], np.flatnonzero(head[places])
    sizes = np.diff(starts, append=len(places))
    places -= np.repeat(heads, sizes)
    if sizes.max() <= PLACES:
        terms = TERMS[(places << 8) + data]
    else:
        terms = _mix((places.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1))
    return _mix(np.add.reduceat(terms, starts) + sizes.astype(np.uint64)), np.searchsorted(heads, bounds)


def _shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """The code of every run of `size` words."""
    mixed = np.full(max(0, len(codes) - size + 1), np.uint64(size))
    for k in range(size):
        mixed = (mixed ^ codes[k : k + len(mixed)]) * PRIME
        mixed = mixed ^ (mixed >> np.uint64(29))
    return _mix(mixed)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit codes of each text's word shingles, one text after the other, and where each text's begin."""
    words, at = _word_codes(texts)
    counts = np.diff(at)
    runs = np.where(counts < size, counts > 0, counts - size + 1)
    ends = np.cumsum(runs)
    full, starts = np.flatnonzero(runs), ends - runs
    every, codes = _shingles(words, size), np.empty(int(runs.sum()), np.uint64)
    for i in full:
        own = codes[starts[i] : ends[i]]
        own[:] = every[at[i] : at[i] + runs[i]] if counts[i] >= size else _shingles(words[at[i] : at[i + 1]], int(counts[i]))
        own.sort()
    fresh = np.ones(len(codes), bool)
    fresh[1:] = codes[1:] != codes[:-1]
    fresh[starts[full]] = True
    return codes[fresh], np.concatenate([[0], np.cumsum(fresh)])[np.concatenate([[0], ends]).astype(np.int64)]


def _seeds(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _minima(codes: np.ndarray, bounds: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> Iterator[np.ndarray]:
    """The least value of each hash function over each set; functions x sets, 64 functions at a time."""
    full = np.flatnonzero(np.diff(bounds))
    short = (codes >> np.uint64(32)).astype(np.uint32)
    values = np.empty_like(short)
    for at in range(0, len(factors), 64):
        least = np.full((len(factors[at : at + 64]), len(bounds) - 1), 0xFFFFFFFF, np.uint32)
        for row, factor, shift in zip(least, factors[at:], shifts[at:]):
            if len(full):
                np.multiply(np.bitwise_xor(short, shift, out=values), factor, out=values)
                row[full] = np.minimum.reduceat(values, bounds[full])
        yield _mix(least.astype(np.uint64) + np.uint64(1))


def minima(codes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    return np.concatenate([x[:, 0] for x in _minima(codes, np.array([0, len(codes)]), factors, shifts)])


def _bits(least: Iterator[np.ndarray]) -> np.ndarray:
    """The lowest bit of every value, packed; sets x words of 64 bits."""
    packed = [np.packbits((x & np.uint64(1)).astype(np.uint8), axis=0) for x in least]
    return np.ascontiguousarray(np.concatenate(packed).T).view("<i8")


def _digests(codes: np.ndarray, bounds: np.ndarray, salt: np.uint64) -> np.ndarray:
    digests, full = np.zeros(len(bounds) - 1, np.uint64), np.flatnonzero(np.diff(bounds))
    if len(full):
        digests[full] = np.add.reduceat(_mix(codes * salt + salt), bounds[full])
    return digests.astype(np.int64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel()))


def signatures(docs: DataFrame, key: str, text: str, settings: NearSettings) -> DataFrame:
    """doc_id, n_shingles, the set's digest, the b-bit signature and the 1-bit sketch."""
    s = settings

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _seeds(s.seed, s.values + 64 * len(SKETCHES))
        mask = np.uint64((1 << s.bits) - 1)
        for batch in slices(batches, "text", SLICE):
            codes, bounds = shingle_sets(batch.column("text"), s.shingle)
            values = np.concatenate(list(_minima(codes, bounds, factors[: s.values], shifts[: s.values])))
            sketch = _bits(_minima(codes, bounds, factors[s.values :], shifts[s.values :]))
            digests = [_digests(codes, bounds, salt) for salt in (PRIME, np.uint64(0xD6E8FEB86659FD93))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), *map(pa.array, digests),
                 _lists((values & mask).astype(np.uint16).view(np.int16).T), *(pa.array(np.ascontiguousarray(k)) for k in sketch.T)],
                names=["doc_id", "n", "d0", "d1", "signature", *SKETCHES],
            )

    rows = _documents(docs, key, text)
    return rows.mapInArrow(measure, "doc_id long, n long, d0 long, d1 long, signature array<smallint>, k0 long, k1 long, k2 long")


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def index_keys(signed: DataFrame, settings: NearSettings) -> DataFrame:
    """(doc_id, slot, key): every chunk with every choice of `errors` of its values left out."""
    keys = []
    for chunk, kept in settings.slots:
        parts = [F.col("signature")[chunk * settings.width + i] for i in kept]
        keys.append(F.xxhash64(F.lit(chunk * 1000 + sum(1 << i for i in kept)), *parts))
    return signed.select("doc_id", F.posexplode(F.array(*keys)).alias("slot", "key"))


def _fine(docs: DataFrame, ids: DataFrame, settings: NearSettings) -> DataFrame:
    """(doc_id, d0, fine) of the documents in `ids`: the long signature, told apart by the set's digest."""
    s = settings

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _seeds(s.seed + 1, s.fine)
        for batch in slices(batches, "text", SLICE):
            codes, bounds = shingle_sets(batch.column("text"), s.shingle)
            fine = _lists(_bits(_minima(codes, bounds, factors, shifts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_digests(codes, bounds, PRIME)), fine], names=["doc_id", "d0", "fine"]
            )

    rows = _listed(docs, ids, s).mapInArrow(measure, "doc_id long, d0 long, fine array<long>")
    return rows.dropDuplicates()


def _listed(docs: DataFrame, ids: DataFrame, settings: NearSettings) -> DataFrame:
    """The documents in `ids`; a counted list may be broadcast, a longer one is joined through a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= settings.listed else ids, "doc_id", "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, settings: NearSettings) -> DataFrame:
    """(doc_id, size, codes) of the documents in `ids`, codes as bytes, `size` of them."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            codes, bounds = shingle_sets(batch.column("text"), settings.shingle)
            data, offsets = pa.py_buffer(codes.astype("<u8")), pa.py_buffer((8 * bounds).astype(np.int32))
            sets = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, data])
            size = pa.array(8 * np.diff(bounds))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, sets], names=["doc_id", "size", "codes"])

    return _listed(docs, ids, settings).mapInArrow(measure, "doc_id long, size long, codes binary")


def _similar(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small) or 100 * len(small) < similarity * len(large):
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * common >= similarity * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, docs: DataFrame, settings: NearSettings) -> DataFrame:
    """Of the pairs (a, b), which have a cell in common: those whose sets are similar enough; written."""
    s = settings
    sets = materialize(_sets(docs, _ends(pairs), s), "sets")
    size = sets.agg(F.sum(F.col("size") + 8)).first()[0] or 0
    if size <= s.held:
        rows = sets.drop("size").toArrow()
        found: dict[int, list[bytes]] = {}  # at most `held` bytes
        for doc_id, codes in zip(rows.column("doc_id").to_pylist(), rows.column("codes").to_pylist()):
            found.setdefault(doc_id, []).append(codes)
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {k: [np.frombuffer(c, "<u8") for c in v] for k, v in shared.value.items()}
            for batch in batches:
                flags = [
                    any(_similar(x, y, s.similarity) for x in known.get(a, []) for y in known.get(b, []))
                    for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
                ]
                yield batch.filter(pa.array(flags, pa.bool_()))

        del rows, found
        links = materialize(pairs.select("a", "b").mapInArrow(look_up, "a long, b long"), "links")
        shared.destroy()
        release(sets)
        return links

    large = _large_cells(pairs, sets, s)
    rows = _met(pairs, sets, large, s)
    dealt = rows.repartition(*MEETING).sortWithinPartitions(*MEETING, F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known = None, {}  # the sets of one meeting place, which come before its pairs
        for batch in batches:
            links = []
            for *here, a, b, codes in zip(*(batch.column(c).to_pylist() for c in [*MEETING, "a", "b", "codes"])):
                if here != place:
                    place, known = here, {}
                if b is None:
                    known.setdefault(a, []).append(np.frombuffer(codes, "<u8"))
                elif any(_similar(x, y, s.similarity) for x in known.get(a, []) for y in known.get(b, [])):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    links = materialize(dealt.mapInArrow(compare, "a long, b long"), "links")
    release(sets, large)
    return links


def _large_cells(pairs: DataFrame, sets: DataFrame, settings: NearSettings) -> DataFrame:
    """(cell, size) of cells whose sets have more than `met` bytes, so they are few; written."""
    sizes = sets.select("doc_id", "size").groupBy("doc_id").agg(F.sum("size").alias("size"))
    cells = _ends(pairs, "cell").join(sizes, "doc_id").groupBy("cell").agg(F.sum("size").alias("size"))
    return materialize(cells.filter(F.col("size") > settings.met), "large-cells")


def _met(pairs: DataFrame, sets: DataFrame, large: DataFrame, settings: NearSettings) -> DataFrame:
    """Pairs (a, b) and the sets they need, `b` null, by meeting place: a cell, or of a large one a pair of its parts.

    A set is sent to a place once, however many pairs it has there, so what is moved does not
    grow with the pairs.
    """
    parts = F.coalesce(F.ceil(F.col("size") / settings.met), F.lit(1))
    placed = pairs.join(F.broadcast(large), "cell", "left").withColumn("parts", parts)
    own, other = (F.pmod(F.xxhash64(c, F.lit(settings.seed)), "parts") for c in ("a", "b"))
    placed = placed.select("cell", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), "a", "b")
    needed = _ends(placed, *MEETING).join(sets.select("doc_id", "codes"), "doc_id")
    none = F.lit(None)
    return needed.select(*MEETING, F.col("doc_id").alias("a"), none.cast("long").alias("b"), "codes").union(
        placed.select(*MEETING, "a", "b", none.cast("binary"))
    )


def _ends(pairs: DataFrame, *place: str) -> DataFrame:
    """The documents that have a pair in a place."""
    return pairs.select(*place, F.col("a").alias("doc_id")).union(pairs.select(*place, "b")).distinct()


def _representatives(signed: DataFrame) -> DataFrame:
    """One row per distinct non-empty set, with the smallest doc id that has it."""
    return signed.filter("n > 0").groupBy("n", "d0", "d1").agg(
        F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("signature", *SKETCHES))
    )


def _shared_keys(unique: DataFrame, settings: NearSettings) -> DataFrame:
    """The index rows of keys that several documents have; a null id would be linked with nothing.

    Keys are dealt once: the count of a key and the keeping of its rows read the same rows and
    columns, so Spark reuses the exchange.
    """
    keyed = index_keys(unique.filter("doc_id IS NOT NULL"), settings).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("slot").alias("first"))
    shared = shared.filter("lo < hi AND first >= 0").select("key")
    return keyed.join(shared.hint("shuffle_hash"), "key")


def _apart(keyed: DataFrame) -> DataFrame:
    """The rows of keys that are found in more than one component."""
    groups = keyed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return keyed.join(groups.select("key"), "key")


def _pivot_pairs(keyed: DataFrame, settings: NearSettings, turn: int) -> DataFrame:
    """(a, b): each member of a key's group against the group's pivot, where components differ; the pivot is the cell."""
    rank = F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("r"), "doc_id", "component", "n", *SKETCHES)
    groups = keyed.groupBy("key").agg(F.min(rank).alias("p"))
    near = keyed.join(groups, "key").filter("component <> p.component").filter(_close(settings, "", "p."))
    return near.select(F.col("p.doc_id").alias("cell"), F.col("p.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _close(settings: NearSettings, left: str, right: str):
    """Sizes and 1-bit sketches allow the similarity."""
    a, b = F.col(f"{left}n"), F.col(f"{right}n")
    distance = sum(F.bit_count(F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}"))) for k in SKETCHES)
    return (100 * F.least(a, b) >= settings.similarity * F.greatest(a, b)) & (distance <= settings.sketch_distance)


def _first_shared(settings: NearSettings):
    """The row's slot is the first one whose key both signatures share; `_compared` holds the same on arrays.

    A chunk before it must differ in too many values, and in its own chunk the values kept must
    be the first that agree.
    """
    s, first = settings, F.lit(True)
    skipped = [sum(1 << i for i in range(kept[-1]) if i not in kept) for _, kept in s.slots]
    chunk = F.element_at(F.array(*(F.lit(c) for c, _ in s.slots)), F.col("a.slot") + 1)
    skip = F.element_at(F.array(*map(F.lit, skipped)), F.col("a.slot") + 1)
    for c in range(s.chunks):
        same = (F.col("a.signature")[c * s.width + i] == F.col("b.signature")[c * s.width + i] for i in range(s.width))
        agree = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(same)), F.lit(0))
        own, before = agree.bitwiseAND(skip) == 0, F.bit_count(agree) < s.width - s.errors
        first = first & F.when(chunk == c, own).when(chunk > c, before).otherwise(True)
    return first


def _cross_pairs(keyed: DataFrame, unique: DataFrame, docs: DataFrame, settings: NearSettings) -> DataFrame:
    """(a, b): members of one key's group in different components, all of `keyed` in such groups, filtered before they are emitted; the key is the cell; written."""
    ids = materialize(keyed.select("doc_id").distinct(), "apart-ids")
    fine_rows = materialize(_fine(docs, ids, settings), "fine")
    fine = unique.select("doc_id", "d0", "signature").join(fine_rows, ["doc_id", "d0"])
    rows = _cells(keyed, settings).join(fine, ["doc_id", "d0"]).drop("d0")
    dealt = rows.repartition(*CELL).sortWithinPartitions(*CELL)
    pairs = materialize(dealt.mapInArrow(_compared(settings), "cell long, a long, b long"), "pairs")
    release(fine_rows, ids)
    return pairs


def _cells(keyed: DataFrame, settings: NearSettings) -> DataFrame:
    """The rows of a key in cells: all pairs of `block` rows, or of two blocks, `own` the row's. Every pair of rows has one cell."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > settings.block)
    blocks = F.coalesce(F.ceil(F.col("size") / settings.block), F.lit(1))
    rows = keyed.join(F.broadcast(sizes), "key", "left").withColumn("blocks", blocks)  # one size for `block` rows at most
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    return rows.select("*", *cell).drop("size", "blocks", "other")


def _compared(settings: NearSettings):
    """For batches sorted by cell: (key, a, b) of the rows of a cell that the signatures hold for similar, from the first key they share."""
    s = settings
    kept_of = np.zeros((len(s.slots), s.values), np.float32)
    for slot, (chunk, kept) in enumerate(s.slots):
        kept_of[slot, [chunk * s.width + i for i in kept]] = 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole cells."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in CELL])
            last = held and [held[-1].column(c)[-1].as_py() for c in CELL]
            changes = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            if held and cell[:, :1].ravel().tolist() != last:
                changes = np.concatenate([[0], changes])
            if len(changes):
                cut = int(changes[-1])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def pairs(rows: pa.Table) -> Iterator[np.ndarray]:
        cell = np.stack([rows.column(c).to_numpy() for c in CELL])
        group = np.concatenate([[0], np.cumsum((cell[:, 1:] != cell[:, :-1]).any(axis=0))])
        sizes = np.bincount(group)
        order = np.argsort(-sizes[group], kind="stable")  # what is d rows apart in a cell lies in a prefix
        group, sizes = group[order], -np.sort(-sizes)
        ends = np.cumsum(sizes)
        doc, component, n, own, slot = (rows.column(c).to_numpy()[order] for c in ("doc_id", "component", "n", "own", "slot"))
        key, within = cell[0][order], (cell[1] == cell[2])[order]
        sketch = [rows.column(c).to_numpy()[order].view(np.uint64) for c in SKETCHES]
        fine, signature = (
            rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order] for c in ("fine", "signature")
        )
        fine = fine.view(np.uint64)
        for apart in range(1, int(sizes[0])):
            end = int(ends[np.searchsorted(-sizes, -apart) - 1])  # of the cells with more than `apart` rows
            x, y = slice(0, end - apart), slice(apart, end)
            distance = sum(np.bitwise_count(k[x] ^ k[y]) for k in sketch)
            near = (distance <= s.sketch_distance) & (group[x] == group[y]) & (component[x] != component[y])
            i = np.flatnonzero(near)
            j = i + apart
            i = i[similar := 100 * np.minimum(n[i], n[j]) >= s.similarity * np.maximum(n[i], n[j])]
            j = j[similar]
            if len(i):
                kept = np.bitwise_count(fine[i] ^ fine[j]).sum(axis=1, dtype=np.int64) <= s.fine_distance
                kept &= within[i] | (own[i] != own[j])
                i, j = i[kept], j[kept]
                agree = (signature[i] == signature[j]).astype(np.float32) @ kept_of.T == s.width - s.errors
                first = agree.argmax(axis=1) == slot[i]
                i, j = i[first], j[first]
            if len(i):
                swap = component[i] > component[j]
                yield np.stack([key[i], np.where(swap, doc[j], doc[i]), np.where(swap, doc[i], doc[j])])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cells(batches):
            found, n = [], 0
            for pair in pairs(rows):
                found.append(pair)
                n += pair.shape[1]
                if n >= 1 << 16:
                    yield batch_of(found)
                    found, n = [], 0
            if found:
                yield batch_of(found)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, np.concatenate(found, axis=1))], names=["cell", "a", "b"])

    return compare


def near_duplicates(docs: DataFrame, key: str, text: str, settings: NearSettings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of `docs`."""
    s, rows = settings or NearSettings(), _documents(docs, key, text)
    signed = materialize(signatures(rows, "doc_id", "text", s), "signatures")
    unique = materialize(_representatives(signed), "representatives")
    keyed = _shared_keys(unique, s).join(unique.select("doc_id", "n", "d0", *SKETCHES), "doc_id")
    keyed = materialize(keyed.withColumn("component", F.col("doc_id")), "index")
    named = None  # (node, component) of what is linked so far
    for turn in range(s.pivots + 1):
        pairs = materialize(_pivot_pairs(keyed, s, turn), "pairs") if turn < s.pivots else _cross_pairs(keyed, unique, rows, s)
        if pairs.isEmpty():
            continue
        found = _confirmed(pairs, rows, s)
        release(pairs)
        if found.isEmpty():
            continue
        # links become edges between the components so far
        edges = found if named is None else _renamed(_renamed(found, "a", named), "b", named)
        fresh = components(edges, "components")
        release(found)
        if named is None:
            named = fresh
        else:
            moved = _renamed(named, "component", fresh)
            named = materialize(moved.union(fresh.join(named, "node", "left_anti")), "components")
        # components only grow, so keys whose rows have met are done with
        before, keyed = keyed, materialize(_apart(_renamed(keyed, "component", fresh)), "index")
        release(before)
    classes = unique.select("n", "d0", "d1", F.col("doc_id").alias("component_id"))
    if named is not None:
        classes = _renamed(classes, "component_id", named)
    bound = _bound_by_id(signed, classes, s)
    if bound is not None:
        classes = _renamed(classes, "component_id", bound)
    joined = signed.join(classes, ["n", "d0", "d1"], "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _bound_by_id(signed: DataFrame, classes: DataFrame, settings: NearSettings) -> DataFrame | None:
    """(node, component) of the components that hold different sets of one doc id; None without such ids."""
    sets = signed.filter("n > 0 and doc_id is not null").select("doc_id", "n", "d0", "d1")
    one = F.struct("n", "d0", "d1")
    ids = sets.groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo <> hi").select("doc_id")
    ids = materialize(ids, "repeated-ids")
    if ids.isEmpty():
        return None
    held = materialize(_listed(sets, ids, settings).join(classes, ["n", "d0", "d1"]).select("doc_id", "component_id").distinct(), "repeated")
    least = held.groupBy("doc_id").agg(F.min("component_id").alias("b"))
    edges = held.join(least, "doc_id").select(F.col("component_id").alias("a"), "b").filter("a <> b")
    return components(edges, "components")


def _renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """`column` replaced by its component where it has one."""
    names = names.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    joined = df.join(names, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_component", column)).drop("_node", "_component")
