"""Alignment of two tokenizers over the same bytes, by a monoid of fragments.

Both token streams of a text cover the same bytes. Where tokens of both end at one byte, the
text is cut; between two cuts lies a group. A fragment describes a range of bytes, whatever
stands before and after it: the tokens up to its first cut (open prefix), the groups between
its cuts (closed), and the tokens behind its last cut (open suffix); without a cut there is only
an open prefix. Joining two neighbours closes what the suffix of the first and the prefix of the
second make together. That is associative, so a long document is cut into ranges of
`chunk_bytes`, whose fragments are made and joined by any tasks in a tree of `fan` a level;
shorter documents are one range.

Two tokens are linked if their bytes overlap. The boundaries of both streams cut a text into
segments, and each segment is one link. Links are counted over the corpus with partial sums;
pairs that hold at least a 2^-19 share of all links, hence at most 2^19 pairs, are looked up
in the tasks, the links of all others are joined with the counts.

Defined results: a null or empty text, or one whose joined token bytes differ from a blank and the
text (as with U+2581), has no tokens: zeros and an empty groups column. Rows are neither
matched nor merged: repeated rows count as often as they occur, and null or repeated keys give a
row each. Ties for the highest count are all best. Further columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm import bytelevel, sentencepieces
from tidemill.llm.common import materialize, slices
from tidemill.llm.units import flat, led, strings

DONE = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
OPEN = "chunk long, cut boolean, groups binary, pre_a binary, pre_b binary, suf_a binary, suf_b binary"
FRAGMENT = f"_row long, doc_id long, n_a long, n_b long, n_groups long, links binary, {OPEN}"
RANGES = f"{DONE}, chunk long, a binary, b binary"


@dataclass(frozen=True)
class AlignSettings:
    a: str = ""  # byte-level tokenizer file, given a blank and the text
    b: str = ""  # sentencepiece model file, which adds the blank itself
    chunk_bytes: int = 1 << 15
    fan: int = 8  # neighbouring fragments joined at once
    frequent: int = 1 << 19  # pairs above this share of all links are looked up, at most as many
    batch_bytes: int = 2 << 20
    remembered: int = 150_000  # words whose ids a worker keeps, for each tokenizer
    flush: int = 1 << 20  # distinct pairs that a counting task holds


@dataclass(frozen=True)
class Aligned:
    """Links and groups of two streams of ids whose token ends are bytes of one buffer."""

    link_a: np.ndarray
    link_b: np.ndarray
    ends: np.ndarray  # byte at which each link's segment ends
    cut: np.ndarray  # whether it ends a group

    @staticmethod
    def of(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Aligned:
        first = min(a_ends[0], b_ends[0]) if len(a) and len(b) else 0
        in_a, in_b = (np.zeros(int(a_ends[-1]) - int(first) + 1 if len(a) else 0, bool) for _ in range(2))
        in_a[a_ends - first], in_b[b_ends - first] = True, True
        at = np.flatnonzero(in_a | in_b)
        in_a, in_b = in_a[at], in_b[at]
        return Aligned(a[np.cumsum(in_a) - in_a], b[np.cumsum(in_b) - in_b], at + first, in_a & in_b)


@lru_cache(maxsize=1)
def _numbers(most: int) -> pa.Array:
    """Ids as text before a comma, a bar and a semicolon."""
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(most)])


def group_texts(a: np.ndarray, a_last: np.ndarray, b: np.ndarray, b_last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;` of all groups, and the byte at which each group begins and the last ends; `_last` marks a group's last token."""
    group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    n = int(a_last.sum())
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    code = np.zeros(len(a) + len(b), np.int64)
    before_b, upto_a = np.cumsum(count_b) - count_b, np.cumsum(count_a)
    code[np.arange(len(a)) + before_b[group_a]] = a + most * a_last
    code[np.arange(len(b)) + upto_a[group_b]] = b + 2 * most * b_last
    data, bounds = flat(_numbers(most).take(pa.array(code)))
    return data, bounds[np.append(0, np.cumsum(count_a + count_b))]


@dataclass
class Fragment:
    """A range of bytes: open prefix, closed groups, open suffix. Tokens are rows (id, end)."""

    cut: bool
    pre_a: np.ndarray
    pre_b: np.ndarray
    groups: bytes
    n_groups: int
    links: bytes
    suf_a: np.ndarray
    suf_b: np.ndarray

    @staticmethod
    def of(a: np.ndarray, b: np.ndarray, most: int) -> Fragment:
        """Of tokens that end in a range; the first ones may begin before it."""
        common = np.intersect1d(a[:, 1], b[:, 1], assume_unique=True)
        none = np.zeros((0, 2), np.int64)
        if not len(common):
            return Fragment(False, a, b, b"", 0, b"", none, none)
        (a0, a1), (b0, b1) = (np.searchsorted(x[:, 1], common[[0, -1]], side="right") for x in (a, b))
        groups, n, links = closed(a[a0:a1], b[b0:b1], most)
        return Fragment(True, a[:a0], b[:b0], groups, n, links, a[a1:], b[b1:])

    def __add__(self, other: Fragment) -> Fragment:
        most = MOST_IDS
        if not self.cut:
            joined = (np.concatenate(x) for x in ((self.pre_a, other.pre_a), (self.pre_b, other.pre_b)))
            return Fragment(other.cut, *joined, other.groups, other.n_groups, other.links, other.suf_a, other.suf_b)
        a, b = (np.concatenate(x) for x in ((self.suf_a, other.pre_a), (self.suf_b, other.pre_b)))
        if not other.cut:
            return Fragment(True, self.pre_a, self.pre_b, self.groups, self.n_groups, self.links, a, b)
        groups, n, links = closed(a, b, most)
        return Fragment(
            True, self.pre_a, self.pre_b, self.groups + groups + other.groups, self.n_groups + n + other.n_groups,
            self.links + links + other.links, other.suf_a, other.suf_b,
        )


MOST_IDS = 1 << 16  # ids of both vocabularies are below it


def closed(a: np.ndarray, b: np.ndarray, most: int) -> tuple[bytes, int, bytes]:
    """Text, number and links of the groups that tokens between two cuts form."""
    if not len(a):
        return b"", 0, b""
    found = Aligned.of(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    ends = found.ends[found.cut]
    text, _ = group_texts(a[:, 0], np.isin(a[:, 1], ends), b[:, 0], np.isin(b[:, 1], ends), most)
    return text.tobytes(), len(ends), np.column_stack((found.link_a, found.link_b)).astype("<u2").tobytes()


def _rows(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", "<i8").reshape(-1, 2)


def _check(s: AlignSettings) -> None:
    sizes = len(bytelevel.byte_level(s.a, False).bytes), len(sentencepieces.pieces(s.b).names)
    if max(sizes) > MOST_IDS:
        raise ValueError(f"vocabularies of at most {MOST_IDS} ids are supported")


def _aligned_batch(batch: pa.RecordBatch, s: AlignSettings) -> pa.RecordBatch:
    """Short documents finished, long ones as ranges of tokens."""
    n = batch.num_rows
    lined = led(batch.column("text"))
    a, n_a = bytelevel.encode_texts(lined, s.a, False, s.remembered)
    b, n_b = sentencepieces.encode_texts(batch.column("text"), s.b, s.remembered)
    a, b = a.astype(np.int64), b.astype(np.int64)
    a_bytes, b_bytes = bytelevel.byte_level(s.a, False).bytes.take(pa.array(a)), sentencepieces.pieces(s.b).bytes.take(pa.array(b))
    same = _same_bytes(lined, (a_bytes, n_a), (b_bytes, n_b))
    keep_a, keep_b = np.repeat(same, n_a), np.repeat(same, n_b)
    a, b, n_a, n_b = a[keep_a], b[keep_b], n_a * same, n_b * same
    size = np.diff(flat(lined)[1]) * same
    a_ends, b_ends = (np.cumsum(np.diff(flat(x)[1])[k]) for x, k in ((a_bytes, keep_a), (b_bytes, keep_b)))
    ends = np.cumsum(size)
    long = size > s.chunk_bytes
    rows, ids = batch.column("_row"), batch.column("doc_id")

    # finished: everything of short documents at once
    short_a, short_b = np.repeat(~long, n_a), np.repeat(~long, n_b)
    sa, sb, sa_ends, sb_ends = a[short_a], b[short_b], a_ends[short_a], b_ends[short_b]
    found = Aligned.of(sa, sa_ends, sb, sb_ends)
    cuts = found.ends[found.cut]
    at = np.cumsum(np.append(0, size))
    n_groups = np.diff(np.searchsorted(cuts, at, side="right"))
    link_bounds = np.searchsorted(found.ends, at, side="right")
    text, group_bounds = group_texts(sa, np.isin(sa_ends, cuts, assume_unique=True), sb, np.isin(sb_ends, cuts, assume_unique=True), MOST_IDS)
    text, text_bounds = text.tobytes(), group_bounds[np.append(0, np.cumsum(n_groups))]
    links = np.column_stack((found.link_a, found.link_b)).astype("<u2").tobytes()
    out: dict[str, list] = {name: [] for name in (x.split()[0] for x in RANGES.split(", "))}

    def add(**values) -> None:
        for name, column in out.items():
            column.append(values.get(name))

    for i, (row, doc_id) in enumerate(zip(rows.to_pylist(), ids.to_pylist())):
        if not long[i]:
            digest = hashlib.sha256(text[text_bounds[i] : text_bounds[i + 1] - 1]).hexdigest() if size[i] else ""
            add(
                _row=row, doc_id=doc_id, n_a=int(n_a[i]), n_b=int(n_b[i]), n_groups=int(n_groups[i]),
                n_links=int(link_bounds[i + 1] - link_bounds[i]), groups_sha256=digest,
                links=links[4 * link_bounds[i] : 4 * link_bounds[i + 1]],
            )
            continue
        tokens = []
        for kind, kind_ends in ((a, a_ends), (b, b_ends)):
            begin, end = np.searchsorted(kind_ends, (at[i], ends[i]), side="right")
            tokens.append(np.column_stack((kind[begin:end], kind_ends[begin:end] - at[i])))
        marks = [np.searchsorted(x[:, 1], np.arange(0, size[i] + s.chunk_bytes, s.chunk_bytes), side="right") for x in tokens]
        for chunk in range(len(marks[0]) - 1):
            parts = [x[m[chunk] : m[chunk + 1]] for x, m in zip(tokens, marks)]
            add(
                _row=row, doc_id=doc_id, n_a=len(parts[0]), n_b=len(parts[1]), chunk=chunk,
                a=parts[0].astype("<i8").tobytes(), b=parts[1].astype("<i8").tobytes(),
            )
    return pa.RecordBatch.from_pydict(out, schema=RANGES_ARROW)


def _same_bytes(lined: pa.Array, *streams: tuple[pa.Array, np.ndarray]) -> np.ndarray:
    """Which texts are the joined bytes of each stream of tokens and not empty."""
    data, bounds = flat(lined)
    same = np.diff(bounds) > 0
    for parts, sizes in streams:
        own, own_bounds = flat(parts)
        own_bounds = own_bounds[np.append(0, np.cumsum(sizes))]
        same &= np.diff(own_bounds) == np.diff(bounds)
        if len(own) == len(data) and np.array_equal(own, data):
            continue
        for i in np.flatnonzero(same):
            same[i] = np.array_equal(own[own_bounds[i] : own_bounds[i + 1]], data[bounds[i] : bounds[i + 1]])
    return same


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


RANGES_ARROW, FRAGMENT_ARROW, DONE_ARROW = _arrow(RANGES), _arrow(FRAGMENT), _arrow(DONE)


def _store(fragment: Fragment, row: dict) -> dict:
    f = fragment
    opens = {name: getattr(f, name).astype("<i8").tobytes() for name in ("pre_a", "pre_b", "suf_a", "suf_b")}
    return row | opens | {"cut": f.cut, "groups": f.groups, "n_groups": f.n_groups, "links": f.links}


def _load(row: dict) -> Fragment:
    r = row
    return Fragment(r["cut"], _rows(r["pre_a"]), _rows(r["pre_b"]), r["groups"], r["n_groups"], r["links"], _rows(r["suf_a"]), _rows(r["suf_b"]))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            made = Fragment.of(_rows(row["a"]), _rows(row["b"]), MOST_IDS)
            known = {name: row[name] for name in ("_row", "doc_id", "n_a", "n_b", "chunk")}
            yield pa.RecordBatch.from_pylist([_store(made, known)], schema=FRAGMENT_ARROW)


def _join_neighbours(fan: int):
    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        made = _load(rows[0])
        for row in rows[1:]:
            made = made + _load(row)
        known = {"_row": rows[0]["_row"], "doc_id": rows[0]["doc_id"], "chunk": rows[0]["chunk"] // fan}
        known |= {name: sum(r[name] for r in rows) for name in ("n_a", "n_b")}
        return pa.Table.from_pylist([_store(made, known)], schema=FRAGMENT_ARROW)

    return join


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a whole document's fragment says: it begins at a cut and has to end at one."""
    for batch in batches:
        for row in batch.to_pylist():
            f = _load(row)
            groups, n, links = closed(f.pre_a, f.pre_b, MOST_IDS)
            groups, links = groups + f.groups, links + f.links
            known = {name: row[name] for name in ("_row", "doc_id", "n_a", "n_b")}
            known |= {"n_groups": n + f.n_groups, "n_links": len(links) // 4, "links": links}
            yield pa.RecordBatch.from_pylist([known | {"groups_sha256": hashlib.sha256(groups[:-1]).hexdigest()}], schema=DONE_ARROW)


def align(docs: DataFrame, key: str, text: str, settings: AlignSettings) -> DataFrame:
    """A row of counts, the groups' digest and the links (pairs of 16-bit ids) for every document; written."""
    s = settings
    _check(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", s.batch_bytes):
            yield _aligned_batch(batch, s)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(rows.mapInArrow(run, RANGES), "aligned")
    done = rows.filter("chunk is null").select(DONE_ARROW.names)
    ranges = rows.filter("chunk is not null")
    chunks = ranges.agg(F.max("chunk")).first()[0]
    if chunks is None:
        return done
    # ranges go to any tasks; neighbours meet again level by level
    parts = materialize(ranges.repartition("_row", "chunk").mapInArrow(_fragments, FRAGMENT), "fragments")
    while chunks > 0:
        groups = parts.groupBy("_row", F.floor(F.col("chunk") / s.fan).alias("_over"))
        parts, chunks = materialize(groups.applyInArrow(_join_neighbours(s.fan), FRAGMENT), "fragments"), chunks // s.fan
    return done.unionByName(parts.mapInArrow(_finish, DONE))


def link_counts(aligned: DataFrame, settings: AlignSettings) -> DataFrame:
    """(pair, n, best): corpus-wide links of each pair of ids, and whether no other A id has more with this B id; written."""
    s = settings

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        waiting, held = [], 0

        def fold():
            nonlocal pairs, n, waiting, held
            new, times = np.unique(np.concatenate(waiting), return_counts=True)
            pairs, at = np.unique(np.concatenate((pairs, new)), return_inverse=True)
            n = np.bincount(at, np.concatenate((n, times)), len(pairs)).astype(np.int64)
            waiting, held = [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            waiting.append(flat(batch.column("links").fill_null(b""))[0].view("<u4").copy())
            held += len(waiting[-1])
            if held >= 4 * s.flush:
                fold()
                if len(pairs) >= s.flush:
                    yield rows()
                    pairs, n = pairs[:0], n[:0]
        if held:
            fold()
        yield rows()

    counted = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(W.partitionBy(F.shiftright("pair", 16)))  # of one B id: at most a row for each A id
    return materialize(counted.select("pair", "n", (F.col("n") == most).alias("best")), "link-counts")


def score(aligned: DataFrame, counts: DataFrame, settings: AlignSettings) -> DataFrame:
    """The counts and best links of every document."""
    s, spark = settings, aligned.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * s.frequent >= total
    listed = counts.filter(often).orderBy("pair").toArrow()  # at most `frequent` rows
    tables = [listed.column(c).to_numpy() for c in ("pair", "n", "best")]
    shared = spark.sparkContext.broadcast(tables)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in slices(batches, "links", s.batch_bytes):
            data, bounds = flat(batch.column("links").fill_null(b""))
            links, bounds = data.view("<u4").astype(np.int64), bounds // 4
            at = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
            hit = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)
            sums = []
            for values in (n, best):
                known = np.where(hit, values[at], 0) if len(pairs) else np.zeros(len(links), np.int64)
                sums.append(pa.array(np.diff(np.append(0, np.cumsum(known))[bounds])))
            rest = np.append(0, np.cumsum(~hit))[bounds].astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(rest), pa.array(links[~hit]))
            kept = [batch.column(c) for c in KEPT]
            yield pa.RecordBatch.from_arrays([*kept, *sums, rare], names=[*KEPT, "count_sum", "n_best", "rare"])

    KEPT = [c for c in DONE_ARROW.names if c != "links"]
    kept_schema = ", ".join(x for x in DONE.split(", ") if not x.startswith("links"))
    scored = aligned.mapInArrow(look_up, f"{kept_schema}, count_sum long, n_best long, rare array<long>")
    scored = materialize(scored, "alignment-scores")
    shared.destroy()
    rare = scored.select("_row", F.explode("rare").alias("pair")).join(counts.filter(~often), "pair")
    rare = rare.groupBy("_row").agg(F.sum("n").alias("_sum"), F.sum(F.col("best").cast("long")).alias("_best"))
    joined = scored.drop("rare").join(rare, "_row", "left")
    added = [(F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c) for c, x in (("n_best", "_best"), ("count_sum", "_sum"))]
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *added, "groups_sha256")
