"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

Texts are tokenized once; the ids of all documents are counted to one global table, from
which package-merge derives code lengths of at most `limit` bits and the canonical code. A
file is a header with the lengths followed by blocks. A block holds whole documents: their
ids and sizes, the bit offset of every `interval`-th token, and the code words. Blocks need
nothing but the file's header, and within a block the segments between two checkpoints are
decoded side by side with one table look-up a token.

Defined results: a null text is an empty one and has only the end id; repeated rows and
repeated doc ids each keep their own ids, in a row of their own, ordered by a digest of the
ids among equal doc ids; a null doc id sorts first. An empty table writes no file and reads
back as no rows. A single document may be of any size that memory holds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.bytelevel import encode_texts
from tidemill.llm.common import materialize, release, shuffles_removed, slices
from tidemill.llm.units import strings

MAGIC = b"TIDETOK1"
BLOCK = b"BLCK"
SEPARATOR = "ENDB"  # ends the header and every block
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class TokenSettings:
    tokenizer: str = ""  # path of the tokenizer file
    end_id: int = 0
    limit: int = 18  # longest code word in bits; more if the ids in use need it
    interval: int = 128  # tokens between two checkpoints
    block_tokens: int = 1 << 20
    batch_bytes: int = 4 << 20
    remembered: int = 800_000  # units whose ids a worker keeps


def tokenize(docs: DataFrame, key: str, text: str, settings: TokenSettings) -> DataFrame:
    """doc_id, n_tokens and the ids (end id included) of every row; the counts of a batch's ids stand in its first row."""
    s = settings

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", s.batch_bytes):
            ids, counts = encode_texts(batch.column("text"), s.tokenizer, True, s.remembered)
            ends = np.cumsum(counts)
            ids, counts = np.insert(ids, ends, s.end_id), counts + 1
            bounds = np.append(0, np.cumsum(counts))
            raw = _packed(ids, bounds)
            seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
            used = np.flatnonzero(seen)
            tally = [np.column_stack((used, seen[used])).astype("<i8").tobytes()] + [None] * (batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), raw, pa.array(tally[: batch.num_rows], pa.binary())], names=["doc_id", "n_tokens", "ids", "tally"]
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids binary, tally binary")


def _packed(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Two bytes an id; texts with larger ids have four and an odd byte before them."""
    large = ids >= 1 << 16
    if not large.any():
        return strings(ids.astype("<u2").view(np.uint8), 2 * bounds, pa.binary())
    pairs = zip(bounds[:-1].tolist(), bounds[1:].tolist())
    return pa.array([b"L" + ids[a:b].astype("<u4").tobytes() if large[a:b].any() else ids[a:b].astype("<u2").tobytes() for a, b in pairs], pa.binary())


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2")


def count_ids(tokens: DataFrame) -> list[tuple[int, int]]:
    """(id, occurrences) over all rows; as many rows as the vocabulary has ids. Reads the tallies only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column("tally"):
                pairs = np.frombuffer(value.as_py(), "<i8").reshape(-1, 2)
                if len(pairs):
                    total = np.pad(total, (0, max(0, int(pairs[-1, 0]) + 1 - len(total))))
                    total[pairs[:, 0]] += pairs[:, 1]
        index = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total[index])], names=["id", "n"])

    tallies = tokens.filter("tally is not null").select("tally")
    totals = tallies.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return sorted((r["id"], r["n"]) for r in totals.collect())


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal prefix-code lengths of at most `limit` bits for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((leaves, pairs))
        rank = np.argsort(merged, kind="stable")
        level = merged[rank]
        is_leaf.append(rank < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass(frozen=True)
class Code:
    """Ids in use, their code lengths, and the canonical code that follows from both."""

    ids: np.ndarray
    lengths: np.ndarray

    @property
    def width(self) -> int:
        return int(self.lengths.max()) if len(self.lengths) else 1

    def words(self) -> np.ndarray:
        order = np.lexsort((self.ids, self.lengths))
        spans = np.uint64(1) << (self.width - self.lengths[order]).astype(np.uint64)
        starts = np.cumsum(spans) - spans
        out = np.empty(len(order), np.uint64)
        out[order] = starts >> (self.width - self.lengths[order]).astype(np.uint64)
        return out

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each `width` bits that may come next: the id, and how many bits it takes."""
        order = np.lexsort((self.ids, self.lengths))
        spans = 1 << (self.width - self.lengths[order])
        ids, bits = np.zeros(1 << self.width, np.uint32), np.zeros(1 << self.width, np.uint8)
        used = int(spans.sum())
        ids[:used] = np.repeat(self.ids[order].astype(np.uint32), spans)
        bits[:used] = np.repeat(self.lengths[order].astype(np.uint8), spans)
        return ids, bits

    def header(self) -> bytes:
        return MAGIC + struct.pack("<I", len(self.ids)) + self.ids.astype("<u4").tobytes() + self.lengths.astype("u1").tobytes()


def make_code(counts: list[tuple[int, int]], limit: int) -> Code:
    ids = np.array([i for i, _ in counts], np.int64)
    return Code(ids, code_lengths(np.array([n for _, n in counts], np.float64), limit))


def encode_block(doc_ids: list[int], counts: np.ndarray, tokens: np.ndarray, code: Code, words: np.ndarray, lookup: np.ndarray, interval: int) -> bytes:
    """One block: header, documents, checkpoints, code words."""
    at = lookup[tokens]
    lengths, values = code.lengths[at], words[at]
    ends = np.cumsum(lengths)
    starts = (ends - lengths).astype(np.uint64)
    total = int(ends[-1]) if len(ends) else 0
    packed = np.zeros(total // 32 + 3, np.uint64)
    if total:
        # a code word lies in one or two 32-bit cells; fields do not overlap, so sums join them
        cell, shift = (starts >> np.uint64(5)).astype(np.int64), starts & np.uint64(31)
        placed = values << (np.uint64(64) - shift - lengths.astype(np.uint64))
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        packed[cell[first]] += np.add.reduceat(placed >> np.uint64(32), first)
        packed[cell[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
    body = packed.astype(">u4").tobytes()[: (total + 7) // 8]
    marks = starts[::interval].astype("<u8").tobytes()
    docs = np.array(doc_ids, "<i8").tobytes() + np.asarray(counts, "<u8").tobytes()
    head = struct.pack("<IQIQ", len(doc_ids), len(tokens), interval, len(body))
    check = zlib.crc32(docs + marks + body)
    return BLOCK + head + struct.pack("<I", check) + docs + marks + body


def decode_block(data: memoryview, at: int, table: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc ids, counts and tokens of the block at `at`, and where it ends."""
    if bytes(data[at : at + 4]) != BLOCK:
        raise ValueError(f"no block at byte {at}")
    n_docs, n_tokens, interval, n_body = struct.unpack_from("<IQIQ", data, at + 4)
    (check,) = struct.unpack_from("<I", data, at + 28)
    at += 32
    n_marks = -(-n_tokens // interval) if n_tokens else 0
    end = at + 16 * n_docs + 8 * n_marks + n_body
    if end > len(data) or zlib.crc32(data[at:end]) != check:
        raise ValueError(f"the block before byte {end} is damaged")
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    counts = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    marks = np.frombuffer(data, "<u8", n_marks, at + 16 * n_docs).astype(np.int64)
    body = np.frombuffer(data, "u1", n_body, at + 16 * n_docs + 8 * n_marks)
    if counts.sum() != n_tokens:
        raise ValueError("the documents' sizes differ from the block's")
    # 32 bits from every byte on, so that a look-up is one gather
    wide = np.concatenate((body, np.zeros(8, np.uint8))).astype(np.uint32)
    window = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    ids, bits = table
    tokens = np.zeros((interval, max(n_marks, 1)), np.uint32)
    bit, live = marks.copy(), n_marks
    last = n_tokens - (n_marks - 1) * interval
    for k in range(interval if n_marks else 0):
        if k == last:
            live = n_marks - 1
            bit = bit[:live]
        if not live:
            break
        cell = bit >> 3
        if width > 25:
            nearby = (window[cell].astype(np.uint64) << np.uint64(8)) | wide[cell + 4].astype(np.uint64)
            peek = (nearby >> (40 - width - (bit & 7)).astype(np.uint64)) & np.uint64((1 << width) - 1)
        else:
            peek = (window[cell] >> (32 - width - (bit & 7)).astype(np.uint32)) & np.uint32((1 << width) - 1)
        tokens[k, :live] = ids[peek]
        bit = bit + bits[peek]
    return doc_ids, counts, tokens.T.reshape(-1)[:n_tokens], end


def write_tokens(docs: DataFrame, key: str, text: str, path: str, settings: TokenSettings) -> None:
    """Tokenize, count, and write all ids below `path` in ascending doc_id order."""
    s, spark = settings, docs.sparkSession
    tokens = materialize(tokenize(docs, key, text, s), "token-ids")
    code = make_code(count_ids(tokens), s.limit)
    shared = spark.sparkContext.broadcast(code)  # two numbers for each id of the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        words, lookup = code.words(), np.zeros(int(code.ids.max(initial=0)) + 1, np.int64)
        lookup[code.ids] = np.arange(len(code.ids))
        doc_ids, own, size, started = [], [], 0, False

        def flush():
            tokens = np.concatenate([*own, np.zeros(0, np.uint32)]).astype(np.int64)
            data = encode_block(doc_ids, np.array([len(x) for x in own], np.int64), tokens, code, words, lookup, s.interval)
            return pa.RecordBatch.from_arrays([pa.array([data] if started else [code.header(), data], pa.binary())], names=["part"])

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                own.append(_unpack(value.as_py()))
                size += len(own[-1])
                if size >= s.block_tokens:
                    yield flush()
                    doc_ids, own, size, started = [], [], 0, True
        if doc_ids:
            yield flush()

    ordered = tokens.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"))
    parts = ordered.mapInArrow(blocks, "part binary")
    with shuffles_removed(parts.sparkSession):
        parts.select(F.col("part").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)
    shared.destroy()
    release(tokens)


def file_parts(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, counts, tokens) of each block of one file."""
    view, end = memoryview(data), SEPARATOR.encode()
    if bytes(view[:8]) != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", view, 8)
    code = Code(np.frombuffer(view, "<u4", n, 12).astype(np.int64), np.frombuffer(view, "u1", n, 12 + 4 * n).astype(np.int64))
    at, table = 12 + 5 * n, code.table()
    while True:
        if bytes(view[at : at + len(end)]) != end:
            raise ValueError(f"no end mark at byte {at}")
        at += len(end)
        if at == len(view):
            return
        doc_ids, counts, tokens, at = decode_block(view, at, table, code.width)
        yield doc_ids, counts, tokens


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                before, row = 0, 0
                for doc_ids, counts, tokens in file_parts(content.as_py()):
                    ends, raw = np.cumsum(counts), tokens.astype("<u4")
                    pairs = list(zip((ends - counts).tolist(), ends.tolist()))
                    columns = [
                        pa.array([name] * len(counts)), pa.array(np.arange(row, row + len(counts))),
                        pa.array([None if d == NULL_ID else d for d in doc_ids.tolist()], pa.int64()),
                        pa.array(before + ends - counts), pa.array(counts),
                        pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in pairs], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([tokens[a:b].tolist() for a, b in pairs], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=[*NAMES, *["ids"] * with_ids])
                    before, row = before + int(counts.sum()), row + len(counts)

    NAMES = ["file", "row", "doc_id", "within", "n_tokens", "ids_crc32"]
    schema = "file string, row long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    rows = materialize(files.load(path).select("path", "content").mapInArrow(decode, schema), "token-rows")
    # one row per file: names of one job's parts sort as their ranges do
    starts = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = starts.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("before"))
    joined = rows.join(starts, "file")
    return joined.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
