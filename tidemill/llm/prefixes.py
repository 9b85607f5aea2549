"""Prefix trie of conversations by SQL ROLLUP over columns of turn ids.

A turn's id is a 128-bit digest of its role and text with the text's length behind it. A block
lays the next turns of every conversation out as columns t1, t2, ..; ROLLUP over them gives all
prefixes of the block in one aggregation, and grouping_id says how long each is. A node's key is
a digest of the key at which its block began and the turn ids since, so conversations that go on
take their own next key along and the next block groups by it first; nothing is looked up.
A conversation that is alone at the end of a block goes on as a chain that needs no grouping, so
blocks are made only as deep as conversations agree. Sums over subtrees come from ROLLUP too, over
the nodes' own values, from the last block up.

Turns are numbered by one range sort of all rows, so that a conversation may hold any share
of them. Conversation ids that end at a node are joined in sorted runs of bounded length and the
runs hashed one after another, never collected.

Defined results: rows with a null conv_id belong to no conversation. Turns order by number (null
first), equal numbers by the digest; repeated rows are turns of their own. Null role or text is
empty. Further columns are not read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import materialize

BORROWED = 6  # conversations begin with fewer turns than this of another one
FIRST, MOST = 8, 32  # columns of the first block and of the widest; widths double between
RUN = 1 << 16  # conversation ids in a run


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of digest and 8 bytes of the text's length in code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text)), 16, "0")))


def _length(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("long")


def numbered_turns(rows: DataFrame) -> DataFrame:
    """conv, pos (from 1) and id of turns given as conv, turn, id; written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            first = np.append(True, conv[1:] != conv[:-1])
            place = np.arange(len(conv))
            at = place - np.maximum.accumulate(np.where(first, place, 0))
            if conv[0] == last:
                at[: np.append(np.flatnonzero(first)[1:], len(conv))[0]] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["conv", "id", "_part", "_at"])

    ordered = rows.repartitionByRange("conv", F.asc_nulls_first("turn"), "id")
    ordered = ordered.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "id").select("conv", "id", F.spark_partition_id().alias("_part"))
    sorted_rows = materialize(ordered.mapInArrow(count, "conv long, id binary, _part int, _at long"), "turns")
    # a conversation goes on in the next partition at most once a partition
    parts = sorted_rows.groupBy("conv", "_part").agg((F.max("_at") + 1).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("_part")) - F.col("n")
    split = parts.select("conv", "_part", before.alias("_before")).filter("_before > 0")
    placed = sorted_rows.join(F.broadcast(split), ["conv", "_part"], "left")
    return placed.select("conv", (F.col("_at") + 1 + F.coalesce("_before", F.lit(0))).alias("pos"), "id")


def rebuild(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, len) and their turns (conv, len, pos, id) with borrowed beginnings; written."""
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("id")
    )
    own = materialize(numbered_turns(rows), "own-turns")
    base = F.col("conv") - F.col("conv") % 100
    heads = own.filter((base == F.col("conv")) & (F.col("pos") < BORROWED)).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "id")))["id"].alias("head"))
    lengths = own.groupBy("conv").agg(F.max("pos").alias("n"))
    borrowed = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    known = lengths.select("conv", "n", base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED).cast("int").alias("h"))
    known = known.join(heads, "base", "left").select("conv", "n", "h", borrowed.alias("borrowed"))
    length = F.size("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    known = materialize(known.select("conv", "h", "borrowed", length.cast("long").alias("len")), "conversations")
    taken = known.select("conv", "len", F.posexplode("borrowed").alias("pos", "id")).select("conv", "len", (F.col("pos") + 1).cast("long").alias("pos"), "id")
    rest = own.join(known.select("conv", "len", "h", F.size("borrowed").alias("m")), "conv").filter("pos > h")
    rest = rest.select("conv", "len", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id")
    return known.select("conv", "len"), materialize(taken.union(rest), "rebuilt-turns")


def _key(prev: str, turns: list[str]) -> Column:
    """Key of the node that turns lead to; absent turns add nothing."""
    parts = [F.coalesce(F.col(t), F.lit(b"")) for t in turns]
    return F.unhex(F.md5(F.concat(F.col(prev), *parts)))


def _rollup(rows: DataFrame, turns: list[str], values: str) -> DataFrame:
    """Groups of all prefixes of the turn columns below each `prev`, with their number of turns as `level`."""
    sql = f"SELECT prev, {', '.join(turns)}, grouping_id() AS _set, {values} FROM {{rows}} GROUP BY prev, ROLLUP({', '.join(turns)})"
    groups = rows.sparkSession.sql(sql, rows=rows)
    k = len(turns)
    level = F.lit(k) - F.length(F.regexp_replace(F.bin(F.col("_set")), "0", ""))  # the last columns are rolled up
    last = F.coalesce(*[F.when(F.col("level") == j, F.col(turns[j - 1])) for j in range(1, k + 1)])
    groups = groups.withColumn("level", level.cast("int")).withColumn("_last", last)
    return groups.filter("level = 0 OR _last IS NOT NULL").drop("_set")


def _nodes(rows: DataFrame, turns: list[str], start: int) -> DataFrame:
    """The block's nodes with key, parent's key and columns; written. Level 0 is the node before."""
    groups = _rollup(rows, turns, "count(*) AS n_convs, min(conv) AS conv_id, max(len) AS longest")
    parent = F.when(F.col("level") == 1, F.col("prev"))
    for j in range(2, len(turns) + 1):
        parent = parent.when(F.col("level") == j, _key("prev", turns[: j - 1]))
    key = F.when(F.col("level") == 0, F.col("prev")).otherwise(_key("prev", turns))
    return materialize(
        groups.select(
            "prev", *turns, "level", key.alias("key"), parent.alias("parent"), (F.col("level") + start).cast("long").alias("depth"),
            "conv_id", "n_convs", "longest", ((F.col("n_convs") - 1) * F.coalesce(_length(F.col("_last")), F.lit(0))).alias("own"),
        ),
        "trie-nodes",
    )


def trie(rebuilt: tuple[DataFrame, DataFrame]) -> DataFrame:
    """A row for every distinct prefix of the rebuilt conversations."""
    known, turns = rebuilt
    blocks, chains, ends = [], [], []
    root = F.unhex(F.md5(F.lit("").cast("binary")))
    rows, start, width = known.select("conv", "len", root.alias("prev")), 0, FIRST
    while True:
        names = [f"t{j}" for j in range(1, width + 1)]
        place = F.col("pos") - start
        laid = turns.filter(place <= width).groupBy("conv").agg(*[F.max(F.when(place == j, F.col("id"))).alias(t) for j, t in enumerate(names, 1)])
        rows = materialize(rows.join(laid, "conv", "left"), "trie-rows")
        nodes = _nodes(rows, names, start)
        blocks.append((nodes if start == 0 else nodes.filter("level > 0"), names))
        end = start + width
        ends.append(rows.filter(F.col("len") <= end).select(F.when(F.col("len") == start, F.col("prev")).otherwise(_key("prev", names)).alias("key"), "conv"))
        ongoing = rows.filter(F.col("len") > end)
        if ongoing.isEmpty():
            break
        alone = nodes.filter((F.col("level") == width) & (F.col("n_convs") == 1) & (F.col("longest") > end)).select(F.col("conv_id").alias("conv"))
        left = turns.filter(F.col("pos") > end)
        chains.append(left.join(alone, "conv", "left_semi"))
        ongoing = materialize(ongoing.select("conv", "len", _key("prev", names).alias("prev")).join(alone, "conv", "left_anti"), "trie-ongoing")
        if ongoing.isEmpty():
            break
        turns = materialize(left.join(alone, "conv", "left_anti"), "trie-turns")
        rows, start, width = ongoing, end, min(2 * width, MOST)
    return _assemble(blocks, chains, _hashed(ends))


def _hashed(ends: list[DataFrame]) -> DataFrame:
    """key and the digest of the ascending, comma-joined conversation ids that end there."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, convs = batch.column("key").to_pylist(), batch.column("conv").to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            cuts = sorted({c for a, b in zip(cuts, cuts[1:]) for c in (*range(a, b, RUN), b)})
            spans = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_pydict(
                {"key": [keys[a] for a, _ in spans], "least": [convs[a] for a, _ in spans], "ids": [",".join(map(str, convs[a:b])) for a, b in spans]},
                schema=pa.schema([("key", pa.binary()), ("least", pa.int64()), ("ids", pa.string())]),
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == last:
                    state.update(b",")
                else:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["key", "sha"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["key", "sha"])

    rows = ends[0]
    for more in ends[1:]:
        rows = rows.union(more)
    ordered = rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    joined = ordered.mapInArrow(runs, "key binary, least long, ids string")
    joined = joined.repartition("key").sortWithinPartitions("key", "least")
    return joined.mapInArrow(digests, "key binary, sha string")


def _assemble(blocks: list[tuple[DataFrame, list[str]]], chains: list[DataFrame], hashed: DataFrame) -> DataFrame:
    """Sums over subtrees from the last block up, then one grouping brings all of a node together."""
    sums, deeper = [], None
    for nodes, names in reversed(blocks):
        leaf = F.when((F.col("longest") == F.col("depth")) | (F.col("n_convs") == 1) & (F.col("level") == len(names)), 1).otherwise(0)
        values = nodes.select("prev", *names, "key", "level", "own", leaf.cast("long").alias("leaf"))
        if deeper is not None:
            carried = deeper.select(F.col("key"), F.col("own").alias("_own"), F.col("leaf").alias("_leaf"))
            values = values.join(carried, "key", "left").select(
                "prev", *names, (F.col("own") + F.coalesce("_own", F.lit(0))).alias("own"), (F.col("leaf") + F.coalesce("_leaf", F.lit(0))).alias("leaf")
            )
        groups = _rollup(values, names, "sum(own) AS own, sum(leaf) AS leaf")
        key = F.when(F.col("level") == 0, F.col("prev")).otherwise(_key("prev", names))
        groups = materialize(groups.select("level", key.alias("key"), "own", "leaf"), "trie-sums")
        sums.append(groups if len(sums) == len(blocks) - 1 else groups.filter("level > 0"))
        deeper = groups.filter("level = 0")
    facts = None
    for nodes, _ in blocks:
        parts = nodes.select("key", "parent", "depth", "conv_id", "n_convs", "longest")
        facts = parts if facts is None else facts.union(parts)
    whole = [
        facts.select("key", F.struct("parent", "depth", "conv_id", "n_convs", "longest").alias("node")),
        facts.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")),
        hashed,
    ]
    total = sums[0].select("key", F.struct("own", "leaf").alias("below"))
    for part in sums[1:]:
        total = total.union(part.select("key", F.struct("own", "leaf").alias("below")))
    together = total
    for part in whole:
        together = together.unionByName(part, allowMissingColumns=True)
    together = together.groupBy("key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("node", "n_children", "sha", "below")])
    together = materialize(together.filter("node IS NOT NULL").select("key", "node.*", "n_children", "sha", "below.*"), "trie-facts")
    above = together.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = F.sha2(F.lit(""), 256)
    # a node alone whose conversation goes on as a chain has one child there
    children = F.coalesce("n_children", F.when(F.col("longest") > F.col("depth"), 1).otherwise(0)).cast("long")
    out = together.join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"), F.col("leaf").alias("n_leaves"),
        F.col("own").alias("saved_tokens"), F.coalesce("sha", none).alias("ends_sha256"),
    )
    for chain in chains:
        last = F.col("pos") == F.col("len")
        out = out.union(
            chain.select(
                "conv", "pos", "conv", F.lit(1).cast("long"), F.when(last, 0).otherwise(1).cast("long"), F.lit(1).cast("long"),
                F.lit(0).cast("long"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(none),
            )
        )
    return out


#: the same nodes with whole paths as keys, for small tables
TRIE_SQL = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), counts AS (SELECT c, count(*) AS n FROM own GROUP BY c
), steps AS (
  SELECT c, n, c - c % 100 AS base, list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, v: CASE WHEN v >= 0 THEN xor(crc, v) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END) AS crc
  FROM counts
), convs AS (SELECT c, base, xor(crc, 4294967295) % 6 AS h FROM steps
), rebuilt AS (
  SELECT v.c, b.p AS d, b.r, b.x FROM convs v JOIN own b ON b.c = v.base WHERE b.p <= v.h
  UNION ALL
  SELECT v.c, o.p - v.h + least(v.h, coalesce(n.n, 0)), o.r, o.x
  FROM convs v JOIN own o ON o.c = v.c LEFT JOIN counts n ON n.c = v.base WHERE o.p > v.h
), members AS (
  SELECT c, d, length(x) AS size, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, [] FROM convs
), lengths AS (SELECT c, max(d) AS len FROM members GROUP BY c
), nodes AS (
  SELECT m.path, m.d, min(m.c) AS conv_id, count(*) AS n, any_value(m.size) AS size, max(l.len) = m.d AS leaf,
    coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE m.d = l.len), '') AS ends
  FROM members m JOIN lengths l ON l.c = m.c GROUP BY m.path, m.d
), below AS (
  SELECT path[1:k] AS path, count(*) FILTER (WHERE leaf) AS leaves, sum((n - 1) * size) AS saved, count(*) FILTER (WHERE d = k + 1) AS children
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM nodes) GROUP BY 1
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, b.children::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""
