import hashlib
import os
import sys
import zlib
from collections import defaultdict

import pytest

from tidemill.llm import prefixes
from tidemill.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
    own = {c: [(r, x) for _, _, r, x in sorted(t, key=lambda v: (v[0], v[1], digest(v[2], v[3])))] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]) if path in children else 0,
            leaves[path], saved[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def trie(conversations):
    return prefixes.trie(prefixes.rebuild(conversations, "conv_id", "turn", "role", "text"))


def test_query_against_brute_force_and_sql(spark, sf):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = got(QUERIES["op13_conversation_trie"](spark, sf))
    assert out == sorted(brute(rows))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    answer = connection.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op13_conversation_trie']})").fetchall()
    assert sorted(answer) == out


@pytest.fixture(scope="module")
def strange(spark):
    """Nulls, ties, repeats, gaps, a missing base, negative ids, long agreeing and long lone conversations."""
    rows = [(None, 0, "user", "nobody"), (7, None, None, None), (7, 0, "user", ""), (7, 0, "user", ""), (7, 3, "a", "b"), (7, 3, "b", "a")]
    rows += [(100 + k, t, "user", f"same {t}") for k in (0, 1, 2, 3, 50, 51) for t in range(7 if k else 3)]
    rows += [(c, t, "user", f"same {t}") for c in (200, 201, 202, 203) for t in range(60 + c % 2)]
    rows += [(204, t, "user", f"lone {t}") for t in range(45)] + [(205, t, "user", f"same {t}" if t < 20 else f"own {t}") for t in range(30)]
    rows += [(c, 0, "user", "x") for c in (-5, -105, -200, 301, 302, 777)]
    rows += [(1000, t, "user", "") for t in range(8)] + [(1100, t, "user", "") for t in range(9)]
    schema = "conv_id long, turn long, role string, text string"
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 AS conv", "'x' AS id", "2 AS pos", "3 AS prev", "4 AS t1", "5 AS level", "6 AS len")


def test_strange_conversations(strange):
    rows = [tuple(r) for r in strange.select("conv_id", "turn", "role", "text").collect()]
    assert got(trie(strange)) == brute(rows)


def test_runs_and_partitions_do_not_matter(strange, monkeypatch):
    monkeypatch.setattr(prefixes, "RUN", 2)
    monkeypatch.setattr(prefixes, "FIRST", 2)
    rows = [tuple(r) for r in strange.select("conv_id", "turn", "role", "text").collect()]
    assert got(trie(strange.repartition(7))) == brute(rows)


def test_one_conversation_over_many_partitions(spark):
    df = spark.range(0, 360).selectExpr("IF(id % 3 = 0, 1, id) AS conv_id", "id AS turn", "'user' AS role", "string(id % 50) AS text")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(trie(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(strange):
    assert trie(strange.limit(0)).count() == 0
