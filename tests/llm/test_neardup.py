import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import neardup
from tidemill.llm.common import CLEANUP, materialize
from tidemill.llm.queries import QUERIES


def brute(rows, size, similarity=80):
    sets = {}
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        k = min(size, len(words))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids, where = sorted(sets), {}
    for i in ids:
        for shingle in sets[i]:
            where.setdefault(shingle, []).append(i)
    seen = {tuple(sorted((a, b))) for group in where.values() for a in group for b in group[:50] if a != b}
    for a, b in seen:
        common = len(sets[a] & sets[b])
        if 100 * common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("folder_name", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, folder_name):
    path = f"/root/testdata/{folder_name}"
    rows = QUERIES["op6_near_duplicates"](spark, path).collect()
    truth = brute([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()], 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == truth


def test_chains_groups_and_edges_of_the_threshold(spark):
    rng = random.Random(4)
    rows, words = [], [f"w{i}" for i in range(5000)]

    def fresh(n):
        return [rng.choice(words) for _ in range(n)]

    base = fresh(120)
    for i in range(60):  # a chain: each differs from the one before
        rows.append((1000 - i, " ".join(base)))
        base = base[:]
        base[rng.randrange(120)] = f"new{i}"
    hot = fresh(80)
    for i in range(200):  # a large group of copies of copies
        own = hot[:]
        own[rng.randrange(80)] = f"hot{i}" if i % 2 else own[0]
        rows.append((2000 + i, " ".join(own)))
    passage = fresh(40)
    rows += [(3000 + i, " ".join(fresh(40) + passage + fresh(20))) for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, held in ((4, 24 << 20), (5, 0)):  # sets looked up, sets joined
        got = neardup.near_duplicates(df, "doc_id", "text", neardup.NearSettings(shingle=size, held=held)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(rows, size)


def test_odd_rows(odd, empty):
    got = neardup.near_duplicates(odd, "doc_id", "text").collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"]
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[6]["kept"]
    assert by[8]["n_shingles"] == 1 and by[8]["kept"]
    assert by[None]["kept"]
    assert neardup.near_duplicates(empty, "doc_id", "text").count() == 0


def test_signature_distance_is_guaranteed():
    """Any two signatures within the distance share a key, whichever values differ."""
    s = neardup.NearSettings()
    rng = np.random.default_rng(1)
    distance = s.chunks * (s.errors + 1) - 1
    for _ in range(500):
        other = np.zeros(s.values, bool)
        other[rng.choice(s.values, distance, replace=False)] = True
        assert (other.reshape(s.chunks, s.width).sum(axis=1) <= s.errors).any()


def test_long_signature_keeps_pairs_at_the_threshold():
    """At a similarity of just 0.8 the distances lie about 205 and stay well below the cutoff."""
    s, rng = neardup.NearSettings(), np.random.default_rng(2)
    factors, shifts = neardup._seeds(s.seed + 1, s.fine)
    distances = []
    for size in (40, 180, 900):
        for _ in range(40):
            codes = rng.integers(0, 1 << 63, size + size // 4, dtype=np.uint64)
            apart = size // 8  # size shared, apart on each side: 100 * size = 80 * (size + 2 * apart)
            sets = codes[: size + apart], np.concatenate([codes[:size], codes[size + apart : size + 2 * apart]])
            x, y = (neardup.minima(np.unique(c), factors, shifts) & np.uint64(1) for c in sets)
            distances.append(int((x != y).sum()))
    assert abs(np.mean(distances) - 205) < 6 and max(distances) < s.fine_distance - 20


def test_a_pair_comes_from_one_key_only(spark):
    """Whatever values differ, exactly one shared slot counts as the first."""
    s, rng, rows = neardup.NearSettings(), np.random.default_rng(3), []
    for pair in range(60):
        a = rng.integers(0, 1000, s.values)
        differ = rng.choice(s.values, rng.integers(0, 15), replace=False)
        b = a.copy()
        b[differ] += 1000
        rows.append((pair, a.tolist(), b.tolist()))
    pairs = spark.createDataFrame(rows, "pair long, x array<int>, y array<int>")
    left = neardup.index_keys(pairs.selectExpr("pair AS doc_id", "x AS signature"), s)
    right = neardup.index_keys(pairs.selectExpr("pair AS doc_id", "y AS signature"), s)
    left = left.join(pairs.selectExpr("pair AS doc_id", "x AS signature"), "doc_id").alias("a")
    right = right.join(pairs.selectExpr("pair AS doc_id", "y AS signature"), "doc_id").alias("b")
    met = left.join(right, ["doc_id", "key"]).filter(neardup._first_shared(s)).groupBy("doc_id").count()
    assert {r["doc_id"]: r["count"] for r in met.collect()} == {i: 1 for i in range(60)}


def test_repeated_id_links_the_groups_of_its_texts(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    rows = [(1, "a"), (5, "a"), (5, "b"), (7, "b"), (7, "c"), (8, "c"), (2, "d"), (3, "e"), (3, "e"), (None, "d")]
    df = spark.createDataFrame([(i, texts[k]) for i, k in rows], "doc_id long, text string")
    got = neardup.near_duplicates(df, "doc_id", "text").collect()
    found = sorted({(r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got})
    assert found == [(0, 2, False), (1, 1, True), (2, 2, True), (3, 3, True), (5, 1, False), (7, 1, False), (8, 1, False)]


def test_written_intermediates_leave_no_shuffle_files(spark):
    before = spark.conf.get(CLEANUP)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(1 for name in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name)
    held = shuffled()
    rows = materialize(spark.range(1000).repartition(7).groupBy("id").count(), "cleanup")
    assert shuffled() <= held
    assert rows.count() == 1000 and spark.conf.get(CLEANUP) == before


def test_sets_of_a_batch_are_those_of_its_texts():
    texts = ["A b\x0bc\td e", None, "", " \n", "a b", "\u00c9 \u00e9t\u00e9 B c " + "x" * 300 + " y", "a B C D e", "a b a b a b a b", "w"]
    codes, bounds = neardup.shingle_sets(pa.array([*texts, "after"]).slice(0, len(texts)), 4)
    truth = brute(list(enumerate(texts)), 4)
    assert np.diff(bounds).tolist() == [truth[i][0] for i in range(len(texts))]
    for i, text in enumerate(texts):  # whatever stands beside it
        alone, ends = neardup.shingle_sets(pa.array([text], pa.string()), 4)
        own = codes[bounds[i] : bounds[i + 1]]
        assert ends[-1] == len(own) and own.tolist() == alone.tolist() == sorted(set(alone.tolist()))
    assert codes[bounds[0] : bounds[1]].tolist() == codes[bounds[6] : bounds[7]].tolist()


def test_keys_are_dealt_once(spark):
    rows = [(i, [i % 5 * j % 7 for j in range(30)]) for i in range(40)] + [(None, [1] * 30)]
    unique = spark.createDataFrame(rows, "doc_id long, signature array<smallint>")
    keyed = neardup._shared_keys(unique, neardup.NearSettings())
    dealt = keyed.groupBy("key").count().collect()
    assert len(dealt) == 75 * 5 and {r["count"] for r in dealt} == {8}
    keyed.collect()
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("block", [7, 8192])
def test_last_round_finds_the_pairs_that_the_signatures_hold_for_similar(spark, block):
    s, rng = neardup.NearSettings(block=block), np.random.default_rng(6)
    base = rng.integers(-(1 << 63), 1 << 63, 35, dtype=np.int64)  # 192 bits, then 2048
    values = rng.integers(0, 30000, s.values)
    rows, pairs = [], set()
    for i in range(90):
        own, sign = base.copy(), values.copy()
        for bit in rng.choice(2240, int(rng.integers(0, 330)), replace=False):
            own.view(np.uint64)[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        sign[rng.choice(s.values, int(rng.integers(0, 12)), replace=False)] = rng.integers(30000, 32000)
        rows.append((i, 100 + int(rng.integers(0, 40)), i // 2, own[:3].tolist(), sign.tolist(), own[3:].tolist()))

    def bits(x, y):
        return sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y))

    for x in rows:
        for y in rows:
            if x[2] < y[2] and 100 * min(x[1], y[1]) >= 80 * max(x[1], y[1]):
                if bits(x[3], y[3]) <= s.sketch_distance and bits(x[5], y[5]) <= s.fine_distance:
                    same = np.reshape([p == q for p, q in zip(x[4], y[4])], (s.chunks, s.width)).sum(axis=1)
                    if (same >= s.width - s.errors).any():
                        pairs.add((x[0], y[0]))
    df = spark.createDataFrame(rows, "doc_id long, n long, component long, k array<long>, signature array<smallint>, fine array<long>")
    df = df.select("*", *(F.col("k")[i].alias(c) for i, c in enumerate(neardup.SKETCHES))).drop("k")
    keyed = neardup.index_keys(df, s).join(df, "doc_id")
    cells = neardup._cells(keyed, s)
    assert cells.count() == keyed.count() if block > 90 else cells.count() > keyed.count()
    dealt = cells.repartition(3, *neardup.CELL).sortWithinPartitions(*neardup.CELL)
    got = [(r["a"], r["b"]) for r in dealt.mapInArrow(neardup._compared(s), "cell long, a long, b long").collect()]
    assert sorted(got) == sorted(pairs) and 100 < len(pairs) < 4000


def test_a_set_is_sent_once_to_where_its_pairs_are_confirmed(spark):
    pairs = spark.createDataFrame([(7, a, b) for a in range(40) for b in range(a)], "cell long, a long, b long")
    sets = spark.createDataFrame([(i, 80, bytes(80)) for i in range(40)], "doc_id long, size long, codes binary")
    for met, places in ((1 << 20, 1), (1000, 10)):
        s = neardup.NearSettings(met=met)
        rows = neardup._met(pairs, sets, neardup._large_cells(pairs, sets, s), s).collect()
        at = {}
        for r in rows:
            at.setdefault((r["low"], r["high"]), []).append(r)
        assert len(at) <= places and (places == 1 or len(at) > 1)
        for own in at.values():
            sent = [r["a"] for r in own if r["b"] is None]
            assert len(sent) == len(set(sent)) and set(sent) == {x for r in own if r["b"] is not None for x in (r["a"], r["b"])}
        assert sum(r["b"] is not None for r in rows) == 40 * 39 // 2


def test_small_blocks_and_parts_give_the_same_groups(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    hot, rows = [rng.choice(words) for _ in range(200)], []
    for i in range(120):  # near copies about the threshold, many linked with none
        own = hot[:]
        for _ in range(rng.randrange(3, 16)):
            own[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    settings = neardup.NearSettings(shingle=4, block=9, met=4000, held=0)
    got = neardup.near_duplicates(df, "doc_id", "text", settings).collect()
    truth = brute(rows, 4)
    assert 1 < len({c for _, c, _ in truth.values()}) < 120
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == truth
