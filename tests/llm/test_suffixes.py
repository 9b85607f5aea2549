import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import suffixes
from tidemill.llm.queries import QUERIES


def brute(texts, length=200):
    """(bytes, removed, runs, digest) of each text, from a count of all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        marks = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                marks[i] += 1
                marks[i + length] -= 1
        gone = marks.cumsum()[:-1] > 0
        runs = int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("folder_name", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, folder_name):
    path = f"/root/testdata/{folder_name}"
    rows = spark.read.parquet(f"{path}/documents.parquet").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows])))
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op8_repeated_strings"](spark, path).collect()} == want


def test_copies_edges_and_small_ranges(spark):
    rng = random.Random(2)

    def fresh(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    passage, long = fresh(300), fresh(2000)
    texts = [None, "", fresh(199), passage[:200], passage[:199], fresh(150) + passage + fresh(150), passage + fresh(90), fresh(70) + passage]
    texts += ["a" * 1000, "a" * 200, "a" * 199, "xy" * 300, long, long, fresh(30) + long, long[:900] + "#" + long[900:]]
    texts += [long[: rng.randrange(50, 2000)] + fresh(5) + long[rng.randrange(2000) :] for _ in range(40)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    for runs in (37, 50_000):
        s = suffixes.RepeatSettings(run_suffixes=runs, range_suffixes=60)
        got = suffixes.remove_repeats(df, "doc_id", "text", s).collect()
        have = {r["doc_id"]: (r["n_bytes"], sum(x["stop"] - x["start"] for x in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got}
        assert have == dict(enumerate(brute(texts)))


def test_odd_rows(odd, empty):
    got = suffixes.remove_repeats(odd, "doc_id", "text").collect()
    assert sorted(r["n_bytes"] for r in got) == sorted(len((r["text"] or "").encode()) for r in odd.collect())
    assert suffixes.remove_repeats(empty, "doc_id", "text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6) | st.just(b"aaaa"), max_size=12), max_size=7))
def test_merge_sorts_and_knows_prefixes(runs):
    coded = [suffixes.front_code([(x, b"l", 1) for x in sorted(run)]) for run in runs]
    merged = list(suffixes.merge_runs([suffixes.front_decode(c) for c in coded]))
    assert [m[1] for m in merged] == sorted(x for run in runs for x in run)
    for a, b in zip(merged, merged[1:]):
        assert b[0] == suffixes.common_prefix(a[1], b[1], 0)


def test_anchors_do_not_depend_on_the_pieces(monkeypatch):
    data = bytes(random.Random(1).choices(b"abc", k=5000)) + b"z" * 500
    whole = [x.tolist() for x in suffixes.anchors(data, suffixes.RepeatSettings())]
    monkeypatch.setattr(suffixes, "PIECE", 700)
    assert [x.tolist() for x in suffixes.anchors(data, suffixes.RepeatSettings())] == whole
