import re
from collections import Counter

import numpy as np

from tidemill.llm import quality
from tidemill.llm.queries import QUERIES


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated |= set(range(i, i + 8))
    lines, seen, duplicates = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, duplicates, len(repeated)


def test_base_against_brute_force(spark, sf, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op2_quality_rules"](spark, sf).collect()}
    truth = documents.collect()
    assert len(rows) == len(truth)
    for doc in truth:
        row, want = rows[doc["doc_id"]], brute(doc["text"])
        assert tuple(row[c] for c in quality.COUNTS[:5]) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row["base_failed"] and row["kept"])


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 0), (6, 1), (None, 0), (7, None), (7, 1)], "doc_id long, quality int")
    assert quality.learn(odd, "text", "doc_id", labels, "quality") == []
    counted = quality.text_statistics(odd, "text", [odd["doc_id"]]).collect()
    for row, doc in zip(counted, odd.collect()):
        assert tuple(row[c] for c in quality.COUNTS[:5]) == brute(doc["text"])
    assert quality.learn(empty, "text", "doc_id", labels, "quality") == []
    assert quality.text_statistics(empty, "text", [empty["doc_id"]]).count() == 0


def test_rules_find_planted_thresholds(spark):
    rng = np.random.default_rng(3)
    table = {"x": rng.random(3000), "y": rng.random(3000), "z": rng.random(3000)}
    bad = (table["x"] > 0.8) & (table["y"] < 0.5) | (table["z"] > 0.95)
    rules = quality.learn_rules(table, bad, quality.RuleSettings(thresholds=100))
    fired = np.zeros(3000, bool)
    for rule in rules:
        fired |= quality._rows(rule, table, 3000)
    assert (fired & bad).sum() > 0.9 * bad.sum() and (fired & ~bad).sum() < 0.02 * (~bad).sum()
    # the emitted conditional says the same
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(*table.values())], "x double, y double, z double")
    kept = [r["k"] for r in frame.select(quality.verdict(rules).alias("k")).collect()]
    assert kept == [not f for f in fired.tolist()]
