from collections import Counter
from itertools import combinations
from math import log

import pytest

from tidemill.operators import dependent, privacy, twin

COLUMNS = ["day", "bank", "stance", "gov"]


@pytest.fixture
def rows(spark):
    return spark.range(900).selectExpr(
        "concat('k', id) AS reference",
        "CAST(id % 10 AS INT) AS day",
        "IF(id % 10 < 3, NULL, concat('bank ', id % 10 DIV 2)) AS bank",
        "CAST(id % 7 AS INT) AS stance",
        "id % 7 > 3 AS gov",
        "'x' AS parent",
        "1 AS block",
    )


def entropy(values):
    n = len(values)
    return -sum(c / n * log(c / n) for c in Counter(values).values())


def test_information_and_tree(rows):
    real = rows.collect()
    found = dependent.pair_information(rows, COLUMNS)
    got = {(r["column_a"], r["column_b"]): r["information"] for r in found.collect()}
    assert set(got) == set(combinations(COLUMNS, 2))
    for (a, b), value in got.items():
        column = lambda *names: [tuple(r[n] for n in names) for r in real]
        assert value == pytest.approx(max(0.0, entropy(column(a)) + entropy(column(b)) - entropy(column(a, b))), abs=1e-9)
    tree = dependent.dependency_tree(found, COLUMNS)
    assert tree[0] == ("day", None) and set(tree) >= {("bank", "day"), ("gov", "stance")}


@pytest.mark.parametrize("block", [1, 7, 64])
def test_ranges_tile_the_draws(rows, monkeypatch, block):
    monkeypatch.setattr(dependent, "BLOCK", block)
    monkeypatch.setattr(dependent, "STRIDE", 3)
    ranges = dependent.draw_ranges(rows, "bank", "day").collect()
    owners = Counter()
    for r in ranges:
        for draw in range(max(r["first"], r["block"] * block), min(r["past"], (r["block"] + 1) * block)):
            owners[r["parent"], r["child"], draw] += 1
    assert set(owners.values()) == {1}
    want = Counter(("" if r["bank"] is None else "=" + r["bank"], f"={r['day']}") for r in rows.collect())
    assert Counter((p, c) for p, c, _ in owners) == want
    for parent in {p for p, _ in want}:
        draws = sorted(d for p, _, d in owners if p == parent)
        assert draws == list(range(len(draws)))


def test_twin_keeps_dependencies(rows):
    linked = dependent.dependent_twin(rows, COLUMNS, seed=5).collect()
    assert sorted(r["reference"] for r in linked) == [f"SYNTH-{i:06d}" for i in range(900)]
    real = {(r["day"], r["bank"], r["stance"] > 3) for r in rows.collect()}
    assert {(r["day"], r["bank"], r["gov"]) for r in linked} <= real
    assert all(r["gov"] == (r["stance"] > 3) for r in linked)
    again = dependent.dependent_twin(rows.repartition(3), COLUMNS, seed=5).collect()
    assert sorted(again) == sorted(linked)


def test_pairs_are_nearer_than_in_a_shuffled_twin(rows):
    rows = rows.selectExpr("reference", *(f"CAST({c} AS STRING) AS {c}" for c in COLUMNS))
    shuffled = twin.make_twin(rows, twin.Roles(categorical=COLUMNS), seed=5)
    linked = dependent.dependent_twin(rows, COLUMNS, seed=5)
    far, near = (
        {(r["column_a"], r["column_b"]): r["distance"] for r in dependent.pair_distances(rows, made, COLUMNS).collect()}
        for made in (shuffled, linked)
    )
    for pair in [("day", "bank"), ("stance", "gov")]:
        assert near[pair] < 0.1 < 0.3 < far[pair]


def test_edges(spark, rows):
    none = rows.limit(0)
    assert dependent.dependent_twin(none, COLUMNS).count() == 0
    assert dependent.pair_information(none, COLUMNS).count() == 0
    one = dependent.dependent_twin(rows.select("reference", "day"), ["day"])
    assert one.columns == ["reference", "day", "is_synthetic"] and one.count() == 900
    odd = spark.createDataFrame([(1, "", None), (2, None, "="), (3, "*", "")], "reference int, a string, b string")
    drawn = dependent.dependent_twin(odd, ["a", "b"]).collect()
    assert {(r["a"], r["b"]) for r in drawn} <= {("", None), (None, "="), ("*", "")}


def test_closest_record_against_brute_force(spark, rows):
    names = ["a", "b", "c"]
    schema = "a string, b int, c boolean"
    records = [("x", 1, True), ("x", 2, None), (None, 3, False), ("*", None, None)]
    asked = [("x", 1, True), ("x", 1, True), ("x", 2, True), (None, None, None), ("", 9, True), ("q", 7, None), ("y", 8, False)]
    asked += [("new", 77, None)] * 2
    got = privacy.closest_record(spark.createDataFrame(asked, schema), spark.createDataFrame(records, schema), names).collect()
    want = {row: (n, min(sum(x != y for x, y in zip(row, r)) for r in records)) for row, n in Counter(asked).items()}
    assert {tuple(r[n] for n in names): (r["rows"], r["distance"]) for r in got} == want
    empty = spark.createDataFrame([], schema)
    assert {r["distance"] for r in privacy.closest_record(spark.createDataFrame(asked, schema), empty, names).collect()} == {None}
    assert privacy.closest_record(empty, spark.createDataFrame(records, schema), names).count() == 0
    far = privacy.closest_record(spark.createDataFrame([("n", 0, None)], schema), spark.createDataFrame([("m", 1, True)], schema), names)
    assert far.first()["distance"] == 3
    with pytest.raises(ValueError):
        privacy.closest_record(empty, empty, names * 5)
