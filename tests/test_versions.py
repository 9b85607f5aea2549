from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemill.functions import vectors
from tidemill.sources import atomic, collections
from tidemill.sources.versions import Conflict, NotFound, Repository


def test_an_entry_is_created_once(spark, folder):
    with ThreadPoolExecutor(8) as pool:
        wrote = list(pool.map(lambda i: atomic.append_entry(spark, folder, {"by": i}, 3), range(8)))
    assert sum(wrote) == 1
    (entry,) = atomic.read_entries(spark, folder, atomic.numbers(spark, folder))
    assert entry == {"by": wrote.index(True), "seq": 3}


def test_two_writers_take_two_numbers(spark, folder):
    def commit(i):
        return Repository(spark, folder).write(spark.range(i, i + 3), "rows", by=i)

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(commit, range(4)))
    log = Repository(spark, folder).log("rows").collect()
    assert [r["seq"] for r in log] == [0, 1, 2, 3]
    assert {r["commit_id"] for r in log} == {d["commit_id"] for d in done}
    assert [r["parent"] for r in log] == [None, *[r["commit_id"] for r in log[:-1]]]


def test_expected_parent(spark, folder):
    store = Repository(spark, folder)
    first = store.write(spark.range(1), "rows")
    second = store.write(spark.range(2), "rows", expected=first["commit_id"])
    with pytest.raises(Conflict):
        store.write(spark.range(3), "rows", expected=first["commit_id"])
    assert store.head("rows")["commit_id"] == second["commit_id"]


def test_branches_and_merge(spark, folder):
    store = Repository(spark, folder)
    store.write(spark.range(1), "rows")
    store.branch("rows", "trial")
    with pytest.raises(Conflict):
        store.branch("rows", "trial")
    late = store.write(spark.range(5), "rows", branch="trial")
    assert (store.read("rows").count(), store.read("rows", "trial").count()) == (1, 5)
    assert store.read("rows", late["commit_id"]).count() == 5
    assert store.merge("rows", "trial")["committed"] and store.read("rows").count() == 5
    assert not store.merge("rows", "trial")["committed"]
    store.write(spark.range(7), "rows")
    store.write(spark.range(8), "rows", branch="trial")
    with pytest.raises(Conflict):
        store.merge("rows", "trial")
    assert store.branches("rows") == ["main", "trial"]
    with pytest.raises(NotFound):
        store.read("rows", "nowhere")
    with pytest.raises(ValueError):
        store.branch("rows", "a/b")


def objects(spark, rows):
    df = spark.createDataFrame(rows, "reference string, title string")
    return df.withColumn("embedding", vectors.hash_embedding("title", 8))


def titles(spark, path, upto=None):
    return sorted(((r["reference"], r["title"]) for r in collections.read_collection(spark, path, upto).collect()), key=str)


def test_changes_are_folded_on_read(spark, folder):
    path = f"{folder}/c"
    collections.load_collection(objects(spark, [(f"r{i}", "old") for i in range(6)]), path)
    before = sorted(f for f in atomic.list_files(spark, path) if f.startswith("part"))
    info = collections.load_collection(objects(spark, [("r1", "new"), ("r9", "new")]), path, mode="replace")
    assert info["object_count"] == 7
    assert sorted(f for f in atomic.list_files(spark, path) if f.startswith("part")) == before  # not rewritten
    gone = spark.createDataFrame([("r2",), ("r2",), ("none",)], "reference string")
    assert collections.delete_objects(gone, path) == 2
    want = [("r0", "old"), ("r1", "new"), ("r3", "old"), ("r4", "old"), ("r5", "old"), ("r9", "new")]
    assert titles(spark, path) == want
    assert len(titles(spark, path, upto=1)) == 7
    assert collections.load_collection(objects(spark, [("r2", "back"), ("r1", "no")]), path)["object_count"] == 7
    collections.load_collection(objects(spark, [("r3", "twin")]), path, mode="append")
    collections.load_collection(objects(spark, [("r0", "newer")]), path, mode="replace")
    want = sorted([("r0", "newer"), ("r1", "new"), ("r2", "back"), ("r3", "old"), ("r3", "twin"), ("r4", "old"), ("r5", "old"), ("r9", "new")])
    assert titles(spark, path) == want
    collections.compact_collection(spark, path)
    assert titles(spark, path) == want
    assert collections.drop_folded(spark, path) == 5
    collections.load_collection(objects(spark, [("r4", "after")]), path, mode="replace")
    assert ("r4", "after") in titles(spark, path) and len(titles(spark, path)) == 8
    assert collections.load_collection(objects(spark, [("x", "y")]), path, mode="overwrite")["object_count"] == 1


def test_two_writers_change_a_collection(spark, folder):
    path = f"{folder}/c"
    collections.load_collection(objects(spark, [("a", "0"), ("b", "0")]), path)

    def put(i):
        collections.load_collection(objects(spark, [("a", str(i)), (f"n{i}", "x")]), path, mode="replace", dim=8)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(put, range(1, 4)))
    found = collections.read_collection(spark, path)
    assert found.count() == 5 and found.filter(F.col("reference") == "a").count() == 1


def test_null_keys_are_keys(spark, folder):
    path = f"{folder}/c"
    collections.load_collection(objects(spark, [(None, "old"), ("a", "old")]), path)
    collections.load_collection(objects(spark, [(None, "new")]), path, mode="replace")
    assert sorted(titles(spark, path), key=str) == sorted([(None, "new"), ("a", "old")], key=str)


def test_second_write_is_not_bound_to_a_number_of_tasks(spark, monkeypatch):
    from catalog import storage

    plans, write = [], Repository.write

    def seen(self, df, *rest, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, *rest, **more)

    monkeypatch.setattr(Repository, "write", seen)
    assert storage.s5_versioned(spark, "/root/testdata/sf0.001").count() == 2
    assert "REPARTITION_BY_COL" in plans[1] and not any("REPARTITION_BY_NUM" in plan for plan in plans)
