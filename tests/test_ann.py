import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.operators import ann, search


@pytest.fixture(scope="module")
def clouds(spark):
    """Clusters, a hot vector that is a third of all, nulls, zeros, a NaN, clashing names."""
    random = np.random.default_rng(1)
    centres = random.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * random.normal(size=16)).tolist()) for i in range(600)]
    rows += [(i, centres[0].tolist()) for i in range(600, 900)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumn("cell", F.lit("x")).withColumn("angle", F.lit(1)).repartition(5)


@pytest.fixture(scope="module")
def asked(clouds):
    picked = clouds.filter("vec_id % 30 = 0 OR vec_id >= 899")
    return picked.select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def index(spark, clouds, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    return path, ann.build_index(clouds, path, settings=ann.IndexSettings(cells=20))


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 9)) for r in df.collect())


def test_counts(clouds, index):
    counts = index[1]
    assert (counts["rows"], counts["indexed"], counts["no_direction"], counts["cells"]) == (903, 900, 3, 20)
    assert counts["largest_cell"] >= 300
    assert tuple(ann.without_direction(clouds).first()) == (903, 1, 1, 1)


def test_exact_equals_brute_force(spark, clouds, asked, index):
    good = clouds.filter("vec_id < 900").select("vec_id", "embedding")
    want = rows_of(search.top_k(good, asked.filter("query_id < 900"), 10))
    assert rows_of(ann.search_index(spark, index[0], asked, 10, probes=1, exact=True)) == want
    assert rows_of(ann.search_index(spark, index[0], asked, 10, probes=20)) == want
    blocks = ann.search_index(spark, index[0], asked, 10, probes=2, exact=True, query_bytes=4 * 16 * 8)
    assert rows_of(blocks) == want


def test_recall_and_pruning(spark, clouds, asked, index):
    good = clouds.filter("vec_id < 900").select("vec_id", "embedding")
    exact = search.top_k(good, asked.filter("query_id < 900"), 10)
    found = ann.search_index(spark, index[0], asked, 10)
    assert ann.recall(found, exact).first()["recall"] >= 0.95
    plan = spark.read.parquet(f"{index[0]}/vectors").filter(F.col("cell").isin([3]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_and_all_without_direction(spark, clouds, asked, tmp_path):
    nothing = clouds.limit(0)
    assert ann.build_index(nothing, f"{tmp_path}/a")["rows"] == 0
    lost = clouds.filter("vec_id >= 900")
    assert ann.build_index(lost, f"{tmp_path}/b")["no_direction"] == 3
    for name in "ab":
        assert ann.search_index(spark, f"{tmp_path}/{name}", asked, 3).count() == 0
        assert ann.search_index(spark, f"{tmp_path}/{name}", asked, 3, exact=True).count() == 0


def test_other_sizes_are_refused(spark, clouds, tmp_path):
    mixed = clouds.select("vec_id", "embedding").union(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="sizes 1 to 16"):
        ann.build_index(mixed, str(tmp_path))


def test_products_with_centres_and_queries_stay_bounded(spark, folder, monkeypatch):
    """However many cells and queries there are, no product holds more than CELLS numbers, and results stay."""
    assert [b.num_rows for b in ann._pieces([pa.table({"x": list(range(10))}).to_batches()[0]], ann.CELLS // 4)] == [4, 4, 2]
    rows = [(i, [float(np.sin(i * j + j)) for j in range(1, 9)]) for i in range(400)]
    stored = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = stored.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    ann.build_index(stored, folder, settings=ann.IndexSettings(cells=20))
    want = sorted(map(tuple, search.top_k(stored, asked, 5).select("query_id", "vec_id", "rank").collect()))
    monkeypatch.setattr(ann, "CELLS", 64)  # the driver's steps; a task's own come with the module
    found = ann.search_index(spark, folder, asked, 5, probes=2, exact=True)
    assert sorted(map(tuple, found.select("query_id", "vec_id", "rank").collect())) == want
    parts = ann._by_cell(np.array([0, 0, 1, 2]), np.array([5, 3, 5, 3]))
    assert {c: q.tolist() for c, q in parts.items()} == {3: [0, 2], 5: [0, 1]} and ann._by_cell(np.array([], int), np.array([], int)) == {}
