import numpy as np
import pytest

from tidemill.operators import compress, search
from tidemill.sources import files

SETTINGS = compress.CodeSettings(parts=3, words=16, rounds=5)


@pytest.fixture
def vectors(spark):
    draws = np.random.default_rng(3).normal(size=(300, 8))
    rows = [(f"k{i}", row.tolist()) for i, row in enumerate(draws)]
    return spark.createDataFrame(rows, "reference string, embedding array<float>")


def test_codes_are_the_nearest_words(spark, vectors, folder):
    row = compress.write_compressed(vectors, f"{folder}/c", settings=SETTINGS).first()
    assert (row["num_records"], row["dimensions"], row["code_bytes"], row["without_code"]) == (300, 8, 3, 0)
    raw = {r["reference"]: np.array(r["embedding"]) for r in files.read_product(spark, f"{folder}/c/vectors").collect()}
    assert len(raw) == 300
    words = spark.read.parquet(f"{folder}/c/words").collect()
    assert len(words) == 3 * 16
    decoded = {r["reference"]: np.array(r["embedding"]) for r in compress.read_compressed(spark, f"{folder}/c").collect()}
    errors = []
    for key, vector in raw.items():
        padded = np.append(vector, 0.0)
        best = [min(((padded[p * 3 : p * 3 + 3] - np.array(w["centre"])) ** 2).sum() for w in words if w["part"] == p) for p in range(3)]
        errors.append(sum(best))
        assert ((vector - decoded[key]) ** 2).sum() <= errors[-1] + 1e-4
    assert row["distortion"] == pytest.approx(np.mean(errors) / np.mean([(v**2).sum() for v in raw.values()]), rel=1e-4)


def test_search_ranks_by_exact_distance(spark, vectors, folder):
    compress.write_compressed(vectors, f"{folder}/c", settings=SETTINGS)
    asked = vectors.limit(20).withColumnRenamed("reference", "query_id")
    exact = search.top_k(vectors, asked, 5, "reference").select("query_id", "reference", "distance", "rank")
    whole = compress.search_compressed(spark, f"{folder}/c", asked, 5, 60)
    near = lambda df: {(r["query_id"], r["rank"]): (r["reference"], round(r["distance"], 6)) for r in df.collect()}
    assert near(whole) == near(exact)
    some = compress.search_compressed(spark, f"{folder}/c", asked, 5, 6)
    assert len(set(near(some).items()) & set(near(exact).items())) >= 80


def test_edges(spark, folder):
    schema = "reference string, embedding array<double>, code string, error int"
    rows = [("a", [1.0, 0.0], "x", 1), ("b", None, "x", 1), ("c", [float("nan"), 1.0], "x", 1), (None, [1.0, 0.0], "x", 1), ("z", [0.0, 0.0], "x", 1)]
    row = compress.write_compressed(spark.createDataFrame(rows, schema), f"{folder}/odd").first()
    assert (row["num_records"], row["without_code"], row["distortion"]) == (5, 2, 0.0)
    decoded = {r["reference"]: r["embedding"] for r in compress.read_compressed(spark, f"{folder}/odd").collect()}
    assert decoded == {"a": [1.0, 0.0], "b": None, "c": None, None: [1.0, 0.0], "z": [0.0, 0.0]}
    none = spark.createDataFrame([], schema)
    assert compress.write_compressed(none, f"{folder}/none").first()["num_records"] == 0
    assert compress.read_compressed(spark, f"{folder}/none").count() == 0
    with pytest.raises(ValueError):
        compress.write_compressed(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "reference string, embedding array<double>"), f"{folder}/bad")
