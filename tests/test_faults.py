"""Cases that once went wrong: reruns, doubled keys, missing vectors, hot keys of equal rows."""

import pytest
from pyspark.sql import functions as F

from tidemill.config import Layout
from tidemill.operators import clean, embed, resume, search, skew
from tidemill.plans.documents import DocumentSteps, label_replies, run_documents, summary_replies
from tidemill.session import list_files
from tidemill.sources import collections

OBJECTS = "reference string, title string, embedding array<float>"


def test_equal_rows_of_a_hot_key_spread(spark):
    keys = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    heavy = skew.heavy_keys(keys, "key", min_rows=100)
    assert set(heavy) == {"hot"}
    salts = skew.salt_left(keys, "key", heavy).filter("key = 'hot'").select(skew.SALT).distinct().count()
    assert salts == heavy["hot"] > 1
    done = spark.createDataFrame([("hot",), ("1",), (None,)], "key string")
    assert skew.anti_join(keys, done, "key", heavy=heavy).count() == 999
    joined = skew.left_joins(keys, [done.withColumn("x", F.lit(1))], "key", heavy={**heavy, None: 3})
    assert joined.count() == 2000 and joined.filter("x = 1").count() == 1001


def test_doubled_keys_and_replacement(spark, folder):
    rows = [("a", "one", [1.0, 0.0]), ("a", "two", [0.0, 1.0]), ("b", "three", [1.0, 1.0])]
    first = collections.load_collection(spark.createDataFrame(rows, OBJECTS), folder)
    assert first["object_count"] == 2
    again = collections.load_collection(spark.createDataFrame(rows[::-1], OBJECTS), folder)
    assert again["object_count"] == 2
    fresh = spark.createDataFrame([("b", "new", [0.5, 0.5]), ("c", "four", [0.0, 0.0])], OBJECTS)
    assert collections.load_collection(fresh, folder, mode="replace")["object_count"] == 3
    titles = {r["reference"]: r["title"] for r in collections.read_collection(spark, folder).collect()}
    assert titles["b"] == "new" and titles["c"] == "four"


@pytest.mark.parametrize("vector", [None, [1.0]])
def test_a_given_size_is_checked(spark, folder, vector):
    objects = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", vector)], OBJECTS)
    with pytest.raises(ValueError, match="size 2"):
        collections.load_collection(objects, folder, dim=2)
    assert collections.count_objects(spark, folder) == 0


def test_a_rerun_goes_on_after_finished_stages(spark, folder):
    raw = spark.createDataFrame(
        [(f"r{i}", "2024-01-01", "ECB", "Lane", f"Title {i}", "text " * 60, False) for i in range(6)],
        "reference string, date string, central_bank string, speaker string, title string, text string, is_gov boolean",
    )
    reply = '{"monetary_stance": "dovish", "trade_stance": "neutral", "tariff_mention": 1, "economic_outlook": "neutral"}'
    scored = {"labels": [], "summaries": []}

    def label(rows):
        scored["labels"].append(rows.count())
        return label_replies(rows.withColumn("reply", F.lit(reply)))

    def summary(rows):
        scored["summaries"].append(rows.count())
        if len(scored["summaries"]) == 1:
            raise RuntimeError("the model is gone")
        return summary_replies(rows.withColumn("reply", F.lit('{"summary": "' + "long enough " * 8 + '"}')))

    steps = DocumentSteps(label, summary, lambda rows: embed.embed_column(rows, embed.hash_embedder(8)))
    with pytest.raises(RuntimeError):
        run_documents(raw, steps, Layout(folder), "2024-05-01T00:00:00Z", run_id="x")
    report = run_documents(raw, steps, Layout(folder), "2024-05-01T00:00:00Z", run_id="x")
    assert report["object_count"] == 6 and sum(scored["labels"]) == 6 and sum(scored["summaries"]) == 12


def test_the_same_row_survives_in_any_order(spark, folder):
    rows = [("a", 1), ("a", 2), ("a", 3), ("b", 4)]
    for order, path in ((rows, f"{folder}/x"), (rows[::-1], f"{folder}/y")):
        spark.createDataFrame(order, "reference string, n int").coalesce(1).write.parquet(path)
    x, y = (sorted(map(tuple, resume.finalize_results(spark, f"{folder}/{n}", "reference").collect())) for n in "xy")
    assert x == y and len(x) == 2
    assert list_files(spark, folder) == ["x", "y"]


def test_sample_reads_keys_first(spark, tmp_path):
    rows = [(i if i % 7 else None, f"text {i}") for i in range(1, 200)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "k int, text string").write.parquet(path)
    df = spark.read.parquet(path)
    for n in (5, 28, 40, 500):  # nulls alone, all nulls, nulls and keys, everything
        got = [r["k"] for r in clean.head_sample(df, ["k", "text"], n).collect()]
        assert got == [r["k"] for r in df.orderBy("k", "text").limit(n).collect()]
    plan = clean.head_sample(df, ["k"], 40)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(k," in plan
    assert clean.head_sample(df.limit(0), ["k"], 3).count() == 0


def test_staged_chunks_have_few_files(spark, tmp_path):
    todo = spark.range(4000).withColumn("x", F.lit("t")).repartition(16)
    stage = str(tmp_path / "stage")
    parts = resume._chunks(todo, "id", 8, stage)
    assert sum(p.count() for p in parts) == 4000
    assert len(list((tmp_path / "stage").glob("*/*.parquet"))) <= 8


def test_objects_found_by_text(spark):
    embedder = embed.hash_embedder(32)
    stored = embed.embed_column(
        spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "reference string, text string"), embedder, "text"
    )
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, query string")
    hits = search.search_objects(stored, asked, embedder, 2).orderBy("query_id", "rank").collect()
    assert [(h["query_id"], h["reference"], h["text"]) for h in hits if h["rank"] == 1] == [(1, "a", "x"), (2, "b", "y")]
    assert len(hits) == 4 and hits[0]["distance"] == 0.0 and "embedding" not in hits[0].asDict()
