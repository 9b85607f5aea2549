import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.config import MEDIUM_RUN, SMALL_RUN, TRIAL_RUN, Layout, RunOptions, collection_name
from tidemill.functions import vectors
from tidemill.operators import clean
from tidemill.session import path_exists
from tidemill.sources import collections, files, samples
from tidemill.sources.versions import NotFound, Repository
from tidemill.streaming.arrivals import process_arrivals


def test_paths_and_names():
    layout = Layout("base")
    assert layout.product("x") == "base/x.parquet"
    assert layout.product("x", TRIAL_RUN) == "base/trial/x.parquet"
    assert layout.twin("speeches", TRIAL_RUN) == "base/synthetic/trial/speeches.parquet"
    assert layout.snapshot("s", TRIAL_RUN) == "base/trial/intermediate/s.parquet"
    assert collection_name("speeches", prefix="dev_") == "Devspeeches"
    assert collection_name("documents", TRIAL_RUN) == "DocumentsTrial"
    assert layout.collection("documents") != layout.collection("documents", TRIAL_RUN)
    sizes = [options.sample_size for options in (RunOptions(), TRIAL_RUN, SMALL_RUN, MEDIUM_RUN)]
    assert sizes == [0, 10, 100, 1000]


def test_csv_folder(spark, folder):
    text = 'reference,text,n\n"a","line one\nline ""two"", end",1\nb,plain,2\n'
    spark.createDataFrame([(text.rstrip("\n"),)], "v string").coalesce(1).write.text(f"{folder}/b.csv")
    spark.createDataFrame([("reference,text,n\nc,more,3",)], "v string").coalesce(1).write.text(f"{folder}/c.csv")
    rows = files.read_csv_folder(spark, folder).orderBy("n").collect()
    assert rows[0]["text"] == 'line one\nline "two", end' and rows[1]["n"] == 2
    typed = files.read_csv_folder(spark, folder, "reference string, text string, n bigint")
    assert dict(typed.dtypes)["n"] == "bigint" and typed.count() == 3
    with pytest.raises(ValueError, match="No CSV files"):
        files.read_csv_folder(spark, f"{folder}/b.csv")


def test_round_trip_keeps_types(spark, folder):
    df = spark.createDataFrame(
        [(1, 1.5, "a", True, [1, 2]), (2, None, None, False, []), (3, 0.0, "c", None, None)],
        "int_col bigint, float_col double, str_col string, bool_col boolean, list_col array<bigint>",
    )
    files.write_product(df, folder)
    back = files.read_product(spark, folder)
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    files.write_product(df.limit(0), folder)
    empty = files.read_product(spark, folder)
    assert empty.count() == 0 and empty.dtypes == df.dtypes


def test_nothing_to_write_and_nothing_to_read(spark, folder):
    lines = []
    assert files.write_product(None, folder, lines.append) is None and lines
    with pytest.raises(FileNotFoundError):
        files.read_product(spark, folder)


def test_report(spark, folder):
    row = spark.createDataFrame([(3, {"North": 2}, "é")], "n int, spread map<string,int>, t string")
    files.write_report(row, folder, "20240501")
    for stamp in ("latest", "20240501"):
        assert files.read_report(spark, folder, stamp) == {"n": 3, "spread": {"North": 2}, "t": "é"}
    with pytest.raises(ValueError, match="one row"):
        files.write_report(spark.range(2), folder)


def test_versions(spark, folder, documents):
    repository = Repository(spark, folder)
    first = repository.write(documents, "docs", "run-1", num_records=3)
    same = repository.write(documents.repartition(2), "docs", "run-2")
    assert first["committed"] and not same["committed"] and same["commit_id"] == first["commit_id"]
    second = repository.write(documents.limit(2), "docs", "run-3")
    assert [row["seq"] for row in repository.log("docs").collect()] == [0, 1]
    assert repository.read("docs").count() == 2
    assert repository.read("docs", first["commit_id"]).count() == 3
    assert repository.head("docs")["metadata"]["run_id"] == "run-3"
    assert (second["num_rows"], second["num_columns"]) == (2, 7)
    for product, ref in [("docs", "nope"), ("other", "main")]:
        with pytest.raises(NotFound):
            repository.read(product, ref)


def test_content_hash_sees_duplicates_nulls_and_types(spark, folder):
    repository = Repository(spark, folder)
    tables = [
        [(1, None)],
        [(None, 1)],
        [(1, None), (1, None)],
        [(1, None), (1, None), (1, None)],
        [],
    ]
    for rows in tables:
        df = spark.createDataFrame(rows, "a int, b int")
        assert repository.write(df, "t")["committed"]
    assert repository.write(spark.createDataFrame([], "a int, b bigint"), "t")["committed"]
    maps = spark.createDataFrame([({"k": 1},)], "m map<string,int>")
    assert repository.write(maps, "m")["committed"] and not repository.write(maps, "m")["committed"]


def test_collection_create_load_count_delete(spark, folder, documents, labels):
    notes = {"reference": "source id"}
    path = f"{folder}/c"
    assert collections.ensure_collection(spark, path, collections.DOCUMENT_PROPERTIES, notes)
    assert not collections.ensure_collection(spark, path, {"x": "text"})
    stored = collections.read_collection(spark, path)
    assert stored.schema["reference"].metadata["comment"] == "source id"
    assert collections.count_objects(spark, path) == 0
    joined = documents.join(labels, "reference").withColumn(
        "embedding", vectors.hash_embedding("title", 8)
    )
    objects = clean.document_objects(joined)
    info = collections.load_collection(objects, path)
    assert (info["object_count"], info["vector_dimensions"]) == (3, 8)
    assert collections.load_collection(objects, path)["object_count"] == 3
    assert collections.load_collection(objects, path, mode="append")["object_count"] == 6
    assert collections.load_collection(objects, path, mode="overwrite")["object_count"] == 3
    assert collections.delete_collection(spark, path) and not collections.delete_collection(spark, path)
    assert collections.count_objects(spark, path) == 0


def test_every_object_needs_a_vector(spark, folder, documents):
    with_gap = documents.withColumn(
        "embedding", F.when(F.col("title") != "Trade", F.array(F.lit(1.0)))
    )
    with pytest.raises(ValueError, match="1 missing"):
        collections.load_collection(with_gap, folder)
    vectors_table = documents.limit(2).select("reference", F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(ValueError, match="3 rows but got 2"):
        collections.load_pair(documents, vectors_table, folder)
    assert not path_exists(spark, folder)


def test_property_kinds(spark):
    df = spark.createDataFrame(
        [], "a string, b int, c float, d boolean, e date, f timestamp, g array<int>, h decimal(5,2)"
    )
    assert list(collections.infer_properties(df).values()) == [
        "text",
        "int",
        "number",
        "boolean",
        "date",
        "text",
        "text",
        "text",
    ]
    assert isinstance(collections.collection_schema({"x": "date"})["x"].dataType, T.DateType)


def test_snapshot(spark, folder, documents):
    rows = documents.withColumn("embedding", vectors.hash_embedding("title"))
    row = files.write_snapshot(rows, folder).first()
    assert tuple(row)[:2] == (3, 1024) and row["size_mb"] > 0
    assert spark.read.parquet(folder).columns == ["reference", "embedding"]


def test_sample_customers(spark):
    first = samples.sample_customers(spark).orderBy("id").collect()
    assert len(first) == 100 and first[0]["id"] == "CUST-0000" and first[99]["id"] == "CUST-0099"
    assert first == samples.sample_customers(spark).orderBy("id").collect()
    row = samples.sample_customers(spark, 20000).agg(
        F.min("age"), F.max("age"), F.min("spend"), F.max("spend"), F.avg(F.col("active").cast("int")),
        F.countDistinct("region"), F.countDistinct("category"),
    ).first()
    assert tuple(row[:2]) == (18, 75) and row[2] >= 100.0 and row[3] <= 10000.0
    assert 0.78 < row[4] < 0.82 and tuple(row[5:]) == (5, 3)


def test_arrivals_are_worked_off_once(spark, folder, documents):
    documents.repartition(3).write.parquet(f"{folder}/in")

    def work():
        return process_arrivals(
            spark,
            f"{folder}/in",
            documents.schema,
            lambda df: clean.clean_documents(df).select("reference"),
            f"{folder}/out",
            f"{folder}/state",
            1,
        ).count()

    assert work() == 3
    late = documents.withColumn("reference", F.concat("reference", F.lit("-late")))
    late.write.mode("append").parquet(f"{folder}/in")
    assert work() == 6
    assert work() == 6
