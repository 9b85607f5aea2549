import math
from datetime import date
from unicodedata import ucd_3_2_0

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import clean, index, skew


def values(df, column):
    return [row[column] for row in df.collect()]


def test_fill_nulls_and_minimum_length(spark):
    rows = [
        ("BIS_001", "Speech 1", "Powell", "FED", "A" * 200, True),
        ("BIS_002", None, "Lagarde", "ECB", "B" * 150, True),
        ("BIS_003", "Speech 3", None, "BOE", "C" * 50, False),
        ("BIS_004", "Short", "Bailey", "BOE", "D" * 200, None),
        ("BIS_005", "No text", "Bailey", "BOE", None, None),
    ]
    raw = spark.createDataFrame(
        rows,
        "reference string, title string, speaker string, central_bank string, text string, "
        "is_gov boolean",
    )
    cleaned = {row["reference"]: row for row in clean.clean_documents(raw).collect()}
    assert sorted(cleaned) == ["BIS_001", "BIS_002", "BIS_004"]
    assert cleaned["BIS_002"]["title"] == ""
    assert cleaned["BIS_004"]["is_gov"] is False


def test_length_is_strict_and_counts_code_points(spark):
    df = spark.createDataFrame([("x" * 100,), ("é" * 101,), ("😀" * 101,)], "text string")
    assert df.filter(text.longer_than("text")).count() == 2


def test_fill_keeps_nan_dates_and_arrays(spark):
    df = spark.createDataFrame(
        [(float("nan"), None, None, None, None, None)],
        "a double, b float, c bigint, d date, e array<int>, f string",
    )
    row = clean.fill_nulls(df).first()
    assert math.isnan(row["a"])
    assert (row["b"], row["c"], row["d"], row["e"], row["f"]) == (0.0, 0, None, None, "")
    assert clean.fill_nulls(df).dtypes == df.dtypes


def test_head_sample(spark):
    df = spark.range(50).repartition(5)
    assert values(clean.head_sample(df, ["id"], 3), "id") == [0, 1, 2]
    assert clean.head_sample(df, ["id"], 0).count() == 50


def test_strict_rename_and_required_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.rename_strict(df, {"a": "x"}).columns == ["x", "b"]
    with pytest.raises(ValueError, match="zz"):
        clean.rename_strict(df, {"zz": "x"})
    with pytest.raises(ValueError, match=r"\['c'\]"):
        clean.require_columns(df, ["a", "c"])


def test_aliases_and_defaults(spark):
    df = spark.createDataFrame([("2024", None)], "Date string, institution string")
    named = clean.apply_aliases(df, {"Date": "date", "institution": "central_bank", "x": "y"})
    assert named.columns == ["date", "central_bank"]
    filled = clean.default_columns(named, {"central_bank": "Unknown", "title": "Untitled"})
    assert filled.first()["central_bank"] == "Unknown"


def test_scrub_steps(spark):
    df = spark.createDataFrame(
        [
            ("  \x00Hello\x07 wide world­!\n", "T"),
            ("short", "T"),
            ("", ""),
            (None, None),
            ("　" + "y" * 2000, "T"),
            ("keeps\nlines\tand tabs  x", "T"),
        ],
        "text string, title string",
    )
    assert values(df.select(text.scrub("text", "title").alias("v")), "v") == [
        "Hello  wide world !",
        "Speech: T",
        "Speech: Untitled",
        "Speech: Untitled",
        "y" * 2000,
        "keeps\nlines\tand tabs  x",
    ]
    assert values(df.select(text.scrub("text", "title", 1500).alias("v")), "v")[4] == "y" * 1500


def test_scrub_agrees_with_python_on_many_characters(spark):
    # characters both Unicode tables know: assigned since version 3.2
    known = [chr(c) for c in range(1, 0x3100) if ucd_3_2_0.category(chr(c)) != "Cn"]
    samples = ["begin " + "".join(known[i : i + 97]) + " end" for i in range(0, len(known), 97)]
    df = spark.createDataFrame([(s,) for s in samples], "text string")
    ours = values(df.select(text.scrub("text", F.lit("t")).alias("v")), "v")
    for sample, got in zip(samples, ours):
        want = sample.strip()
        want = "".join(c if c.isprintable() or c in "\n\t" else " " for c in want)
        assert got == want


def test_title_case(spark):
    df = spark.createDataFrame([("north",), ("SOUTH",), ("o'neil-st",), ("new  york",)], "r string")
    got = values(df.select(text.title_case("r").alias("v")), "v")
    assert got == [s.title() for s in ("north", "SOUTH", "o'neil-st", "new  york")]


def test_customers(spark):
    df = spark.createDataFrame(
        [(500.0, "north"), (5000.0, "SOUTH"), (15000.0, "West"), (0.0, "x"), (None, "y")],
        "spend double, region string",
    )
    rows = clean.clean_customers(df).collect()
    assert [r["tier"] for r in rows] == ["Low Value", "Medium Value", "High Value", None, None]
    assert [r["spend"] for r in rows] == [500.0, 5000.0, 9000.0, 0.0, None]


def test_numbers_round_on_their_binary_value(spark):
    numbers = [2.675, 6.25, 12.35, 98.75, 0.05, 95.0, 1234567.125]
    df = spark.createDataFrame([(n,) for n in numbers], "v double")
    assert values(df.select(text.fixed_point("v", 1).alias("t")), "t") == [
        f"{n:.1f}" for n in numbers
    ]
    assert values(df.select(text.round_binary("v", 2).alias("t")), "t") == [
        round(n, 2) for n in numbers
    ]


def test_search_object_defaults(spark, documents, labels):
    joined = documents.join(labels.drop("economic_outlook"), "reference", "left")
    row = clean.document_objects(joined).filter("reference = 'BIS_2024_002'").first()
    assert row["tariff_mention"] is True
    assert row["economic_outlook"] == 3
    assert row["is_governor"] is False
    null_date = documents.select("reference", F.lit(None).cast("date").alias("date"))
    assert clean.document_objects(null_date).first()["date"] == ""


def test_dates_become_text(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 2))], "reference string, date date")
    assert clean.document_objects(df).first()["date"] == "2024-01-02"


@pytest.mark.parametrize("partitions", [1, 2, 8])
def test_dense_index_is_the_rank(spark, partitions):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS k").repartition(partitions)
    rows = index.dense_index(df, ["k"], "i").collect()
    assert all(row["k"] == row["i"] for row in rows) and len(rows) == 1000


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_scattered_index_is_the_digest_rank(spark, digits):
    df = index.with_digest(spark.range(700), "id", 1, "x", "d")
    rows = index.scattered_index(df, "d", hex_digits=digits).collect()
    ordered = sorted(rows, key=lambda r: r["d"])
    assert [r["position"] for r in ordered] == list(range(700))


def test_surrogate_ids_grow_past_six_digits(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "i bigint")
    got = values(df.select(index.synth_id("i").alias("v")), "v")
    assert got == ["SYNTH-000007", "SYNTH-1234567"]


def test_heavy_keys_are_split_and_nothing_is_lost(spark):
    left = spark.range(9000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id)) AS key")
    right = left.filter("id % 2 = 0 AND key <> 'hot'").selectExpr("key", "id AS other")
    right = right.unionAll(spark.createDataFrame([("hot", -1)], "key string, other bigint"))
    heavy = skew.heavy_keys(left, "key", min_rows=100)
    assert list(heavy) == ["hot"]
    joined = skew.left_joins(left, [right], "key", min_rows=100)
    plain = left.join(right, "key", "left")
    assert joined.columns == plain.columns
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    salted = skew.salt_left(left, "key", {"hot": 8}).filter("key = 'hot'")
    assert salted.select("_salt").distinct().count() == 8
    rest = skew.anti_join(left, right, "key", min_rows=100)
    assert rest.count() == left.join(right, "key", "left_anti").count() == 3000


def test_null_keys_stay_in_left_joins(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "key string, v int")
    right = spark.createDataFrame([("a", 9)], "key string, w int")
    rows = {row["v"]: row["w"] for row in skew.left_joins(left, [right], "key").collect()}
    assert rows == {1: None, 2: 9}


def test_heavy_null_keys_are_split(spark):
    left = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, NULL, id) AS key")
    right = left.selectExpr("key", "key + 1 AS other").filter("key IS NULL OR key % 2 = 0")
    heavy = skew.heavy_keys(left, "key", min_rows=100)
    assert list(heavy) == [None] and heavy[None] >= 2
    joined = skew.left_joins(left, [right], "key", min_rows=100)
    plain = left.join(right, "key", "left")
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
    rest = skew.anti_join(left, right, "key", min_rows=100)
    assert rest.count() == left.join(right, "key", "left_anti").count() == 2000


def test_no_rows_no_heavy_keys(spark):
    assert skew.heavy_keys(spark.range(0), "id") == {}
