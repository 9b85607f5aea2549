from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import resume, scoring, stats
from tidemill.streaming.arrivals import process_arrivals
from tidemill.streaming.attempts import first_arrivals, settle_attempts

START = datetime(2024, 1, 1)
SCHEMA = "id string, ts timestamp, n long, outcome string, error_type string, error_message string, duration_ms long"


def tried(key, second, n, outcome):
    bad = outcome != "valid"
    return (key, START + timedelta(seconds=second), n, outcome, "Kind" if bad else None, f"no {n}" if bad else None, 10 * n if n else None)


LOG = [
    tried("valid", 0, 1, "retry"), tried("valid", 5, 2, "valid"), tried("valid", 6, 3, "fatal"),
    tried("fatal", 1, 1, "retry"), tried("fatal", 1, 0, "fatal"),
    *[tried("worn", i, i, "retry" if i < 5 else "valid") for i in range(7)],
    *[tried("spent", i, i, "retry") for i in range(7)],
    tried("left", 3, 1, "retry"), tried("left", 4, 2, "retry"),
]


def run(spark, folder, batches, **options):
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    settle = lambda rows: settle_attempts(rows, "id", "ts", "n", **options)
    return process_arrivals(spark, f"{folder}/in", schema, settle, f"{folder}/out", f"{folder}/state", 1)


def beat(second):
    return [(None, START + timedelta(seconds=second), None, None, None, None, None)]


@pytest.mark.parametrize("order", [1, -1])
def test_same_rows_as_the_table(spark, folder, order):
    batches = [LOG[i::3][::order] for i in range(3)][::order]
    got = run(spark, folder, [*batches, beat(1000)])
    want = scoring.resolve_attempts(spark.createDataFrame(LOG, SCHEMA), "id", ["ts", "n"])
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())


def test_a_record_waits_for_its_backoff(spark, folder):
    """Two tries wait four seconds; the watermark follows the beats."""
    first = run(spark, folder, [[tried("a", 0, 1, "retry"), tried("a", 1, 2, "retry")], beat(4)], late="0 seconds")
    assert first.count() == 0
    later = run(spark, folder, [beat(6)], late="0 seconds")
    assert [(r["id"], r["status"], r["attempts"]) for r in later.collect()] == [("a", "failed", 2)]
    # a try of a settled record starts nothing
    again = run(spark, folder, [[tried("a", 7, 3, "valid")], beat(500)], late="0 seconds")
    assert again.count() == 1


def test_first_arrivals(spark, folder):
    schema = "id int, at timestamp, text string"
    rows = [(i, START + timedelta(seconds=i % 5), "t") for i in (1, 2, 2, 3, 4)]
    for batch in (rows, rows[:2], [(9, START, "new"), *rows]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    done = spark.createDataFrame([(3,), (3,)], "id int")
    once = lambda df: first_arrivals(df, "id", "at", "1 hour", done)
    kind = spark.read.parquet(f"{folder}/in").schema
    got = process_arrivals(spark, f"{folder}/in", kind, once, f"{folder}/out", f"{folder}/state", 1)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 4, 9]


def test_stored_progress_counts_each_file_once(spark, folder, labels):
    store, ledger = f"{folder}/results", f"{folder}/ledger"
    look = lambda: resume.stored_progress(spark, store, ledger).first().asDict()
    results = labels.withColumn("error_type", F.lit("LLMTimeoutError")).withColumn("file", F.lit("x"))
    assert look()["processed"] == 0
    resume.append_results(results, store)
    assert look() == stats.progress(results).first().asDict()
    before = spark.read.parquet(ledger).count()
    assert look()["processed"] == 3 and spark.read.parquet(ledger).count() == before
    resume.append_results(results, store)
    assert look() == stats.progress(results.union(results)).first().asDict()
    # counted twice by two looks at once
    spark.read.parquet(ledger).limit(1).write.mode("append").parquet(ledger)
    assert look()["processed"] == 6


def test_arriving_files_grow_in_number_not_in_size(spark, folder):
    from catalog.storage import _arriving

    rows = spark.range(1000)
    assert _arriving(rows, f"{folder}/few", 4, 20_000) == 4 and _arriving(rows, f"{folder}/many", 4, 50) == 20
    for name, files in (("few", 4), ("many", 20)):
        stored = spark.read.parquet(f"{folder}/{name}")
        assert len(stored.inputFiles()) == files and stored.count() == 1000
