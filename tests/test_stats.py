import pytest
from pyspark.sql import functions as F

from tidemill.operators import product, stats

STATUS = (
    "reference string, _llm_status string, _llm_error string, _llm_attempts bigint, "
    "error_type string"
)


@pytest.fixture
def results(spark):
    rows = [
        ("A", "success", "", 1, None),
        ("B", "failed", "ValidationError: bad", 1, "ValidationError"),
        ("C", "failed", "Request Timeout", 3, "LLMTimeoutError"),
        ("D", "failed", "HTTP 429", 1, "LLMRateLimitError"),
        ("E", "failed", "HTTP 503", 5, "ServiceUnavailable"),
        ("F", "failed", None, 2, None),
    ]
    return spark.createDataFrame(rows, STATUS)


def empty(spark):
    return spark.createDataFrame([], STATUS)


def test_product_stats(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (0, 1)], "tariff_mention int, is_gov int")
    assert tuple(stats.product_stats(df).first()) == (3, 1, 2)
    assert tuple(stats.product_stats(df.limit(0)).first()) == (0, 0, 0)


@pytest.mark.parametrize(
    "good, total, text", [(95, 100, "95.0%"), (987, 1000, "98.7%"), (0, 0, "N/A"), (1, 16, "6.2%")]
)
def test_success_rate(spark, good, total, text):
    df = spark.range(total).selectExpr(f"IF(id < {good}, 'success', 'failed') AS _llm_status")
    row = stats.success_summary(df).first()
    assert row["success_rate"] == text
    assert (row["total_processed"], row["successful"]) == (total, good)


def test_breakdown(spark, results):
    assert tuple(stats.failure_breakdown(results).first()) == (1, 1, 1, 1, 1)
    assert tuple(stats.failure_breakdown(results, "error_type").first()) == (1, 1, 1, 0, 2)
    assert tuple(stats.failure_breakdown(empty(spark)).first()) == (0, 0, 0, 0, 0)


def test_mean_attempts(spark, results):
    df = spark.createDataFrame([(n,) for n in (1, 1, 3, 1, 5)], "_llm_attempts bigint")
    assert stats.mean_attempts(df).first()[0] == 2.2
    assert stats.mean_attempts(df.limit(0)).first()[0] == 1.0
    assert stats.mean_attempts(df.selectExpr("0L AS _llm_attempts")).first()[0] == 1.0


def test_failed_references(spark, results):
    assert stats.failed_reference_list(results).first()[0] == ["B", "C", "D", "E", "F"]
    assert stats.failed_reference_list(results, limit=2).first()[0] == ["B", "C"]


def test_counts_and_lengths(spark, results):
    by_status = [tuple(r) for r in stats.sorted_value_counts(results, "_llm_status").collect()]
    assert by_status == [("failed", 5), ("success", 1)]
    df = spark.createDataFrame([("ab",), ("abcd",), (None,)], "summary string")
    assert tuple(stats.length_stats(df).first()) == (3.0, 2, 4)
    assert tuple(stats.length_stats(df.limit(0)).first()) == (0.0, 0, 0)
    assert tuple(stats.coverage(df, "summary").first()) == (2, 3)


def test_guard(spark, results):
    assert stats.require_success(results, "Labels") is results
    stats.require_success(empty(spark), "Labels")
    with pytest.raises(RuntimeError, match="all 5 rows. First error: ValidationError: bad"):
        stats.require_success(results.filter("_llm_status = 'failed'"), "Labels")


def test_progress(spark, results):
    assert tuple(stats.progress(results).first()) == (6, 1, 5, 0, 5)
    assert tuple(stats.progress(results, mock_mode=True).first()) == (6, 1, 5, 1, 4)
    sample = [tuple(r) for r in stats.error_sample(results, mock_mode=True).collect()]
    assert sample[-1] == ("F", "Unknown error") and len(sample) == 4


def test_recent_errors(spark, results):
    twice = results.unionAll(results)
    lines = [r[0] for r in stats.recent_errors(twice, limit=3).collect()]
    assert lines == ["F: Unknown error", "E: HTTP 503", "D: HTTP 429"]
    long = results.filter("reference = 'B'").withColumn("_llm_error", F.lit("x" * 300))
    assert stats.recent_errors(long, chars=100).first()[0] == "B: " + "x" * 100


QUALITY = "reference string, _llm_status_class string, _llm_status_summary string"


def test_input_quality(spark):
    rows = [("a", "success", "success"), ("b", "failed", "success"), ("c", "failed", "failed")]
    df = spark.createDataFrame(rows, QUALITY)
    row = stats.input_quality(df).first()
    assert (row["failed_classification"], row["failed_summary"], row["failed_any"]) == (2, 1, 2)
    assert row["high_failure_rate"] and row["has_status_columns"]
    half = stats.input_quality(df.drop("_llm_status_class")).first()
    assert (half["failed_classification"], half["failed_any"]) == (0, 1)
    none = stats.input_quality(df.select("reference")).first()
    assert not none["has_status_columns"] and none["failed_any"] == 0
    assert stats.input_quality(df.limit(0)).first()["failure_rate"] == 0.0
    ten = spark.range(10).selectExpr("IF(id = 0, 'failed', 'success') AS _llm_status_class")
    assert not stats.input_quality(ten).first()["high_failure_rate"]


def test_customer_summary(spark):
    rows = [
        ("North", "High Value", 9000.0, "Likes tea"),
        ("North", "Medium Value", 5000.0, "Likes sea"),
        ("South", "Medium Value", 4500.0, "Not enriched (sample limit)"),
        ("East", "Low Value", 1000.0, "Likes me"),
    ]
    df = spark.createDataFrame(rows, "region string, tier string, spend double, ai_profile string")
    assert tuple(stats.customer_summary(df).first()) == (4, 4875.0, 3)
    counts = {(r["column"], r["value"]): r["count"] for r in stats.distributions(df, ["region", "tier"]).collect()}
    assert counts[("region", "North")] == 2 and counts[("tier", "Medium Value")] == 2


def test_product_join(spark, documents, labels):
    summaries = documents.selectExpr("reference", "concat('sum of ', title) AS summary").join(
        labels.select("reference", "_llm_status", "_llm_error", "_llm_attempts", "_llm_fallback_used"),
        "reference",
    )
    plain = product.assemble_product(documents, labels, summaries, "2024-05-01T00:00:00")
    again = product.assemble_product(
        documents.withColumn("summary", F.lit("old")), labels, summaries, "2024-05-01T00:00:00"
    )
    assert plain.columns == again.columns and plain.columns.count("summary") == 1
    row = again.filter("reference = 'BIS_2024_002'").first()
    assert (row["monetary_stance"], row["trade_stance"], row["economic_outlook"]) == (4, 2, 4)
    assert row["summary"] == "sum of Outlook" and "T" in row["processed_at"]
    assert row["_llm_fallback_class"] is False and row["_llm_attempts_summary"] == 2


def test_label_types(spark, documents, labels):
    types = dict(product.join_labels(documents, labels).dtypes)
    assert types["monetary_stance"] == "tinyint" and types["_llm_attempts"] == "bigint"
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        product.join_labels(documents, labels.withColumn("trade_stance", F.lit(300))).collect()


def test_duplicates_are_reported(spark, documents):
    product.require_unique(documents)
    with pytest.raises(ValueError, match="'ECB_2024_001' x2"):
        product.require_unique(documents.unionAll(documents.filter("reference LIKE 'ECB%'")))


def test_vectors_are_aligned_by_key(spark, documents):
    vectors = spark.createDataFrame([("BIS_2024_002", [1.0, 2.0])], "reference string, embedding array<double>")
    fallback = F.array(F.lit(0.0), F.lit(9.0))
    rows = {r["reference"]: r["embedding"] for r in product.align_vectors(documents, vectors, fallback).collect()}
    assert rows["BIS_2024_002"] == [1.0, 2.0] and rows["BIS_2024_001"] == [0.0, 9.0]
