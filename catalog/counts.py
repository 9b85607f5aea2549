"""Counts, rates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import LABELS, RAW, SUMMARIES, table
from catalog.joins import PRODUCT, document_product, heavy
from catalog.registry import query, sql_with
from catalog.rows import CLEAN_CUSTOMERS, CUSTOMERS, customers
from tidemill.operators import clean, product, stats


@query(
    "a1_product_stats",
    sql_with(
        PRODUCT,
        "SELECT count(*) AS num_records, count(*) FILTER (WHERE tariff_mention = 1) "
        "AS tariff_mentions, count(*) FILTER (WHERE is_gov) AS governor_speeches FROM product",
    ),
)
def a1_product_stats(spark, sf):
    return stats.product_stats(document_product(spark, sf))


@query("a2_value_counts", "SELECT l_shipdate, count(*) AS count FROM lineitem GROUP BY l_shipdate")
def a2_value_counts(spark, sf):
    return stats.value_counts(table(spark, sf, "lineitem"), "l_shipdate")


@query(
    "a3_sorted_value_counts",
    sql_with(
        LABELS,
        "SELECT monetary_stance, count(*) AS count FROM results GROUP BY 1 ORDER BY 1",
    ),
)
def a3_sorted_value_counts(spark, sf):
    return stats.sorted_value_counts(inputs.label_results(spark, sf), "monetary_stance")


@query(
    "a4_count_by_status",
    sql_with(LABELS, "SELECT _llm_status, count(*) AS count FROM results GROUP BY 1 ORDER BY 1"),
)
def a4_count_by_status(spark, sf):
    return stats.sorted_value_counts(inputs.label_results(spark, sf), "_llm_status")


FLAGSHIP_SQL = sql_with(
    LABELS + [RAW],
    "SELECT count(*) AS total_processed, count(*) FILTER (WHERE _llm_status = 'failed') AS failed, "
    "count(*) FILTER (WHERE _llm_status <> 'failed') AS successful, "
    "CASE WHEN count(*) = 0 THEN 'N/A' ELSE printf('%.1f%%', "
    "100.0 * count(*) FILTER (WHERE _llm_status <> 'failed') / count(*)) END AS success_rate "
    "FROM results JOIN raw USING (reference) WHERE length(text) > 100",
)


@query("a5_success_summary", FLAGSHIP_SQL)
def a5_success_summary(spark, sf):
    """Clean the documents, bring in label results, report how many succeeded."""
    documents = clean.clean_documents(inputs.raw_documents(spark, sf))
    results = inputs.label_results(spark, sf)
    joined = product.join_labels(documents, results, heavy=heavy(spark, sf))
    return stats.success_summary(joined)


_CLASSES = (
    "classes AS (SELECT *, CASE WHEN contains(_llm_error, 'ValidationError') THEN 'ValidationError' "
    "WHEN contains(_llm_error, 'LLMTimeoutError') OR contains(lower(_llm_error), 'timeout') "
    "THEN 'LLMTimeoutError' "
    "WHEN contains(_llm_error, 'LLMRateLimitError') OR regexp_matches(_llm_error, '(^|[^0-9])429([^0-9]|$)') "
    "THEN 'LLMRateLimitError' WHEN contains(_llm_error, 'LLMServerError') "
    "OR regexp_matches(_llm_error, '(^|[^0-9])50[0234]([^0-9]|$)') THEN 'LLMServerError' ELSE 'unexpected_error' END AS kind "
    "FROM results WHERE _llm_status = 'failed')"
)
_KINDS = [
    "ValidationError",
    "LLMTimeoutError",
    "LLMRateLimitError",
    "LLMServerError",
    "unexpected_error",
]


def _pivot(column: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{k}') AS {k}" for k in _KINDS)


@query(
    "a6_failure_breakdown",
    sql_with([*LABELS, _CLASSES], f"SELECT {_pivot('kind')} FROM classes"),
)
def a6_failure_breakdown(spark, sf):
    return stats.failure_breakdown(inputs.label_results(spark, sf))


@query(
    "a6_breakdown_by_type",
    sql_with(
        [
            *LABELS,
            "typed AS (SELECT CASE WHEN error_type IN ("
            + ", ".join(f"'{k}'" for k in _KINDS)
            + ") THEN error_type ELSE 'unexpected_error' END AS kind FROM results "
            "WHERE _llm_status = 'failed')",
        ],
        f"SELECT {_pivot('kind')} FROM typed",
    ),
)
def a6_breakdown_by_type(spark, sf):
    return stats.failure_breakdown(inputs.label_results(spark, sf), "error_type")


@query(
    "a7_mean_attempts",
    sql_with(
        LABELS,
        "SELECT coalesce(nullif(avg(_llm_attempts), 0), 1.0) AS avg_attempts FROM results",
    ),
)
def a7_mean_attempts(spark, sf):
    return stats.mean_attempts(inputs.label_results(spark, sf))


@query(
    "a8_failed_references",
    sql_with(
        LABELS,
        "SELECT reference FROM results WHERE _llm_status = 'failed'",
    ),
)
def a8_failed_references(spark, sf):
    return stats.failed_references(inputs.label_results(spark, sf))


@query(
    "a8_failed_reference_list",
    sql_with(
        LABELS,
        "SELECT array_to_string(list(reference ORDER BY reference), ',') AS failed_references "
        "FROM (SELECT reference FROM results WHERE _llm_status = 'failed' "
        "ORDER BY reference LIMIT 100)",
    ),
)
def a8_failed_reference_list(spark, sf):
    listed = stats.failed_reference_list(inputs.label_results(spark, sf))
    return listed.select(F.array_join("failed_references", ",").alias("failed_references"))


@query(
    "a9_summary_lengths",
    sql_with(
        [RAW, SUMMARIES],
        "SELECT round(coalesce(avg(length(summary)), 0.0), 6) AS avg_len, "
        "CAST(coalesce(min(length(summary)), 0) AS INTEGER) AS min_len, "
        "CAST(coalesce(max(length(summary)), 0) AS INTEGER) AS max_len FROM summaries",
    ),
)
def a9_summary_lengths(spark, sf):
    measured = stats.length_stats(inputs.summary_results(spark, sf))
    return measured.withColumn("avg_len", F.round("avg_len", 6))


@query(
    "a10_coverage",
    "SELECT count(quality) AS present, count(*) AS total FROM documents d "
    "LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def a10_coverage(spark, sf):
    return stats.coverage(inputs.joined_documents(spark, sf), "quality")


PROFILED = (
    "profiled AS (SELECT *, CASE WHEN age % 7 = 0 THEN 'Error: busy' WHEN age % 3 = 0 THEN "
    "'Not enriched (sample limit)' ELSE 'Buys ' || category END AS ai_profile "
    "FROM clean_customers)"
)


def profiled(spark, sf):
    return clean.clean_customers(customers(spark, sf)).withColumn(
        "ai_profile",
        F.when(F.col("age") % 7 == 0, "Error: busy")
        .when(F.col("age") % 3 == 0, "Not enriched (sample limit)")
        .otherwise(F.concat(F.lit("Buys "), F.col("category"))),
    )


@query(
    "a11_customer_summary",
    sql_with(
        [CUSTOMERS, CLEAN_CUSTOMERS, PROFILED],
        "SELECT count(*) AS total_records, CAST(printf('%.2f', avg(spend)) AS DOUBLE) "
        "AS average_spend, count(*) FILTER (WHERE NOT starts_with(ai_profile, 'Error:') "
        "AND NOT contains(ai_profile, 'Not enriched')) AS enriched_count FROM profiled",
    ),
)
def a11_customer_summary(spark, sf):
    return stats.customer_summary(profiled(spark, sf))


@query(
    "a11_distributions",
    sql_with(
        [CUSTOMERS, CLEAN_CUSTOMERS],
        "SELECT 'region' AS column, region AS value, count(*) AS count FROM clean_customers "
        "WHERE region IS NOT NULL GROUP BY region UNION ALL SELECT 'tier', tier, count(*) "
        "FROM clean_customers WHERE tier IS NOT NULL GROUP BY tier",
    ).replace("AS column,", 'AS "column",'),
)
def a11_distributions(spark, sf):
    return stats.distributions(clean.clean_customers(customers(spark, sf)), ["region", "tier"])


@query(
    "a12_input_quality",
    sql_with(
        PRODUCT,
        "SELECT total_records, failed_classification, failed_summary, failed_any, "
        "round(100.0 * failed_classification / total_records, 6) AS classification_failure_rate, "
        "round(100.0 * failed_summary / total_records, 6) AS summary_failure_rate, "
        "round(100.0 * failed_any / total_records, 6) AS failure_rate, "
        "100.0 * failed_any / total_records > 10 AS high_failure_rate, true AS has_status_columns "
        "FROM (SELECT count(*) AS total_records, "
        "count(*) FILTER (WHERE _llm_status_class = 'failed') AS failed_classification, "
        "count(*) FILTER (WHERE _llm_status_summary = 'failed') AS failed_summary, "
        "count(*) FILTER (WHERE _llm_status_class = 'failed' OR _llm_status_summary = 'failed') "
        "AS failed_any FROM product)",
    ),
)
def a12_input_quality(spark, sf):
    report = stats.input_quality(document_product(spark, sf))
    rates = ["classification_failure_rate", "summary_failure_rate", "failure_rate"]
    return report.withColumns({name: F.round(name, 6) for name in rates})


@query("a13_guarded_results", sql_with(LABELS, "SELECT reference, _llm_status FROM results"))
def a13_guarded_results(spark, sf):
    results = inputs.label_results(spark, sf)
    return stats.require_success(results, "Classification").select("reference", "_llm_status")


_PROGRESS = (
    "SELECT count(*) AS processed, count(*) FILTER (WHERE _llm_status = 'success') "
    "AS success_count, count(*) FILTER (WHERE _llm_status = 'failed') AS fallback_count, "
    "count(*) FILTER (WHERE _llm_status = 'failed' AND error_type = 'ServiceUnavailable') "
    "AS mock_fallback_count, count(*) FILTER (WHERE _llm_status = 'failed' "
    "AND error_type <> 'ServiceUnavailable') AS real_errors FROM results"
)


PROGRESS_SQL = sql_with(LABELS, _PROGRESS)


@query("a14_progress", PROGRESS_SQL)
def a14_progress(spark, sf):
    return stats.progress(inputs.label_results(spark, sf), mock_mode=True)


@query(
    "a14_error_sample",
    sql_with(
        LABELS,
        "SELECT reference, _llm_error AS error FROM results WHERE _llm_status = 'failed' "
        "AND error_type <> 'ServiceUnavailable' ORDER BY reference LIMIT 5",
    ),
)
def a14_error_sample(spark, sf):
    return stats.error_sample(inputs.label_results(spark, sf), mock_mode=True)


@query(
    "a15_recent_errors",
    sql_with(
        LABELS,
        "SELECT error FROM (SELECT DISTINCT reference, reference || ': ' || "
        "_llm_error AS error FROM results WHERE _llm_status = 'failed') "
        "ORDER BY reference DESC, error DESC LIMIT 5",
    ),
)
def a15_recent_errors(spark, sf):
    return stats.recent_errors(inputs.label_results(spark, sf))


@query(
    "a17_product_metadata",
    "SELECT count(*) AS num_rows, CAST(3 AS INTEGER) AS num_columns, "
    "CAST(max(len(embedding)) AS INTEGER) AS dimensions FROM embeddings",
)
def a17_product_metadata(spark, sf):
    return stats.product_metadata(table(spark, sf, "embeddings"), "embedding")
