"""Counts and rates over result tables. Each is one aggregation with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import fixed, replies, text


def _is(name: str, value) -> Column:
    return F.col(name) == F.lit(value)


def product_stats(product: DataFrame) -> DataFrame:
    """Rows, tariff mentions and governor rows."""
    governor = F.col("is_gov").cast("int") == 1
    return product.agg(
        F.count(F.lit(1)).alias("num_records"),
        F.count_if(_is("tariff_mention", 1)).alias("tariff_mentions"),
        F.count_if(governor).alias("governor_speeches"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def sorted_value_counts(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column).orderBy(column)


def success_summary(results: DataFrame, status: str = "_llm_status") -> DataFrame:
    """Total, failed, successful and the success rate as text."""
    counted = results.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(_is(status, "failed")).alias("failed"),
    )
    successful = F.col("total_processed") - F.col("failed")
    return counted.select(
        "total_processed",
        "failed",
        successful.alias("successful"),
        text.rate_text(successful, F.col("total_processed")).alias("success_rate"),
    )


def failure_breakdown(results: DataFrame, error_type: str | None = None) -> DataFrame:
    """Failed rows in five classes, by stored type if there is one, else by message text."""
    if error_type:
        known = F.col(error_type).isin(fixed.BREAKDOWN_CLASSES)
        kind = F.when(known, F.col(error_type)).otherwise(fixed.UNEXPECTED)
    else:
        kind = replies.failure_class("_llm_error")
    failed = results.filter(_is("_llm_status", "failed")).select(kind.alias("kind"))
    return failed.agg(*[F.count_if(_is("kind", c)).alias(c) for c in fixed.BREAKDOWN_CLASSES])


def mean_attempts(results: DataFrame, column: str = "_llm_attempts") -> DataFrame:
    """Average attempts; 1.0 without rows and for an average of zero."""
    mean = F.avg(column)
    return results.agg(
        F.coalesce(F.nullif(mean, F.lit(0.0)), F.lit(1.0)).alias("avg_attempts")
    )


def failed_references(
    results: DataFrame, key: str = "reference", limit: int | None = None
) -> DataFrame:
    """All failed keys, or the first `limit` in key order."""
    failed = results.filter(_is("_llm_status", "failed")).select(F.col(key).cast("string").alias(key))
    return failed if limit is None else failed.orderBy(key).limit(limit)


def failed_reference_list(results: DataFrame, key: str = "reference", limit: int = 100):
    """The first `limit` as one row holding a sorted array; the limit bounds that row."""
    first = failed_references(results, key, limit)
    return first.agg(F.array_sort(F.collect_list(key)).alias("failed_references"))


def length_stats(df: DataFrame, column: str = "summary") -> DataFrame:
    size = F.length(column)
    return df.agg(
        F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_len"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_len"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_len"),
    )


def coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(column).alias("present"), F.count(F.lit(1)).alias("total")
    )


def is_enriched(profile: str) -> Column:
    column = F.col(profile)
    return ~(column.startswith("Error:") | column.contains("Not enriched"))


def customer_summary(customers: DataFrame) -> DataFrame:
    """One row: customers, mean spend to two places, and how many got a profile."""
    return customers.agg(
        F.count(F.lit(1)).alias("total_records"),
        text.round_binary(F.avg("spend"), 2).alias("average_spend"),
        F.count_if(is_enriched("ai_profile")).alias("enriched_count"),
    )


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) of several columns from one scan and one shuffle."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                for c in columns
            ]
        )
    )
    return (
        df.select(pairs.alias("pair"))
        .select("pair.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def input_quality(df: DataFrame, alarm_percent: float = 10.0) -> DataFrame:
    """Failed labels, failed summaries, rows with either, their rates, and a high-rate flag.

    Which status columns exist is read off the schema; without any the row says so.
    """
    columns = {"labels": "_llm_status_class", "summaries": "_llm_status_summary"}
    failed = {
        part: _is(name, "failed") if name in df.columns else F.lit(False)
        for part, name in columns.items()
    }
    either = F.coalesce(failed["labels"], F.lit(False)) | F.coalesce(
        failed["summaries"], F.lit(False)
    )
    counted = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(failed["labels"]).alias("failed_classification"),
        F.count_if(failed["summaries"]).alias("failed_summary"),
        F.count_if(either).alias("failed_any"),
    )
    total = F.col("total_records")
    percent = lambda name: F.coalesce(
        F.lit(100.0) * F.col(name) / F.nullif(total, F.lit(0)), F.lit(0.0)
    )
    return counted.select(
        "*",
        percent("failed_classification").alias("classification_failure_rate"),
        percent("failed_summary").alias("summary_failure_rate"),
        percent("failed_any").alias("failure_rate"),
        (percent("failed_any") > alarm_percent).alias("high_failure_rate"),
        F.lit(any(name in df.columns for name in columns.values())).alias("has_status_columns"),
    )


def require_success(results: DataFrame, what: str, key: str = "reference") -> DataFrame:
    """Raise when there are rows and none succeeded, quoting the first error in key order."""
    row = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_is("_llm_status", "failed")).alias("failed"),
        F.min_by("_llm_error", key).alias("error"),
    ).first()
    if row["total"] and row["failed"] == row["total"]:
        raise RuntimeError(f"{what} failed for all {row['total']} rows. First error: {row['error']}")
    return results


def progress(results: DataFrame, mock_mode: bool = False) -> DataFrame:
    """Processed, successful, expected fallbacks (service absent in mock mode), real errors."""
    expected = _is("error_type", fixed.UNAVAILABLE) if mock_mode else F.lit(False)
    failed = _is("_llm_status", "failed")
    return results.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(_is("_llm_status", "success")).alias("success_count"),
        F.count_if(failed).alias("fallback_count"),
        F.count_if(failed & expected).alias("mock_fallback_count"),
        F.count_if(failed & ~F.coalesce(expected, F.lit(False))).alias("real_errors"),
    )


def error_sample(
    results: DataFrame, mock_mode: bool = False, key: str = "reference", limit: int = 5
) -> DataFrame:
    """The first real errors in key order."""
    failed = results.filter(_is("_llm_status", "failed"))
    if mock_mode:
        failed = failed.filter(~F.col("error_type").eqNullSafe(fixed.UNAVAILABLE))
    message = F.coalesce("_llm_error", F.lit("Unknown error"))
    return failed.select(key, message.alias("error")).orderBy(key).limit(limit)


def recent_errors(
    results: DataFrame, key: str = "reference", limit: int = 5, chars: int | None = None
) -> DataFrame:
    """The last distinct `id: message` lines, messages whole or cut to `chars`.

    Each pass is a plain top-n below the last line found, so no lines are shuffled; repeats of
    a line can cost passes, at most one for each line that is returned. Lines of null keys are
    null and come last.
    """
    message = text.truncate(F.coalesce("_llm_error", F.lit("Unknown error")), chars)
    line = F.concat(F.col(key).cast("string"), F.lit(": "), message)
    failed = results.filter(_is("_llm_status", "failed")).select(F.col(key).alias("_key"), line.alias("error"))
    named, found, below = failed.filter("_key IS NOT NULL"), [], F.lit(True)
    while len(found) < limit:
        top = named.filter(below).orderBy(F.desc("_key"), F.desc("error")).limit(4 * limit).collect()
        found += dict.fromkeys((row["_key"], row["error"]) for row in top)
        if len(top) < 4 * limit:
            break
        last, end = F.lit(top[-1]["_key"]), F.lit(top[-1]["error"])
        below = (F.col("_key") < last) | (F.col("_key") == last) & (F.col("error") < end)
    lines = [(error,) for _, error in found]
    if len(lines) < limit and not failed.filter("_key IS NULL").isEmpty():
        lines.append((None,))
    return results.sparkSession.createDataFrame(lines[:limit], "error string")


def product_metadata(df: DataFrame, embedding: str | None = None) -> DataFrame:
    """Row and column counts, and the vector dimension where there is one."""
    dimension = F.max(F.size(embedding)) if embedding else F.lit(None).cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("num_rows"), dimension.alias("dimensions")
    ).select("num_rows", F.lit(len(df.columns)).alias("num_columns"), "dimensions")
