"""Joins that put a document product together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.operators.clean import narrow_results, rename_strict, select_existing
from tidemill.operators.skew import left_joins

KEY = "reference"


def duplicate_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """Key values that occur more than once. Joined results would multiply on them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_unique(df: DataFrame, key: str = KEY) -> DataFrame:
    worst = duplicate_keys(df, key).orderBy(F.desc("rows"), key).limit(5).collect()
    if worst:
        shown = ", ".join(f"{row[key]!r} x{row['rows']}" for row in worst)
        raise ValueError(f"{key} is not unique: {shown}")
    return df


def join_summaries(
    documents: DataFrame, summaries: DataFrame, key: str = KEY, heavy: dict | None = None
) -> DataFrame:
    """Documents with their summary, null where there is none."""
    return left_joins(documents, [summaries.select(key, "summary")], key, heavy=heavy)


def join_labels(
    documents: DataFrame, results: DataFrame, key: str = KEY, heavy: dict | None = None
) -> DataFrame:
    """Documents with labels and status columns in their stored types."""
    return left_joins(documents, [narrow_results(results, key)], key, heavy=heavy)


def assemble_product(
    documents: DataFrame,
    labels: DataFrame,
    summaries: DataFrame,
    processed_at: str,
    key: str = KEY,
    heavy: dict | None = None,
) -> DataFrame:
    """Documents, labels and summaries in one table with one `summary` column.

    Each side brings its status columns under its own names. The document side may carry
    an earlier `summary` copy; the summary table's column is the one kept.
    """
    label_side = rename_strict(
        select_existing(labels, [key, *fixed.LABEL_FIELDS, *fixed.STATUS_COLUMNS]),
        fixed.CLASS_NAMES,
    )
    summary_side = rename_strict(
        select_existing(summaries, [key, "summary", *fixed.STATUS_COLUMNS]),
        fixed.SUMMARY_NAMES,
    )
    taken = (set(label_side.columns) | set(summary_side.columns)) - {key}
    plain = documents.drop(*[name for name in documents.columns if name in taken])
    joined = left_joins(plain, [label_side, summary_side], key, heavy=heavy)
    return joined.withColumn("processed_at", F.lit(processed_at))


def join_index_labels(
    documents: DataFrame, labels: DataFrame, key: str = KEY, heavy: dict | None = None
) -> DataFrame:
    """Documents with the four label columns only."""
    return left_joins(documents, [labels.select(key, *fixed.LABEL_FIELDS)], key, heavy=heavy)


def align_vectors(
    documents: DataFrame,
    vectors: DataFrame,
    fallback: Column,
    key: str = KEY,
    heavy: dict | None = None,
) -> DataFrame:
    """Documents with their vector; rows without one get the fallback expression."""
    joined = left_joins(documents, [vectors.select(key, "embedding")], key, heavy=heavy)
    return joined.withColumn("embedding", F.coalesce("embedding", fallback))
