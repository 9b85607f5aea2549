"""CSV in, Parquet products, JSON reports."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import PARQUET, list_files, path_size


def read_csv_folder(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str | None = None,
    quoted_newlines: bool = True,
) -> DataFrame:
    """All CSV files of a folder, each with a header: quoted newlines, doubled quotes.

    Quoted newlines keep the reader from splitting a file; say that there are none and large
    files are read by many tasks. Without a schema the types are inferred, which reads the
    files twice.
    """
    files = list_files(spark, folder)
    found = [name for name in files if name.endswith(".csv")]
    if not found:
        raise ValueError(f"No CSV files found in {folder}. Available files: {files}")
    reader = spark.read.option("header", True).option("multiLine", quoted_newlines).option("escape", '"')
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv([f"{folder}/{name}" for name in found])


def write_product(df: DataFrame | None, path: str, log=print) -> str | None:
    """Full overwrite; None is skipped with a warning."""
    if df is None:
        log(f"nothing to write to {path}")
        return None
    df.write.options(**PARQUET).mode("overwrite").parquet(path)
    return path


def read_product(spark: SparkSession, path: str) -> DataFrame:
    """A stored product; FileNotFoundError if there is none, other errors as they come."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no product at {path}") from problem
        raise


def write_report(report: DataFrame, folder: str, stamp: str | None = None) -> list[str]:
    """A one-row frame as JSON, once under its time and once as `latest`."""
    stamp = stamp or datetime.now().strftime("%Y%m%d-%H%M%S")
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is exactly one row")
    text = json.dumps(rows[0].asDict(recursive=True), default=str, ensure_ascii=False)
    line = report.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
    paths = [f"{folder}/{stamp}", f"{folder}/latest"]
    for path in paths:
        line.write.mode("overwrite").text(path)
    return paths


def read_report(spark: SparkSession, folder: str, stamp: str = "latest") -> dict:
    return json.loads(spark.read.text(f"{folder}/{stamp}").first()["value"])


def write_snapshot(df: DataFrame, path: str, key: str = "reference") -> DataFrame:
    """(key, embedding) as Parquet, and a one-row frame of its counts and size."""
    df.select(key, "embedding").write.options(**PARQUET).mode("overwrite").parquet(path)
    spark = df.sparkSession
    size = path_size(spark, path) / 1024 / 1024
    return spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("num_records"),
        F.max(F.size("embedding")).alias("dimensions"),
        F.lit(size).alias("size_mb"),
    )
