"""Row work that is expensive and therefore kept: done rows are stored and skipped later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.product import duplicate_keys
from tidemill.operators.skew import anti_join
from tidemill.operators.stats import progress
from tidemill.session import PARQUET, delete_path, list_files, move_path, path_exists, work_dir


def load_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Earlier results, or None when there are none yet. Any other problem raises."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def remaining_rows(
    df: DataFrame, results: DataFrame | None, key: str, heavy: dict | None = None
) -> DataFrame:
    return df if results is None else anti_join(df, results, key, heavy=heavy)


def append_results(df: DataFrame, path: str) -> dict:
    """Append one chunk, columns in the order of the store; says how many rows and failures.

    The store is never rewritten, so the cost of a run is linear in its rows.
    """
    existing = load_results(df.sparkSession, path)
    aligned = df.select(*existing.columns) if existing is not None else df
    seen = Observation()
    failed = F.col("_llm_status") == "failed" if "_llm_status" in df.columns else F.lit(False)
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("failed")]
    aligned.observe(seen, *metrics).write.options(**PARQUET).mode("append").parquet(path)
    return seen.get


def finalize_results(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """All stored results, one row per key even if a chunk was written twice.

    Of different rows of a key the one with the largest digest stays, on every run.

    Looking for repeated keys moves the keys only; the rows move just when there are some.
    """
    results = load_results(spark, path)
    if results is None or duplicate_keys(results, key).isEmpty():
        return results
    row = F.max_by(F.struct(*results.columns), F.xxhash64(*results.columns)).alias("_row")
    return results.groupBy(F.col(key).alias("_key")).agg(row).select("_row.*")


def place_results(results: DataFrame, path: str, target: str) -> None:
    """Let `target` hold finished results: the store itself is moved there, unless they differ from it."""
    spark = results.sparkSession
    if results.sameSemantics(spark.read.parquet(path)):
        move_path(spark, path, target)
    else:
        results.write.options(**PARQUET).mode("overwrite").parquet(target)
        cleanup_results(spark, path)


def cleanup_results(spark: SparkSession, path: str) -> None:
    """Remove the store after success. A failure to remove it does not matter."""
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001
        pass


def score_with_resume(
    df: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    key: str = "reference",
    chunks: int = 1,
    report: Callable[[dict], None] | None = None,
    heavy: dict | None = None,
) -> DataFrame:
    """Score what the store at `path` lacks and return everything stored.

    With several chunks the remaining rows are staged once, split by a hash of their key,
    and each chunk is its own append: a run that dies keeps all finished chunks.
    """
    spark = df.sparkSession
    earlier = load_results(spark, path)
    todo = remaining_rows(df, earlier, key, heavy)
    stage = work_dir(spark, "stage") if chunks > 1 else None
    try:
        done = failed = 0
        for chunk in _chunks(todo, key, chunks, stage):
            counts = append_results(score(chunk), path)
            done, failed = done + counts["rows"], failed + counts["failed"]
            if report is not None:
                report({"processed": done, "failed": failed, "success": done - failed})
    finally:
        if stage:
            cleanup_results(spark, stage)
    if earlier is None and done == 0:
        raise RuntimeError(f"no results at {path}: the input has no rows")
    return finalize_results(spark, path, key)


def stored_progress(spark: SparkSession, path: str, ledger: str, mock_mode: bool = False) -> DataFrame:
    """`stats.progress` of all results at `path`, counting only files that were not counted yet.

    The ledger holds the counts of each file of the store, which are never rewritten. A run
    that dies before its files are counted leaves them to the next look, and a file counted
    by two at once has the same counts twice and is added once. A ledger is for one store
    and one `mock_mode`.
    """
    names = list_files(spark, path) if path_exists(spark, path) else []
    files = [name for name in names if name.endswith(".parquet")]
    counted = spark.read.parquet(ledger) if path_exists(spark, ledger) else None
    # one row per file, as the listing
    known = {row["file"] for row in counted.select("file").distinct().collect()} if counted is not None else set()
    fresh = [name for name in files if name not in known]
    if fresh:
        results = spark.read.parquet(*[f"{path}/{name}" for name in fresh])
        by_file = results.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).groupBy("file")
        seen = progress(by_file, mock_mode)
        empty = spark.createDataFrame([(name,) for name in fresh], "file string").join(seen, "file", "left")
        empty.fillna(0).coalesce(1).write.mode("append").parquet(ledger)
    if not path_exists(spark, ledger):
        return progress(spark.createDataFrame([], "_llm_status string, error_type string"), mock_mode)
    counts = spark.read.parquet(ledger)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns if c != "file"]
    return counts.dropDuplicates(["file"]).agg(*sums)


def _chunks(todo: DataFrame, key: str, chunks: int, stage: str | None) -> list[DataFrame]:
    if stage is None:
        return [todo]
    part = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")
    # a chunk's rows meet in a few tasks, so that the stage has few files and none is too large
    ways = max(1, int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")) // chunks)
    spread = F.pmod(F.xxhash64(key, F.lit("stage")), F.lit(ways))
    chunked = todo.withColumn("_chunk", part).repartition("_chunk", spread)
    chunked.write.options(**PARQUET).partitionBy("_chunk").parquet(stage)
    staged = todo.sparkSession.read.parquet(stage)
    return [staged.filter(F.col("_chunk") == n).drop("_chunk") for n in range(chunks)]
