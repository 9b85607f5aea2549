"""Row work on files as they arrive.

Cleaning, parsing, scoring and embedding need no state, so they run unchanged on a
stream. The stream's own checkpoint remembers which files are done; that takes the place
of comparing with stored results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def process_arrivals(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    name: str | None = None,
) -> DataFrame:
    """Work off all Parquet files not seen yet, append to `sink` exactly once, and stop.

    Both `sink` and `checkpoint` must be on storage that the whole cluster shares.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = transform(reader.parquet(source)).writeStream.format("parquet")
    if name:
        writer = writer.queryName(name)
    query = (
        writer.option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(sink)
