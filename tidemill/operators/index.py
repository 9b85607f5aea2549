"""Dense row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import draws
from tidemill.session import work_dir


def dense_index(
    df: DataFrame, order_by: list[str], name: str = "row_index", path: str | None = None
) -> DataFrame:
    """0..n-1 in the order of a unique key.

    The sorted rows are written to the shared folder once. A row's number is its place in
    its file plus the rows of all earlier files, so counting and numbering agree whatever
    happens to executors in between. The file counts are one small row per file. The
    result reads the sorted copy, which the caller may place and remove by `path`.
    """
    spark = df.sparkSession
    path = path or work_dir(spark, "sorted")
    df.orderBy(*order_by).write.parquet(path)
    part = [
        F.regexp_extract("_metadata.file_name", pattern, 1).cast("int")
        for pattern in (r"^part-(\d+)", r"-c(\d+)")
    ]
    placed = spark.read.parquet(path).select(
        "*",
        part[0].alias("_part"),
        part[1].alias("_piece"),
        F.col("_metadata.row_index").alias("_local"),
    )
    sizes = placed.groupBy("_part", "_piece").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.orderBy("_part", "_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", "_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    return (
        placed.join(F.broadcast(starts), ["_part", "_piece"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_part", "_piece", "_start", "_local")
    )


def synth_id(index: Column | str) -> Column:
    """SYNTH-000042; numbers past six digits keep all of them."""
    index = F.col(index) if isinstance(index, str) else index
    return F.format_string("SYNTH-%06d", index)


def with_synth_ids(df: DataFrame, order_by: list[str], key: str = "reference") -> DataFrame:
    """New surrogate ids in key order, replacing the source id."""
    indexed = dense_index(df, order_by, "_index")
    return indexed.withColumn(key, synth_id("_index")).drop("_index")


def digits_for(rows: int) -> int:
    """Hex digits that keep a bucket near 100,000 rows, between 4096 buckets and 16 million."""
    digits = 3
    while digits < 6 and rows > 100_000 * 16**digits:
        digits += 1
    return digits


def scattered_index(
    df: DataFrame,
    digest: str,
    group: str | None = None,
    name: str = "position",
    hex_digits: int = 3,
) -> DataFrame:
    """0..n-1 in the order of an md5 column, within each value of `group` if one is given.

    The first hex digits of a digest split the rows into even, already ordered buckets.
    Rows are numbered inside their bucket and moved up by the rows of all earlier buckets.
    The rows move once: the bucket starts join them on the partitioning of the numbering.
    Digests are taken of a unique key, so that no bucket can grow out of proportion.
    """
    keys = [group] if group else []
    bucket = F.substring(digest, 1, hex_digits)
    bucketed = df.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    # at most 16^hex_digits rows per group
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(digest)
    return (
        bucketed.withColumn("_local", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_bucket", "_start", "_local")
    )


def with_digest(
    df: DataFrame, key: str, seed: int | str, label: str, name: str = "_digest"
) -> DataFrame:
    return df.withColumn(name, draws.digest(key, seed, label))
