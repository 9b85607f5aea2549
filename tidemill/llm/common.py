"""What several operators share: table reads, word patterns, written intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - `slices` uses it on executors that import nothing else
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import delete_path, work_dir

#: a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of a write as soon as it has ended, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts the lineage for good."""
    path = work_dir(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def release(*written: DataFrame | None) -> None:
    """Delete materialized tables whose readers' results are written themselves."""
    for df in written:
        if df is not None and hasattr(df, "written_path"):
            delete_path(df.sparkSession, df.written_path)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """`df`, written, with a number `_row` of its own for every row; a column key may be null or repeated."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), label)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, so that every engine agrees."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_up(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of the named arrays; the input only says that rows match."""
    assert all(len(x) == batch.num_rows for x in columns.values())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `most_bytes` of `column` (strings or lists of 32-bit numbers), one row at least."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if pa.types.is_list(batch.schema.field(column).type):
            sizes = pa.compute.list_value_length(batch.column(column)).fill_null(0).to_numpy() * 4
        else:
            sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy()
        total = sizes.cumsum()
        while at < n:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(total.searchsorted(before + most_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the smallest node that undirected edges (a, b) lead to.

    Alternates large-star and small-star steps: every node hangs its larger neighbours, then
    its smaller ones, under its least neighbour. Both are plain minimum aggregations, so a
    node with very many edges is reduced map-side, and the rounds grow with the logarithm
    of a chain's length. Each round is written, so that a lost executor costs one round.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.filter("a <> b").distinct(), label)
    digest = _digest(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b"),
        )
        after = materialize(small.filter("a <> b").distinct(), label)
        before, digest = digest, _digest(after)
        release(edges)
        if digest == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = after


def _digest(edges: DataFrame) -> tuple:
    hashes = F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(1))
    return tuple(edges.agg(F.count(F.lit(1)), *map(F.bit_xor, hashes)).first())
