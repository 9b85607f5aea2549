"""Exact top-k cosine search."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.functions.vectors import certainty
from tidemill.operators import embed
from tidemill.session import work_dir

QUERY_BYTES = 64 * 1024 * 1024
CELLS = 4_000_000  # distances held at a time, 32 MB


def vector_dims(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Smallest, largest and missing vector sizes."""
    size = F.size(column)
    return df.agg(
        F.min(size).alias("min_dim"),
        F.max(size).alias("max_dim"),
        F.count_if(F.col(column).isNull()).alias("missing"),
    )


def require_one_dim(df: DataFrame, column: str = "embedding") -> int:
    row = vector_dims(df, column).first()
    if row["missing"] or row["min_dim"] != row["max_dim"]:
        raise ValueError(
            f"{column}: sizes {row['min_dim']} to {row['max_dim']}, {row['missing']} missing"
        )
    return row["max_dim"]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    query_key: str = "query_id",
    column: str = "embedding",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_key, key, distance, certainty, rank): the k nearest vectors of every query.

    A task turns its Arrow batches into matrix products and hands on only its own best k
    per query. The queries travel to the tasks in blocks of at most `query_bytes`; more
    queries than fit in one block take one pass over the vectors per block, and each pass is
    written before the next block is read, so the driver never holds more than one. Distances
    are kept to 12 places, so that equal vectors tie wherever they lie; ties go to the smaller
    key. Vectors of length zero have no direction and are left out.
    """
    def ranked(block: DataFrame):
        found, sent = _nearest(vectors, block, k, key, query_key, column)
        rank = F.row_number().over(W.partitionBy(query_key).orderBy("distance", key))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        shown = certainty("distance").alias("certainty")
        return best.select(query_key, key, "distance", shown, "rank"), sent

    parts, blocks = _query_blocks(queries.select(query_key, column), query_key, column, query_bytes)
    if parts == 1:
        return ranked(next(blocks))[0]
    path = work_dir(vectors.sparkSession, "nearest")
    for block in blocks:
        best, sent = ranked(block)
        schema = best.schema
        best.write.mode("append").parquet(path)
        sent.destroy()
    return vectors.sparkSession.read.schema(schema).parquet(path)


def search_objects(
    objects: DataFrame,
    queries: DataFrame,
    embedder,
    k: int = 10,
    key: str = "reference",
    query_key: str = "query_id",
    text: str = "query",
    column: str = "embedding",
) -> DataFrame:
    """Query texts in, the nearest stored objects out: hits with all properties but the vector.

    The texts go to the embedder as queries. Only the hits, k for a query, meet the
    collection again; keys of objects are unique there.
    """
    asked = embed.embed_queries(queries.select(query_key, text), embedder, text, target=column)
    hits = top_k(objects, asked, k, key, query_key, column)
    return hits.join(objects.drop(column), key)


def _query_blocks(queries, query_key, column, query_bytes) -> tuple[int, Iterator[DataFrame]]:
    """The queries as they are if they fit, else split by a hash until every part fits."""
    size = queries.agg(F.max(F.size(column)).alias("d"), F.count(F.lit(1)).alias("n")).first()
    fits = max(1, query_bytes // (8 * max(1, size["d"] or 1)))
    if size["n"] <= fits:
        return 1, iter([queries])
    parts = 1
    largest = size["n"]
    while largest > fits:
        parts *= 2
        part = F.pmod(F.xxhash64(query_key), F.lit(parts))
        largest = queries.groupBy(part.alias("part")).count().agg(F.max("count")).first()[0]
    return parts, (queries.filter(part == n) for n in range(parts))


def _nearest(vectors, queries, k, key, query_key, column):
    """The best k per query within each task's own vectors, and the block as it was sent."""
    import numpy as np

    rows = queries.collect()  # one block, bounded by query_bytes
    matrix = np.array([row[column] for row in rows], dtype="float64").reshape(len(rows), -1)
    sent = vectors.sparkSession.sparkContext.broadcast(([row[query_key] for row in rows], matrix))
    schema = T.StructType(
        [
            T.StructField(query_key, queries.schema[query_key].dataType),
            T.StructField(key, vectors.schema[key].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    arrow_schema = to_arrow_schema(schema)
    cells = CELLS

    def pieces(batches, step):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, matrix = sent.value
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        unit = matrix / np.where(lengths == 0, np.nan, lengths)
        best = [(np.empty(0), None) for _ in ids]
        step = max(1, cells // max(1, len(ids)))
        for batch in pieces(batches, step):
            batch = batch.filter(pc.is_valid(batch.column(column)))
            if batch.num_rows == 0 or not ids:
                continue
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            data = flat.astype("float64").reshape(batch.num_rows, -1)
            norms = np.linalg.norm(data, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                distances = np.round(1.0 - (unit @ data.T) / norms, 12) + 0.0
            keys = np.asarray(batch.column(key).to_pylist(), dtype=object)
            for i in range(len(ids)):
                row = distances[i]
                valid = np.flatnonzero(~np.isnan(row))
                if len(valid) > k:
                    edge = np.partition(row[valid], k - 1)[k - 1]
                    valid = valid[row[valid] <= edge]
                old, old_keys = best[i]
                merged = np.concatenate([old, row[valid]])
                merged_keys = (
                    keys[valid] if old_keys is None else np.concatenate([old_keys, keys[valid]])
                )
                order = sorted(range(len(merged)), key=lambda j: (merged[j], merged_keys[j]))[:k]
                best[i] = (merged[order], merged_keys[order])
        for query, (values, kept) in zip(ids, best):
            if kept is not None and len(values):
                yield pa.RecordBatch.from_pydict(
                    {
                        query_key: [query] * len(values),
                        key: list(kept),
                        "distance": values,
                    },
                    schema=arrow_schema,
                )

    return vectors.select(key, column).mapInArrow(run, schema), sent
