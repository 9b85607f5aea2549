"""Inverted-file index for vector search: k-means cells, pruned probing, exact distances.

Cells come from spherical k-means: every round multiplies the training vectors with the centres
inside the tasks, adds up partial sums there and groups one row per task and cell. The index is
a Parquet table with a folder for each cell, so a search reads only the folders of the cells it
probes. Found vectors are always ranked by their exact distance.

How many cells a search probes by default is measured by the build: a bounded number of stored
vectors is searched exactly, and the fewest nearest cells are taken that hold the wanted share of
their neighbours.

With `exact=True` a search first probes and then reads the other cells that could still hold
something nearer, told by the largest angle between a cell's centre and its vectors: the result is
that of `search.top_k`, usually from a part of the cells.

Defined results: vectors that are null, of length zero or with a value that is no number have no
direction; they are kept in cell -1, counted by the build, and found by no search. Vectors of
another size than the others are refused. Ties go to the smaller key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.functions.vectors import certainty
from tidemill.operators.search import CELLS, QUERY_BYTES, _query_blocks, top_k
from tidemill.session import work_dir

NO_CELL = -1
CENTRE_BYTES = 64 * 1024 * 1024  # centres are sent to every task
SLACK = 1e-9  # bounds are kept this much too wide, against rounding


@dataclass(frozen=True)
class IndexSettings:
    cells: int | None = None  # the square root of the number of vectors if not given
    most_cells: int = 16_384
    train_rows_per_cell: int = 256  # centres are fitted on at most so many vectors for each
    rounds: int = 8
    seed: int = 0
    tuning_queries: int = 256  # vectors, picked by a hash, whose exact neighbours say how many cells to probe
    tuning_k: int = 10
    recall: float = 0.99  # of the tuning queries' neighbours; a search on other vectors may stay below it


def without_direction(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """How many vectors a search cannot find: null, of length zero, or with a value that is no number."""
    return vectors.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(column).isNull()).alias("missing"),
        F.count_if(_length(column) == 0).alias("zero"),
        F.count_if(F.col(column).isNotNull() & ~_finite(column)).alias("not_finite"),
    )


def _length(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def _finite(column: str) -> Column:
    length = _length(column)
    return length.isNotNull() & ~F.isnan(length) & (length < F.lit(float("inf")))


def _usable(column: str) -> Column:
    return F.coalesce(_finite(column) & (_length(column) > 0), F.lit(False))


def build_index(
    vectors: DataFrame, path: str, key: str = "vec_id", column: str = "embedding", settings: IndexSettings | None = None
) -> dict:
    """Fit cells and write the index below `path`; the counts of what went where."""
    s, spark = settings or IndexSettings(), vectors.sparkSession
    usable = vectors.filter(_usable(column))
    size = F.size(column)
    seen = usable.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("dim")).first()
    if seen["least"] != seen["dim"]:
        raise ValueError(f"{column}: sizes {seen['least']} to {seen['dim']}")
    n, dim = seen["n"], seen["dim"] or 1
    cells = min(s.cells or max(1, round(n**0.5)), s.most_cells, max(1, n), max(1, CENTRE_BYTES // (8 * dim)))
    centres = _fit(usable, key, column, n, cells, s)
    placed = _place(vectors.select(key, column), column, centres)
    # a cell may hold any share of the vectors: rebalancing splits it over several tasks
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([], placed.schema).coalesce(1).write.parquet(f"{path}/schema")
    stored = _stored(spark, path)
    stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).write.parquet(f"{path}/radius")
    rows = [(i, row.tolist()) for i, row in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    probes = _probes_for(usable, stored, centres, key, column, n, s)
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    counts = spark.read.parquet(f"{path}/radius")
    row = counts.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("cell") >= 0, F.col("n"))).alias("indexed"), F.max(F.when(F.col("cell") >= 0, F.col("n"))).alias("largest")).first()
    indexed = row["indexed"] or 0
    return {"rows": row["rows"] or 0, "indexed": indexed, "no_direction": (row["rows"] or 0) - indexed, "cells": cells, "largest_cell": row["largest"] or 0, "probes": probes}


def _probes_for(usable, stored, centres, key, column, n, s) -> int:
    """The fewest nearest cells that hold the wanted share of the exact neighbours of sampled vectors."""
    import numpy as np

    if not n:
        return 1
    share = min(1.0, s.tuning_queries / n)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(s.seed + 1)), F.lit(1 << 40))
    asked = usable.filter(draw <= int(min(1.0, 2 * share + 1e-9) * (1 << 40))).orderBy(draw, key).limit(s.tuning_queries)
    asked = asked.select(F.col(key).alias("_query"), F.col(column).alias("_vector"))
    spark, rows = usable.sparkSession, asked.collect()
    asked = spark.createDataFrame(rows, asked.schema)
    exact = top_k(usable.withColumnRenamed(column, "_vector"), asked, s.tuning_k, key, "_query", "_vector")
    cells = exact.select("_query", key).join(stored.select(key, "cell"), key).select("_query", "cell").collect()
    data = np.array([row["_vector"] for row in rows], "float64")
    place = np.argsort(np.argsort(-(data @ centres.T), axis=1, kind="stable"), axis=1)  # a bounded sample of queries
    number = {row["_query"]: i for i, row in enumerate(rows)}
    needed = np.sort([place[number[row["_query"]], row["cell"]] for row in cells])
    return int(needed[max(0, int(np.ceil(s.recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def _fit(usable, key, column, n, cells, s):
    """Unit centres by spherical k-means over a hash sample of bounded size."""
    import numpy as np

    spark = usable.sparkSession
    draw = F.xxhash64(F.col(key), F.lit(s.seed))
    share = min(1.0, s.train_rows_per_cell * cells / max(1, n))
    sample = usable.select(F.col(column).alias("v"), draw.alias("_draw"))
    if share < 1.0:
        sample = sample.filter(F.pmod("_draw", F.lit(1 << 30)) < int(share * (1 << 30)))
    # equal vectors would begin as one cell many times, so starts are distinct vectors
    starts = sample.groupBy("v").agg(F.min("_draw").alias("_draw")).orderBy("_draw").limit(cells)
    first = np.array([row["v"] for row in starts.select("v").collect()], "float64")
    if not len(first):
        return np.zeros((0, 1))
    centres = first / np.linalg.norm(first, axis=1, keepdims=True)
    for _ in range(s.rounds):
        sent = spark.sparkContext.broadcast(centres)
        sums = sample.select("v").mapInArrow(_partial_sums(sent), "cell int, n long, total array<double>")
        totals = sums.select("cell", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
        rows = totals.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("total")).collect()
        sent.destroy()
        moved = centres.copy()
        for row in rows:  # one row a cell
            total = np.array(row["total"])
            length = np.linalg.norm(total)
            if length > 0:
                moved[row["cell"]] = total / length
        if np.abs(moved - centres).max() < 1e-6:
            return moved
        centres = moved
    return centres


def _matrix(column):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    data = flat.reshape(len(column), -1)
    return data / np.linalg.norm(data, axis=1, keepdims=True)


def _pieces(batches, width):
    """Batches cut so that a product with `width` columns stays bounded, however many cells or queries there are."""
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _partial_sums(sent):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        centres = sent.value
        totals, counts = np.zeros(centres.shape), np.zeros(len(centres), "int64")
        for batch in _pieces(batches, len(centres)):
            data = _matrix(batch.column(0))
            cell = (data @ centres.T).argmax(axis=1)
            order = np.argsort(cell, kind="stable")
            found, at = np.unique(cell[order], return_index=True)
            totals[found] += np.add.reduceat(data[order], at, axis=0)
            counts += np.bincount(cell, minlength=len(centres))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"cell": used.astype("int32"), "n": counts[used], "total": pa.array(totals[used].tolist(), pa.list_(pa.float64()))}
        )

    return run


def _place(vectors, column, centres):
    """Every row with its cell and its angle to the cell's centre."""
    spark = vectors.sparkSession
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)
    sent = spark.sparkContext.broadcast(centres)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centres = sent.value
        for batch in _pieces(batches, len(centres)):
            usable = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            cell, angle = np.full(batch.num_rows, NO_CELL, "int32"), np.full(batch.num_rows, np.nan)
            if usable.any():
                data = _matrix(batch.column(column).filter(pa.array(usable)))
                near = data @ centres.T
                cell[usable] = near.argmax(axis=1)
                angle[usable] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            columns = [*batch.columns[:-1], pa.array(cell), pa.array(angle, mask=~usable)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return vectors.withColumn("_usable", _usable(column)).mapInArrow(run, schema)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/vectors")


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 10,
    probes: int | None = None,
    key: str = "vec_id",
    query_key: str = "query_id",
    column: str = "embedding",
    exact: bool = False,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_key, key, distance, certainty, rank): the k nearest of the vectors in the probed cells.

    `probes` is the number of cells a query reads, what the build measured if not given. Queries
    without a direction find nothing. Queries travel in blocks as in `search.top_k`.
    """
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most CENTRE_BYTES
    radius = {row["cell"]: row["angle"] for row in spark.read.parquet(f"{path}/radius").collect()}
    probes = probes or spark.read.parquet(f"{path}/probes").first()["probes"]
    kept = queries.select(query_key, column).filter(_usable(column))
    _, blocks = _query_blocks(kept, query_key, column, query_bytes)
    target, schema = work_dir(spark, "index-nearest"), None
    for block in blocks:
        best = _search_block(spark, path, block, centres, radius, k, probes, key, query_key, column, exact)
        schema = best.schema
        best.write.mode("append").parquet(target)
    return spark.read.schema(schema).parquet(target)


def _search_block(spark, path, block, centres, radius, k, probes, key, query_key, column, exact):
    import numpy as np

    rows = block.collect()  # one block, bounded by query_bytes
    vectors, ids = _stored(spark, path), [row[query_key] for row in rows]
    middle = np.array([row["centre"] for row in centres], "float64")
    matrix = np.array([row[column] for row in rows], "float64")
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if ids else matrix
    step, pairs = max(1, CELLS // max(1, len(centres))), []  # never all queries against all centres at once
    first = np.zeros((0, 0), "int32")
    if len(ids) and len(centres):
        first = np.concatenate([np.argsort(-(unit[i : i + step] @ middle.T), axis=1, kind="stable")[:, :probes].astype("int32") for i in range(0, len(ids), step)])
    wanted = _by_cell(np.repeat(np.arange(len(ids)), first.shape[1]), first.ravel())
    found = _probe(vectors, ids, unit, wanted, k, key, query_key, column, block)
    if exact and len(ids) and len(centres):
        # the k-th distance so far bounds the angle within which something nearer may lie
        found = _ranked(found, k, key, query_key)
        target = work_dir(spark, "index-first")
        found.write.parquet(target)
        found = spark.read.schema(found.schema).parquet(target)
        edge = {r[query_key]: r["edge"] for r in found.filter(F.col("rank") == k).select(query_key, F.col("distance").alias("edge")).collect()}
        limit = np.arccos(np.clip(1.0 - np.array([edge.get(i, 2.0) for i in ids]) - SLACK, -1, 1))
        reach = np.array([radius.get(c, -1.0) for c in range(len(centres))])
        for i in range(0, len(ids), step):
            lowest = np.arccos(np.clip(unit[i : i + step] @ middle.T, -1, 1)) - reach - SLACK
            more = (lowest <= limit[i : i + step, None] + SLACK) & (reach >= 0)
            np.put_along_axis(more, first[i : i + step].astype("int64"), False, axis=1)
            query, cell = more.nonzero()
            pairs.append(((query + i).astype("int32"), cell.astype("int32")))
        rest = _by_cell(*map(np.concatenate, zip(*pairs)))
        if rest:
            rest = _probe(vectors, ids, unit, rest, k, key, query_key, column, block)
            found = found.select(rest.columns).union(rest)
        else:
            found = found.drop("certainty", "rank")
    return _ranked(found, k, key, query_key)


def _ranked(found, k, key, query_key):
    rank = F.row_number().over(W.partitionBy(query_key).orderBy("distance", key))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select(query_key, key, "distance", certainty("distance").alias("certainty"), "rank")


def _by_cell(queries, cells) -> dict:
    """cell -> the numbers of the queries that want it, ascending."""
    import numpy as np

    order = np.lexsort((queries, cells))
    found, at = np.unique(cells[order], return_index=True)
    parts = np.split(queries[order].astype("int32"), at[1:]) if len(found) else []
    return dict(zip(found.tolist(), parts))


def _probe(vectors, ids, unit, wanted, k, key, query_key, column, block):
    """Each task's own k nearest of every query among the cells that the query wants."""
    cells = list(wanted)
    schema = T.StructType(
        [
            T.StructField(query_key, block.schema[query_key].dataType),
            T.StructField(key, vectors.schema[key].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, unit, wanted))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, unit, wanted = sent.value
        best = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            data, keys = _matrix(batch.column(1)), np.array(batch.column(0).to_pylist(), dtype=object)
            cell = batch.column(2).to_numpy()
            for c in np.unique(cell):
                own, every = np.flatnonzero(cell == c), wanted[c]
                step = max(1, CELLS // len(own))
                for start in range(0, len(every), step):
                    asked = every[start : start + step]
                    distances = np.round(1.0 - unit[asked] @ data[own].T, 12) + 0.0
                    for i, row in zip(asked.tolist(), distances):
                        if len(row) > k:
                            near = row <= np.partition(row, k - 1)[k - 1]
                            row, mine = row[near], keys[own][near]
                        else:
                            mine = keys[own]
                        both = [*best.get(i, []), *zip(row.tolist(), mine.tolist())]
                        best[i] = sorted(both)[:k]
        for i, pairs in best.items():
            yield pa.RecordBatch.from_pydict(
                {query_key: [ids[i]] * len(pairs), key: [p[1] for p in pairs], "distance": [p[0] for p in pairs]}, schema=arrow_schema
            )

    # a filter on the folder column: other cells are not read
    return vectors.filter(F.col("cell").isin(cells or [NO_CELL - 1])).select(key, column, "cell").mapInArrow(run, schema)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """Share of the exact neighbours that were found, one row."""
    hits = found.select(query_key, key).withColumn("_hit", F.lit(1))
    joined = exact.select(query_key, key).join(hits, [query_key, key], "left")
    return joined.agg(F.count(F.lit(1)).alias("neighbours"), F.count("_hit").alias("found"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))
