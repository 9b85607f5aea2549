"""Product quantisation: a snapshot of vectors as short codes beside the vectors themselves.

A vector is cut into parts, and each part is replaced by the number of the nearest of at most
256 words, one byte. The words of a part come from k-means on a bounded sample, every part in a
task of its own; all rows are coded. Searches rank decoded vectors and then look up the exact
vectors of the best few.

Defined results: vectors that are null, or hold a value that is no number, have no code and are
counted. Vectors of another size than the others are refused. Equal vectors have equal codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.operators.ann import _finite
from tidemill.operators.search import top_k
from tidemill.session import path_size

SAMPLE_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class CodeSettings:
    parts: int = 16  # bytes of a code
    words: int = 256  # of each part, at most 256
    train_rows: int = 20_000  # words are fitted on at most so many vectors
    rounds: int = 12
    seed: int = 0


def _cut(values: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width), filled up with zeros."""
    width = -(-values.shape[1] // parts)
    padded = np.zeros((len(values), parts * width))
    padded[:, : values.shape[1]] = values
    return padded.reshape(len(values), parts, width)


def _nearest_word(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2.0 * points @ words.T, axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "float64").reshape(-1, dim)


def fit_words(vectors: DataFrame, key: str, column: str, n: int, dim: int, s: CodeSettings) -> list[np.ndarray]:
    """The words of every part, from a hash sample of bounded size."""
    spark = vectors.sparkSession
    rows = min(s.train_rows, max(s.words, SAMPLE_BYTES // (8 * dim)))
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(s.seed)), F.lit(1 << 40))
    share = min(1.0, 1.5 * rows / max(1, n))
    sample = vectors.filter(draw <= int(share * (1 << 40))).orderBy(draw, column).limit(rows)
    width = -(-dim // s.parts)
    slices = [
        F.struct(F.lit(p).alias("part"), F.slice(F.col(column).cast("array<double>"), p * width + 1, width).alias("piece"))
        for p in range(s.parts)
    ]
    pieces = sample.select(F.inline(F.array(*slices)))

    def fit(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        points = np.zeros((table.num_rows, width))
        for i, piece in enumerate(table.column("piece").to_pylist()):
            points[i, : len(piece)] = piece
        points = points[np.lexsort(points.T)]
        distinct = np.unique(points, axis=0)
        pick = np.random.default_rng(s.seed + part).permutation(len(distinct))[: s.words]
        words = distinct[pick]
        for _ in range(s.rounds):
            nearest = _nearest_word(points, words)
            sizes = np.bincount(nearest, minlength=len(words))
            sums = np.zeros_like(words)
            np.add.at(sums, nearest, points)
            words[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
        return pa.table({"part": pa.array([part] * len(words), pa.int32()), "words": pa.array(words.tolist(), pa.list_(pa.float64()))})

    # at most `parts` times `words` rows
    found = pieces.groupBy("part").applyInArrow(fit, "part int, words array<double>").collect()
    return [np.array([r["words"] for r in found if r["part"] == p]).reshape(-1, width) for p in range(s.parts)]


def encode(vectors: DataFrame, key: str, column: str, words: list[np.ndarray], dim: int) -> DataFrame:
    """(key, code, error, length): a byte per part, the squared distance to the decoded vector, the squared length."""
    rows = vectors.select(key, F.when(_finite(column), F.col(column).cast("array<double>")).alias("_v"))
    kind = rows.schema[key].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = batch.column("_v").is_valid().to_numpy(zero_copy_only=False)
            cut = _cut(_matrix(batch.column("_v").drop_null(), dim), len(words))
            codes = np.stack([_nearest_word(cut[:, p], w) for p, w in enumerate(words)], axis=1).astype(np.uint8)
            decoded = np.stack([w[codes[:, p]] for p, w in enumerate(words)], axis=1)
            errors, lengths = ((x * x).sum(axis=(1, 2)) for x in (cut - decoded, cut))
            at = np.cumsum(filled) - 1
            spread = lambda values: [values(i) if f else None for i, f in zip(at, filled)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array(spread(lambda i: codes[i].tobytes()), pa.binary()),
                    pa.array(spread(lambda i: float(errors[i])), pa.float64()), pa.array(spread(lambda i: float(lengths[i])), pa.float64()),
                ],
                names=[key, "code", "error", "length"],
            )

    return rows.mapInArrow(code, f"`{key}` {kind}, code binary, error double, length double")


def write_compressed(
    df: DataFrame, path: str, key: str = "reference", column: str = "embedding", settings: CodeSettings | None = None
) -> DataFrame:
    """Write vectors, codes and words below `path`; a one-row frame of counts, sizes and distortion.

    `distortion` is the mean squared error as a share of the mean squared length.
    """
    s, spark = settings or CodeSettings(), df.sparkSession
    if not 1 <= s.words <= 256:
        raise ValueError("a byte numbers 1 to 256 words")
    df.select(key, column).write.parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    usable = stored.filter(_finite(column))
    size = F.size(column)
    seen = usable.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("dim")).first()
    if seen["least"] != seen["dim"]:
        raise ValueError(f"{column}: sizes {seen['least']} to {seen['dim']}")
    n, dim = seen["n"], seen["dim"] or 0
    words = fit_words(usable, key, column, n, dim, s) if n else []
    listed = [(dim, p, i, row.tolist()) for p, w in enumerate(words) for i, row in enumerate(w)]
    spark.createDataFrame(listed, "dim int, part int, word int, centre array<double>").coalesce(1).write.parquet(f"{path}/words")
    if n:
        codes = encode(stored, key, column, words, dim)
    else:
        codes = stored.select(key, F.lit(None).cast("binary").alias("code"), *(F.lit(None).cast("double").alias(c) for c in ("error", "length")))
    codes.write.parquet(f"{path}/codes")
    mb = lambda name: F.lit(path_size(spark, f"{path}/{name}") / 1024 / 1024)
    return spark.read.parquet(f"{path}/codes").agg(
        F.count(F.lit(1)).alias("num_records"), F.count_if(F.col("code").isNull()).alias("without_code"),
        F.lit(dim).alias("dimensions"), F.max(F.length("code")).alias("code_bytes"), mb("vectors").alias("vectors_mb"),
        mb("codes").alias("codes_mb"), (F.avg("error") / F.nullif(F.avg("length"), F.lit(0.0))).alias("distortion"),
    )


def read_compressed(spark: SparkSession, path: str, key: str = "reference", column: str = "embedding") -> DataFrame:
    """(key, vector) decoded from the codes; null where there is none."""
    table = spark.read.parquet(f"{path}/words").orderBy("part", "word").collect()  # 256 rows a part at most
    codes = spark.read.parquet(f"{path}/codes").select(key, "code")
    kind = spark.read.parquet(f"{path}/vectors").schema[column]
    if not table:
        return codes.select(key, F.lit(None).cast(kind.dataType).alias(column))
    dim = table[0]["dim"]
    words = [np.array([r["centre"] for r in table if r["part"] == p]) for p in range(table[-1]["part"] + 1)]
    schema = codes.select(key, F.lit(None).cast(kind.dataType).alias(column)).schema
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for code in batch.column("code").to_pylist():
                pieces = [w[b] for w, b in zip(words, code)] if code is not None else None
                values.append(np.concatenate(pieces)[:dim].tolist() if pieces else None)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(values, arrow.field(column).type)], names=[key, column])

    return codes.mapInArrow(decode, schema)


def search_compressed(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 10, wide: int = 10, key: str = "reference",
    query_key: str = "query_id", column: str = "embedding",
) -> DataFrame:
    """(query_key, key, distance, rank): the best `k` by exact distance of the k * `wide` best by decoded vectors."""
    near = top_k(read_compressed(spark, path, key, column), queries, k * wide, key, query_key, column).select(query_key, key)
    exact = spark.read.parquet(f"{path}/vectors").select(key, F.col(column).cast("array<double>").alias("_v"))
    asked = queries.select(query_key, F.col(column).cast("array<double>").alias("_q"))
    pairs = near.join(exact, key).join(asked, query_key)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    distance = F.round(1.0 - dot("_v", "_q") / F.sqrt(dot("_v", "_v") * dot("_q", "_q")), 12)
    ranked = pairs.select(query_key, key, distance.alias("distance"))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy("distance", key))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k)
