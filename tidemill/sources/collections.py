"""Vector collections as Parquet tables: properties and an embedding per row.

Loads append files. Replaced and deleted objects are not looked for: a change is a small folder
of new rows or of keys below `_changes`, whose log entry gives it its place in the order, and
readers fold the changes into the rows. The stored rows are only read, never rewritten,
until `compact_collection` writes the folded rows once and a log entry lets readers begin there.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.product import duplicate_keys
from tidemill.operators.search import require_one_dim
from tidemill.operators.skew import anti_join
from tidemill.session import PARQUET, delete_path, move_path, path_exists
from tidemill.sources import atomic

# Property names and kinds of the two collections.
DOCUMENT_PROPERTIES = {
    "reference": "text",
    "date": "text",
    "central_bank": "text",
    "speaker": "text",
    "title": "text",
    "text": "text",
    "monetary_stance": "int",
    "trade_stance": "int",
    "tariff_mention": "boolean",
    "economic_outlook": "int",
    "is_governor": "boolean",
}
TWIN_PROPERTIES = {
    "reference": "text",
    "date": "text",
    "country": "text",
    "author": "text",
    "title": "text",
    "summary": "text",
    "monetary_stance": "int",
    "trade_stance": "int",
    "tariff_mention": "boolean",
    "economic_outlook": "int",
    "is_gov": "boolean",
    "is_synthetic": "boolean",
}

SPARK_KINDS = {
    "text": T.StringType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "number": T.DoubleType(),
    "date": T.DateType(),
}


def property_kind(kind: T.DataType) -> str:
    """Collection kind of a column type; what has no own kind is text."""
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "number"
    return "text"


def infer_properties(df: DataFrame) -> dict[str, str]:
    return {field.name: property_kind(field.dataType) for field in df.schema.fields}


def describe_properties(df: DataFrame) -> DataFrame:
    """property, kind and in how many rows it is filled, one row per column."""
    kinds = infer_properties(df)
    each = [
        F.struct(F.lit(name).alias("property"), F.lit(kind).alias("kind"), F.count(name).alias("filled"))
        for name, kind in kinds.items()
    ]
    return df.agg(F.array(*each).alias("rows")).select(F.inline("rows"))


def collection_schema(
    properties: dict[str, str], comments: dict[str, str] | None = None
) -> T.StructType:
    """Declared properties and the vector, descriptions kept as column comments."""
    notes = comments or {}
    fields = [
        T.StructField(
            name, SPARK_KINDS[kind], True, {"comment": notes[name]} if name in notes else {}
        )
        for name, kind in properties.items()
    ]
    return T.StructType([*fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])


def ensure_collection(
    spark: SparkSession, path: str, properties: dict[str, str], comments=None
) -> bool:
    """Create an empty collection; one that is there already is left alone."""
    if path_exists(spark, path):
        return False
    schema = collection_schema(properties, comments)
    spark.createDataFrame([], schema).coalesce(1).write.parquet(path)
    return True


def load_collection(
    objects: DataFrame,
    path: str,
    key: str = "reference",
    mode: str = "idempotent",
    dim: int | None = None,
    heavy: dict | None = None,
) -> dict:
    """Add objects with their `embedding`; every row needs a vector and all have one size.

    `idempotent` adds only keys that are not there, `append` adds all rows again on a
    rerun, `replace` puts the new row in the place of a stored one with its key,
    `overwrite` replaces the collection. Except with `append`, a key that the load holds
    twice counts once, with the row of the largest digest. A caller that knows the size
    gives it as `dim`; vectors that are null or of another size are refused all the same.
    `heavy` is as in `anti_join`.
    """
    spark = objects.sparkSession
    if dim is None:
        dim = require_one_dim(objects)
    elif not objects.filter(~F.coalesce(F.size("embedding") == dim, F.lit(False))).isEmpty():
        raise ValueError(f"every object needs a vector of size {dim}")
    rows = objects.withColumn("embedding", F.col("embedding").cast("array<float>"))
    if mode != "append":
        rows = one_per_key(rows, key)
    changed = False
    if mode != "overwrite" and path_exists(spark, path):
        stored = read_collection(spark, path)
        changed = bool(atomic.numbers(spark, _log(path)))
        rows = rows.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored.schema.fields]
        )
        if mode == "idempotent" and not stored.isEmpty():
            rows = anti_join(rows, stored, key, heavy=heavy)
        changed |= mode == "replace"
    if changed:
        _change(spark, path, "put" if mode == "replace" else "add", key, rows)
    else:
        rows.write.options(**PARQUET).mode("overwrite" if mode == "overwrite" else "append").parquet(path)
    return {"collection": path, "object_count": count_objects(spark, path), "vector_dimensions": dim}


def place_objects(
    staged: str, path: str, spark: SparkSession, key: str = "reference", mode: str = "overwrite", dim: int | None = None,
    heavy: dict | None = None,
) -> dict:
    """`load_collection` of objects that are written already: their folder is moved into place.

    A key that they hold twice, other columns than the collection has, or objects that it
    holds already, unless they are overwritten, make it a load like any other.
    """
    objects = spark.read.parquet(staged)
    ready = objects.schema["embedding"].dataType == T.ArrayType(T.FloatType()) and duplicate_keys(objects, key).isEmpty()
    if mode != "overwrite" and path_exists(spark, path):
        kept = read_collection(spark, path)
        ready &= kept.dtypes == objects.dtypes and kept.isEmpty() and not atomic.numbers(spark, _log(path))
    if not ready:
        found = load_collection(objects, path, key, mode=mode, dim=dim, heavy=heavy)
        delete_path(spark, staged)
        return found
    if dim is None:
        dim = require_one_dim(objects)
    elif not objects.filter(~F.coalesce(F.size("embedding") == dim, F.lit(False))).isEmpty():
        raise ValueError(f"every object needs a vector of size {dim}")
    move_path(spark, staged, path)
    return {"collection": path, "object_count": count_objects(spark, path), "vector_dimensions": dim}


def delete_objects(keys: DataFrame, path: str, key: str = "reference") -> int:
    """Delete the objects with these keys; writes the keys only. The number of its change."""
    return _change(keys.sparkSession, path, "delete", key, keys.select(key).distinct())


def compact_collection(spark: SparkSession, path: str) -> int:
    """Write the folded rows once; readers begin there. Changes that come meanwhile stay changes.

    Files from before are left for readers that still use them; `drop_folded` removes them.
    """
    found = atomic.numbers(spark, _log(path))
    if not found:
        return 0
    folder = f"{path}/_changes/{uuid.uuid4().hex}"
    read_collection(spark, path, found[-1]).write.options(**PARQUET).parquet(folder)
    return _enter(spark, path, {"kind": "base", "folder": folder, "covers": found[-1]})


def drop_folded(spark: SparkSession, path: str) -> int:
    """Remove the folders of changes that a compacted base covers; how many."""
    entries, base = _since_base(spark, path)
    kept = {entry["folder"] for entry in [*entries, *([base] if base else [])]}
    old = {e["folder"] for e in atomic.read_entries(spark, _log(path), atomic.numbers(spark, _log(path)))} - kept
    return sum(delete_path(spark, folder) for folder in old)


def _log(path: str) -> str:
    return f"{path}/_changes/log"


def _change(spark: SparkSession, path: str, kind: str, key: str, rows: DataFrame) -> int:
    folder = f"{path}/_changes/{uuid.uuid4().hex}"
    rows.write.options(**PARQUET).parquet(folder)
    return _enter(spark, path, {"kind": kind, "folder": folder, "key": key})


def _enter(spark: SparkSession, path: str, entry: dict) -> int:
    while True:
        found = atomic.numbers(spark, _log(path))
        number = found[-1] + 1 if found else 1
        if atomic.append_entry(spark, _log(path), entry, number):
            return number


def _since_base(spark: SparkSession, path: str, upto: int | None = None) -> tuple[list[dict], dict | None]:
    """Changes that are not folded yet, and the newest compacted base."""
    found = [n for n in atomic.numbers(spark, _log(path)) if upto is None or n <= upto]
    entries = atomic.read_entries(spark, _log(path), found)
    bases = [entry for entry in entries if entry["kind"] == "base"]
    base = max(bases, key=lambda entry: entry["covers"]) if bases else None
    covered = base["covers"] if base else 0
    return [e for e in entries if e["kind"] != "base" and e["seq"] > covered], base


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: of several the one with the largest digest. Rows move only if there are some."""
    if duplicate_keys(rows, key).isEmpty():
        return rows
    chosen = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("_row"))
    return chosen.select("_row.*")


def load_pair(objects: DataFrame, vectors: DataFrame, path: str, key: str = "reference", **options):
    """The same from two tables that must hold the same number of rows."""
    left, right = objects.count(), vectors.count()
    if left != right:
        raise ValueError(f"DataFrame has {left} rows but got {right} embeddings")
    paired = objects.join(vectors.select(key, "embedding"), key, "left")
    return load_collection(paired, path, key, **options)


def read_collection(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The objects as of now, or as of change number `upto`.

    Of a key that changes touch, rows count from its last change on. Only rows of
    changes are grouped; the stored rows meet the touched keys in one join, broadcast if
    Spark finds the keys small enough.
    """
    changes, base = _since_base(spark, path, upto)
    stored = spark.read.parquet(base["folder"] if base else path)
    if not changes:
        return stored
    tables = [(e, spark.read.parquet(e["folder"])) for e in changes]
    added = [df.select(*stored.columns, F.lit(e["seq"]).alias("_seq")) for e, df in tables if e["kind"] != "delete"]
    rows = reduce(DataFrame.union, added, stored.withColumn("_seq", F.lit(0)))
    key = changes[0]["key"]
    if any(e["key"] != key for e in changes):
        raise ValueError(f"{path}: changes by several keys; compact between them")
    touching = [df.select(F.col(key).alias("_key"), F.lit(e["seq"]).alias("_last")) for e, df in tables if e["kind"] != "add"]
    if not touching:
        return rows.drop("_seq")
    touched = reduce(DataFrame.union, touching).groupBy("_key").agg(F.max("_last").alias("_last"))
    joined = rows.join(touched, rows[key].eqNullSafe(touched["_key"]), "left")
    return joined.filter("_last IS NULL OR _seq >= _last").select(*stored.columns)


def count_objects(spark: SparkSession, path: str) -> int:
    return read_collection(spark, path).count() if path_exists(spark, path) else 0


def delete_collection(spark: SparkSession, path: str) -> bool:
    return delete_path(spark, path)
