"""Vectors: embedding, search, dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import table
from catalog.registry import query
from tidemill.functions import vectors
from tidemill.operators import ann, compress, embed, search
from tidemill.session import work_dir


def _byte(digest: str, i: int) -> str:
    hexes = "'0123456789abcdef'"
    high = f"instr({hexes}, substr({digest}, {2 * i + 1}, 1)) - 1"
    low = f"instr({hexes}, substr({digest}, {2 * i + 2}, 1)) - 1"
    return f"(({high}) * 16 + {low})"


def _value(digest: str, i: int) -> str:
    return f"({_byte(digest, i % 32)} / 255.0 - 0.5)"


_TOTAL = " + ".join(_value("digest", i) for i in range(32))


def embedding_sql(dim: int, text: str = "text") -> str:
    """First eight values and the sum; the 32 values repeat dim / 32 times."""
    firsts = ", ".join(f"round({_value('digest', i)}, 6) AS v{i}" for i in range(8))
    return (
        f"SELECT doc_id, {firsts}, round(({_TOTAL}) * {dim // 32}, 4) + 0.0 AS total, "
        f"CAST({dim} AS INTEGER) AS dim "
        f"FROM (SELECT doc_id, sha256({text}) AS digest FROM documents)"
    )


def _shown(df, digits: int = 6):
    values = F.col("embedding")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select(
        "doc_id",
        *[F.round(values[i].cast("double"), digits).alias(f"v{i}") for i in range(8)],
        (F.round(total, 4) + 0.0).alias("total"),
        F.size(values).alias("dim"),
    )


@query("v1_hash_embedding", embedding_sql(1024))
def v1_hash_embedding(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return _shown(documents.withColumn("embedding", vectors.hash_embedding("text")))


# stored as float, so fewer places agree
_BATCH_SQL = (
    embedding_sql(64, "text")
    .replace(", 6) AS v", ", 5) AS v")
    .replace(", 4) + 0.0 AS total", ", 2) + 0.0 AS total")
)


@query("v2_batch_embed", _BATCH_SQL)
def v2_batch_embed(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    embedded = embed.embed_column(documents, embed.hash_embedder(64), "text")
    shown = _shown(embedded, 5)
    return shown.withColumn("total", F.round("total", 2) + 0.0)


# the queries: the mean vector of every label
_CENTROIDS = (
    "SELECT label AS query_id, list(m ORDER BY i) AS embedding FROM ("
    "SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, "
    "generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"
)
NEAREST_SQL = (
    "SELECT query_id, vec_id, round(distance, 6) AS distance, "
    "round(1 - distance / 2, 6) AS certainty, CAST(rank AS INTEGER) AS rank FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM ("
    "SELECT q.query_id, v.vec_id, round(1 - list_cosine_similarity("
    "q.embedding, CAST(v.embedding AS DOUBLE[])), 12) AS distance "
    f"FROM embeddings v, ({_CENTROIDS}) q)) WHERE rank <= 10"
)


def _nearest(spark, sf, **options):
    stored = table(spark, sf, "embeddings")
    queries = _centroids(stored)
    found = search.top_k(stored.select("vec_id", "embedding"), queries, 10, **options)
    return found.withColumns(
        {"distance": F.round("distance", 6), "certainty": F.round("certainty", 6)}
    )


@query("v3_top_k", NEAREST_SQL)
def v3_top_k(spark, sf):
    return _nearest(spark, sf)


@query("v3_top_k_blocks", NEAREST_SQL)
def v3_top_k_blocks(spark, sf):
    """The same with room for four queries at a time."""
    return _nearest(spark, sf, query_bytes=4 * 64 * 8)


def _floats(digest: str) -> str:
    return "[" + ", ".join(f"CAST(CAST({_value(digest, i)} AS FLOAT) AS DOUBLE)" for i in range(32)) + "]"


OBJECTS_SQL = (
    f"WITH d AS (SELECT doc_id, lang, source, {_floats('digest')} AS v FROM "
    "(SELECT *, sha256(coalesce(text, '')) AS digest FROM documents)), "
    f"q AS (SELECT n_nationkey AS query_id, {_floats('digest')} AS v FROM "
    "(SELECT *, sha256(n_name) AS digest FROM nation)), "
    "near AS (SELECT query_id, doc_id, lang, source, "
    "round(1 - list_cosine_similarity(q.v, d.v), 12) AS distance FROM d, q), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM near) "
    "SELECT query_id, doc_id, lang, source, round(distance, 6) AS distance, "
    "round(1 - distance / 2, 6) AS certainty, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"
)


@query("v3_search_objects", OBJECTS_SQL)
def v3_search_objects(spark, sf):
    """Texts in, stored objects out."""
    embedder = embed.hash_embedder(64)
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    objects = embed.embed_column(documents, embedder, "text").drop("text")
    asked = table(spark, sf, "nation").selectExpr("n_nationkey AS query_id", "n_name AS query")
    found = search.search_objects(objects, asked, embedder, 10, key="doc_id")
    return found.select(
        "query_id", "doc_id", "lang", "source", F.round("distance", 6).alias("distance"),
        F.round("certainty", 6).alias("certainty"), "rank",
    )


@query(
    "v4_dims",
    "SELECT CAST(min(len(embedding)) AS INTEGER) AS min_dim, "
    "CAST(max(len(embedding)) AS INTEGER) AS max_dim, "
    "count(*) FILTER (WHERE embedding IS NULL) AS missing FROM embeddings",
)
def v4_dims(spark, sf):
    return search.vector_dims(table(spark, sf, "embeddings"))


@query(
    "v5_query_embedding",
    "SELECT conv_id, turn, round("
    + _value("digest", 0)
    + ", 5) AS v0, CAST(64 AS INTEGER) AS dim FROM (SELECT conv_id, turn, "
    "sha256('query: ' || text) AS digest FROM conversations)",
)
def v5_query_embedding(spark, sf):
    plain = embed.hash_embedder(64)

    def embedder(texts, mode):
        return plain([f"{mode}: {text}" for text in texts], mode)

    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    embedded = embed.embed_queries(turns, embedder, "text")
    return embedded.select(
        "conv_id",
        "turn",
        F.round(F.col("embedding")[0].cast("double"), 5).alias("v0"),
        F.size("embedding").alias("dim"),
    )


def _centroids(stored):
    cells = stored.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))  # one entry per dimension
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered["m"].alias("embedding"))


@query("v3_index_exact", NEAREST_SQL)
def v3_index_exact(spark, sf):
    """The nearest from an inverted-file index, other cells read only where they may hold nearer ones."""
    stored, path = table(spark, sf, "embeddings"), work_dir(spark, "vector-index")
    ann.build_index(stored.select("vec_id", "embedding"), path)
    found = ann.search_index(spark, path, _centroids(stored), 10, probes=2, exact=True)
    return found.withColumns(
        {"distance": F.round("distance", 6), "certainty": F.round("certainty", 6)}
    )


@query(
    "v3_index_recall",
    "SELECT 10 * count(*) AS neighbours, true AS reached FROM embeddings WHERE vec_id % 100 = 0",
)
def v3_index_recall(spark, sf):
    """Every hundredth vector as a query against all: the cells that the build found necessary, held against the exact search."""
    stored, path = table(spark, sf, "embeddings").select("vec_id", "embedding"), work_dir(spark, "vector-index")
    asked = stored.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    ann.build_index(stored, path)
    exact = search.top_k(stored, asked, 10)
    measured = ann.recall(ann.search_index(spark, path, asked, 10), exact)
    return measured.select("neighbours", (F.col("recall") >= 0.95).alias("reached"))


@query(
    "v3_without_direction",
    "SELECT count(*) AS rows, count(*) FILTER (WHERE embedding IS NULL) AS missing, "
    "count(*) FILTER (WHERE list_dot_product(embedding, embedding) = 0) AS zero, "
    "CAST(0 AS BIGINT) AS not_finite FROM embeddings",
)
def v3_without_direction(spark, sf):
    """What no search can find is counted."""
    return ann.without_direction(table(spark, sf, "embeddings"))


@query(
    "s9_compressed",
    "SELECT count(*) AS num_records, CAST(0 AS BIGINT) AS without_code, max(len(embedding))::INTEGER AS dimensions, "
    "16 AS code_bytes, true AS smaller, count(*) FILTER (WHERE vec_id % 100 = 0) * 10 AS neighbours, true AS reached "
    "FROM embeddings",
)
def s9_compressed(spark, sf):
    """A snapshot of codes beside the vectors; every hundredth vector as a query against all, held against the exact search."""
    stored, path = table(spark, sf, "embeddings").select("vec_id", "embedding"), work_dir(spark, "compressed")
    written = compress.write_compressed(stored, path, "vec_id")
    asked = stored.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = compress.search_compressed(spark, path, asked, 10, key="vec_id")
    measured = ann.recall(found, search.top_k(stored, asked, 10))
    shown = ["num_records", "without_code", "dimensions", "code_bytes"]
    sizes = written.select(*shown, (F.col("codes_mb") < F.col("vectors_mb")).alias("smaller"), F.lit(1).alias("_one"))
    recalled = measured.select("neighbours", (F.col("recall") >= 0.9).alias("reached"), F.lit(1).alias("_one"))
    return sizes.join(recalled, "_one").drop("_one")
