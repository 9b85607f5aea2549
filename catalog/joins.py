"""Joins of documents with their label, summary and vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import DOCS, JOINED, RAW, RESULTS, SUMMARIES, table
from catalog.registry import query, sql_with
from tidemill.functions import fixed, vectors
from tidemill.operators import clean, product, skew

# what is left of the results once only labelled documents count: misses become visible
_LABELLED = "labelled AS (SELECT * FROM results WHERE _llm_status = 'success')"
_LONG_SUMMARIES = "good AS (SELECT * FROM summaries WHERE _llm_status = 'success')"
_LABELS = ", ".join(f"l.{name}" for name in fixed.LABEL_FIELDS)


def cleaned(spark, sf):
    return clean.clean_documents(inputs.raw_documents(spark, sf))


def heavy(spark, sf):
    """Heavy references, looked for where they cost one narrow column, not the texts."""
    return skew.heavy_keys(inputs.raw_documents(spark, sf).select("reference"), "reference")


def labelled(spark, sf):
    return inputs.label_results(spark, sf).filter(F.col("_llm_status") == "success")


def good_summaries(spark, sf):
    return inputs.summary_results(spark, sf).filter(F.col("_llm_status") == "success")


@query(
    "j1_summary_join",
    sql_with(
        [*DOCS, SUMMARIES, _LONG_SUMMARIES],
        "SELECT c.*, g.summary FROM cleaned c LEFT JOIN good g ON c.reference = g.reference",
    ),
)
def j1_summary_join(spark, sf):
    return product.join_summaries(
        cleaned(spark, sf), good_summaries(spark, sf), heavy=heavy(spark, sf)
    )


@query(
    "j2_label_join",
    sql_with(
        [*DOCS, JOINED, RESULTS, _LABELLED],
        "SELECT c.*, CAST(l.monetary_stance AS TINYINT) AS monetary_stance, "
        "CAST(l.trade_stance AS TINYINT) AS trade_stance, "
        "CAST(l.tariff_mention AS TINYINT) AS tariff_mention, "
        "CAST(l.economic_outlook AS TINYINT) AS economic_outlook, "
        "l._llm_status, l._llm_error, l._llm_attempts, l._llm_fallback_used "
        "FROM cleaned c LEFT JOIN labelled l ON c.reference = l.reference",
    ),
)
def j2_label_join(spark, sf):
    return product.join_labels(
        cleaned(spark, sf), labelled(spark, sf), heavy=heavy(spark, sf)
    )


PRODUCT_SQL = (
    "product AS (SELECT c.*, "
    + _LABELS
    + ", l._llm_status AS _llm_status_class, l._llm_error AS _llm_error_class, "
    "l._llm_attempts AS _llm_attempts_class, l._llm_fallback_used AS _llm_fallback_class, "
    "s.summary, s._llm_status AS _llm_status_summary, s._llm_error AS _llm_error_summary, "
    "s._llm_attempts AS _llm_attempts_summary, s._llm_fallback_used AS _llm_fallback_summary, "
    f"'{inputs.RUN_TIME}' AS processed_at "
    "FROM cleaned c LEFT JOIN results l ON c.reference = l.reference "
    "LEFT JOIN summaries s ON c.reference = s.reference)"
)
PRODUCT = [*DOCS, JOINED, RESULTS, SUMMARIES, PRODUCT_SQL]


def document_product(spark, sf):
    """The product, put together from documents that already carry an old summary copy."""
    documents = cleaned(spark, sf).withColumn("summary", F.lit("old copy"))
    return product.assemble_product(
        documents,
        inputs.label_results(spark, sf),
        inputs.summary_results(spark, sf),
        inputs.RUN_TIME,
        heavy=heavy(spark, sf),
    )


@query("j3_product", sql_with(PRODUCT, "SELECT * FROM product"))
def j3_product(spark, sf):
    return document_product(spark, sf)


@query(
    "j4_index_join",
    sql_with(
        [*DOCS, JOINED, RESULTS, _LABELLED],
        f"SELECT c.*, {_LABELS} FROM cleaned c "
        "LEFT JOIN labelled l ON c.reference = l.reference",
    ),
)
def j4_index_join(spark, sf):
    return product.join_index_labels(
        cleaned(spark, sf), labelled(spark, sf), heavy=heavy(spark, sf)
    )


@query(
    "j5_vector_align",
    sql_with(
        [RAW],
        "SELECT r.reference, e.embedding IS NOT NULL AS stored, "
        "round(coalesce(CAST(e.embedding[1] AS DOUBLE), "
        "((instr('0123456789abcdef', substr(sha256(r.title), 1, 1)) - 1) * 16 + "
        "instr('0123456789abcdef', substr(sha256(r.title), 2, 1)) - 1) / 255.0 - 0.5), 6) "
        "AS first_value, CAST(64 AS INTEGER) AS dim "
        "FROM raw r LEFT JOIN embeddings e ON r.doc_id = e.vec_id",
    ),
)
def j5_vector_align(spark, sf):
    raw = inputs.raw_documents(spark, sf).select("doc_id", "reference", "title")
    stored = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS doc_id", "CAST(embedding AS array<double>) AS embedding"
    )
    known = stored.select("doc_id", F.lit(True).alias("stored"))
    aligned = product.align_vectors(raw, stored, vectors.hash_embedding("title", 64), "doc_id")
    return aligned.join(known, "doc_id", "left").select(
        "reference",
        F.coalesce("stored", F.lit(False)).alias("stored"),
        F.round(F.col("embedding")[0], 6).alias("first_value"),
        F.size("embedding").alias("dim"),
    )


@query(
    "j6_remaining",
    "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def j6_remaining(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return skew.anti_join(documents, table(spark, sf, "labels"), "doc_id")


@query(
    "j_duplicate_keys",
    "SELECT l_partkey, count(*) AS rows FROM lineitem GROUP BY l_partkey HAVING count(*) > 1",
)
def j_duplicate_keys(spark, sf):
    return product.duplicate_keys(table(spark, sf, "lineitem"), "l_partkey")


@query(
    "j_split_heavy_keys",
    "SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, s.s_name FROM lineitem l "
    "LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey",
)
def j_split_heavy_keys(spark, sf):
    """The salted join: with a low threshold here, so that keys really are split."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_name")
    return skew.left_joins(lines, [suppliers], "l_suppkey", min_rows=100)
