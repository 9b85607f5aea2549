"""The whole jobs, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.answers import SUMMARY_OBJECT_SQL, STRICT_SQL
from catalog.inputs import SUMMARY_REPLIES
from catalog.registry import query, sql_with
from catalog.rows import CLEAN_CUSTOMERS, CUSTOMERS, customers
from catalog.joins import PRODUCT
from catalog.twins import GUESS_SQL, LEAK_MATCH, LEAK_SQL, MARGINAL_SQL, NUMERIC, TWIN_SQL
from tidemill.config import RunOptions, TRIAL_RUN, Layout
from tidemill.functions import masks, vectors
from tidemill.operators import parsing, scoring
from tidemill.plans import customers as customer_job
from tidemill.plans import documents as document_job
from tidemill.plans import twins as twin_job
from tidemill.session import work_dir
from tidemill.sources import files
from tidemill.sources.versions import Repository


def _steps(spark, sf) -> document_job.DocumentSteps:
    """Replies come from the prepared tables; a model would fill the same columns.

    Label replies are read where they lie, so that only what they say meets the documents.
    """

    def replied(rows, replies):
        return rows.join(replies.select("doc_id", "reply"), "doc_id", "left")

    def labelled(rows):
        said = parsing.parse_labels(inputs.label_replies(spark, sf).select("doc_id", "reply"), "reply", "_said")
        none = parsing.parse_labels(rows.select("doc_id", document_job.KEY, F.lit(None).cast("string").alias("reply")), "reply", "_parsed")
        met = none.join(said.select("doc_id", "_said"), "doc_id", "left").withColumn("_parsed", F.coalesce("_said", "_parsed"))
        return scoring.settle_parsed(met.select(document_job.KEY, "_parsed"), "_parsed", scoring.label_fallbacks())

    return document_job.DocumentSteps(
        label=labelled,
        summary=lambda rows: document_job.summary_replies(
            replied(rows, inputs.summary_replies(spark, sf))
        ),
        embed=lambda rows: rows.withColumn("embedding", vectors.hash_embedding("embed_text", 64)),
    )


def _run(spark, sf, options):
    layout = Layout(work_dir(spark, "documents"))
    raw = inputs.raw_documents(spark, sf)
    answer = document_job.run_documents(
        raw, _steps(spark, sf), layout, inputs.RUN_TIME, options, log=lambda line: None
    )
    return answer, layout


_STRICT = f"strict AS ({STRICT_SQL})"
_JOB = [
    inputs.RAW,
    inputs.CLEAN,
    _STRICT,
    *SUMMARY_REPLIES,
    SUMMARY_OBJECT_SQL,
    "sums AS (SELECT doc_id, CASE WHEN length(trim(summary)) < 50 THEN NULL "
    "ELSE summary END "
    "AS summary FROM objects)",
    "job AS (SELECT c.reference, c.date, c.central_bank, c.speaker, c.title, c.is_gov, coalesce(s.monetary_stance, 3) "
    "AS monetary_stance, coalesce(s.trade_stance, 3) AS trade_stance, "
    "coalesce(s.tariff_mention, 0) AS tariff_mention, "
    "coalesce(s.economic_outlook, 3) AS economic_outlook, "
    "CASE WHEN s.error IS NULL THEN 'success' ELSE 'failed' END AS _llm_status_class, "
    "coalesce(u.summary, '* Topic: ' || substring(coalesce(nullif(c.title, ''), 'Untitled'), 1, "
    "100) || chr(10) || '* Speaker: ' || coalesce(nullif(c.speaker, ''), 'Unknown') || chr(10) || "
    "'* Bank: ' || coalesce(nullif(c.central_bank, ''), 'Unknown')) AS summary, "
    "CASE WHEN u.summary IS NULL THEN 'failed' ELSE 'success' END AS _llm_status_summary, "
    f"'{inputs.RUN_TIME}' AS processed_at FROM cleaned c JOIN strict s ON c.doc_id = s.doc_id "
    "JOIN sums u ON c.doc_id = u.doc_id)",
]
_SHOWN = [
    "reference",
    "title",
    "is_gov",
    "monetary_stance",
    "trade_stance",
    "tariff_mention",
    "economic_outlook",
    "_llm_status_class",
    "summary",
    "_llm_status_summary",
    "processed_at",
]


@query("pl1_document_product", sql_with(_JOB, f"SELECT {', '.join(_SHOWN)} FROM job"))
def pl1_document_product(spark, sf):
    answer, _ = _run(spark, sf, RunOptions())
    return files.read_product(spark, answer["product"]).select(*_SHOWN)


@query(
    "pl1_document_counts",
    sql_with(
        _JOB,
        "SELECT count(*) AS num_records, count(*) FILTER (WHERE tariff_mention = 1) "
        "AS tariff_mentions, count(*) FILTER (WHERE is_gov) AS governor_speeches, "
        "count(*) AS object_count, CAST(64 AS BIGINT) AS vector_dimensions FROM job",
    ),
)
def pl1_document_counts(spark, sf):
    answer, _ = _run(spark, sf, RunOptions())
    names = [
        "num_records",
        "tariff_mentions",
        "governor_speeches",
        "object_count",
        "vector_dimensions",
    ]
    return spark.createDataFrame(
        [tuple(answer[n] for n in names)], ", ".join(f"{n} bigint" for n in names)
    )


@query(
    "pl4_trial_product",
    sql_with(
        _JOB,
        f"SELECT {', '.join(_SHOWN)} FROM job WHERE reference IN "
        "(SELECT reference FROM raw ORDER BY reference LIMIT 10)",
    ),
)
def pl4_trial_product(spark, sf):
    answer, _ = _run(spark, sf, TRIAL_RUN)
    return files.read_product(spark, answer["product"]).select(*_SHOWN)


# the twin's own subqueries, on the product of this job
def _masked_sql(column: str) -> str:
    for kind, pattern in inputs.IDENTIFIERS.items():
        column = f"regexp_replace({column}, '{pattern}', '[{kind.upper()}]', 'g')"
    return column


_TWIN = [
    *_JOB,
    f"product AS (SELECT * REPLACE ({_masked_sql('title')} AS title, "
    f"{_masked_sql('summary')} AS summary) FROM job)",
    *TWIN_SQL[len(PRODUCT) :],
]
_ALL = ["date", "country", "author", "title", *NUMERIC, "tariff_mention", "is_gov", "summary"]
_LEAK = LEAK_SQL.replace(LEAK_MATCH, " AND ".join(f"t.{c} IS NOT DISTINCT FROM s.{c}" for c in _ALL))


@query(
    "pl2_twin_report",
    sql_with(
        [*_TWIN, _LEAK, GUESS_SQL, MARGINAL_SQL],
        "SELECT (SELECT count(*) FROM twin) AS num_records, "
        "(SELECT count(*) FROM twin) AS object_count, CAST(64 AS BIGINT) AS dimensions, "
        "round(1 - leaked_rows / twin_rows, 5) AS mia_score, "
        "round(1 - guessed_rows / real_rows, 5) AS aia_score, "
        "round(1 - (SELECT avg(distance) FROM gaps), 5) AS quality_score FROM leak, guesses",
    ),
)
def pl2_twin_report(spark, sf):
    """The twin of the finished product: sizes and scores of the job."""
    report, _ = _twin(spark, sf)
    names = ["num_records", "object_count", "dimensions"]
    scores = ["mia_score", "aia_score", "quality_score"]
    row = tuple(report[n] for n in names) + tuple(round(report[n], 5) for n in scores)
    schema = ", ".join([f"{n} bigint" for n in names] + [f"{n} double" for n in scores])
    return spark.createDataFrame([row], schema)


@query("pl2_twin_rows", sql_with(_TWIN, f"SELECT *, '{inputs.RUN_TIME}' AS generated_at FROM twin"))
def pl2_twin_rows(spark, sf):
    report, layout = _twin(spark, sf)
    return Repository(spark, layout.twin("versions")).read("documents", report["commit_id"])


def _twin(spark, sf):
    answer, layout = _run(spark, sf, RunOptions())
    embed = lambda rows: rows.withColumn(
        "embedding", vectors.hash_embedding("embed_text", 64)
    )
    product = files.read_product(spark, answer["product"])
    report = twin_job.run_twin(product, embed, layout, inputs.RUN_TIME, log=lambda line: None)
    return report, layout


@query(
    "pl3_customer_report",
    sql_with(
        [
            CUSTOMERS,
            CLEAN_CUSTOMERS,
            "counted AS (SELECT region, count(*) AS n FROM clean_customers "
            "WHERE region IS NOT NULL GROUP BY region)",
        ],
        "SELECT count(*) AS total_records, CAST(printf('%.2f', avg(spend)) AS DOUBLE) "
        "AS average_spend, CAST(10 AS BIGINT) AS enriched_count, "
        "count(*) FILTER (WHERE tier = 'Low Value') AS low, "
        "count(*) FILTER (WHERE tier = 'Medium Value') AS medium, "
        "count(*) FILTER (WHERE tier = 'High Value') AS high, "
        "(SELECT count(*) FROM counted) AS regions, "
        "CAST((SELECT sum(n) FROM counted) AS BIGINT) AS in_regions FROM clean_customers",
    ),
)
def pl3_customer_report(spark, sf):
    def profile(sampled):
        return sampled.select(
            "id",
            F.concat(F.lit("Buys "), F.col("category")).alias("ai_profile"),
            F.lit(None).cast("string").alias("error"),
        )

    folder = work_dir(spark, "customers")
    customer_job.run_customers(customers(spark, sf), profile, folder)
    report = files.read_report(spark, folder)
    tiers, regions = report["tier_distribution"], report["region_distribution"]
    row = (
        report["total_records"],
        report["average_spend"],
        report["enriched_count"],
        *[tiers.get(f"{name} Value", 0) for name in ("Low", "Medium", "High")],
        len(regions),
        sum(regions.values()),
    )
    schema = (
        "total_records bigint, average_spend double, enriched_count bigint, low bigint, "
        "medium bigint, high bigint, regions bigint, in_regions bigint"
    )
    return spark.createDataFrame([row], schema)
