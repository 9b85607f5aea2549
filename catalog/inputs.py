"""The document tables that the queries run on, derived from the supplied tables.

Every derived column is one SQL expression that Spark and the checking engine both
understand, so both sides see the same input. Nothing is left out: each derived table
has a row for every row of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_TIME = "2024-05-01T00:00:00+00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


# --- documents ----------------------------------------------------------------------

_REFERENCE = {"spark": "format_string('DOC-%06d', doc_id)", "duck": "printf('DOC-%06d', doc_id)"}
_TITLE = {
    "spark": "substring(substring_index(text, chr(10), 1), 1, 80)",
    "duck": "substring(split_part(text, chr(10), 1), 1, 80)",
}
_DATE = {
    "spark": "date_format(date_add(DATE'2020-01-01', CAST(doc_id % 1461 AS INT)), 'yyyy-MM-dd')",
    "duck": "strftime(DATE '2020-01-01' + CAST(doc_id % 1461 AS INTEGER), '%Y-%m-%d')",
}


def _document_columns(engine: str) -> dict[str, str]:
    return {
        "doc_id": "doc_id",
        "reference": _REFERENCE[engine],
        "date": _DATE[engine],
        "title": _TITLE[engine],
        "central_bank": "lang",
        "speaker": "CASE WHEN doc_id % 9 = 8 THEN NULL ELSE source END",
        "text": "text",
        "is_gov": "CASE WHEN doc_id % 5 = 4 THEN NULL ELSE doc_id % 3 = 0 END",
    }


# identifiers for the SQL side, written apart from the library's own patterns
IDENTIFIERS = {
    "email": r"[a-zA-Z0-9_.%+-]+@[a-zA-Z0-9-]+(\.[a-zA-Z0-9-]+)+",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "card": r"\d([ -]?\d){12,18}",
    "phone": r"(\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}([ .-]?\d{2,4}){2,4}|\d{3}[ .-]\d{3}[ .-]\d{4}",
}

RAW = f"raw AS (SELECT {_select(_document_columns('duck'))} FROM documents)"
CLEAN = (
    "cleaned AS (SELECT doc_id, reference, date, title, central_bank, "
    "coalesce(speaker, '') AS speaker, text, coalesce(is_gov, false) AS is_gov "
    "FROM raw WHERE length(text) > 100)"
)
DOCS = [RAW, CLEAN]


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    columns = _document_columns("spark")
    return table(spark, sf, "documents").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


# --- label results: a labelled document succeeded, the others fell back -------------

_ERROR = (
    "CASE doc_id % 6 WHEN 0 THEN 'ValidationError: unknown enum' "
    "WHEN 1 THEN 'request timeout after 180 s' "
    "WHEN 2 THEN 'LLMRateLimitError: slow down' "
    "WHEN 3 THEN 'HTTP 503 from service' "
    "WHEN 4 THEN 'code 429' ELSE 'connection lost' END"
)
_ERROR_TYPE = (
    "CASE doc_id % 6 WHEN 0 THEN 'ValidationError' WHEN 1 THEN 'LLMTimeoutError' "
    "WHEN 2 THEN 'LLMRateLimitError' WHEN 3 THEN 'LLMServerError' "
    "WHEN 4 THEN 'LLMRateLimitError' ELSE 'ServiceUnavailable' END"
)
_HIT = "quality IS NOT NULL"
LABEL_COLUMNS = {
    "monetary_stance": f"CASE WHEN {_HIT} THEN CAST(1 + doc_id % 5 AS INT) ELSE 3 END",
    "trade_stance": (
        f"CASE WHEN {_HIT} THEN CAST(1 + CAST(floor(doc_id / 5) AS BIGINT) % 5 AS INT) ELSE 3 END"
    ),
    "tariff_mention": f"CASE WHEN {_HIT} THEN toxic ELSE 0 END",
    "economic_outlook": (
        f"CASE WHEN {_HIT} THEN CAST(1 + quality * 2 + doc_id % 3 AS INT) ELSE 3 END"
    ),
    "_llm_status": f"CASE WHEN {_HIT} THEN 'success' ELSE 'failed' END",
    "_llm_error": f"CASE WHEN {_HIT} THEN '' ELSE {_ERROR} END",
    "_llm_attempts": f"CASE WHEN {_HIT} THEN CAST(1 + doc_id % 3 AS BIGINT) ELSE 5 END",
    "_llm_fallback_used": f"NOT ({_HIT})",
    "error_type": f"CASE WHEN {_HIT} THEN NULL ELSE {_ERROR_TYPE} END",
}
JOINED = (
    "joined AS (SELECT d.*, l.quality, l.toxic FROM documents d "
    "LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
RESULTS = (
    f"results AS (SELECT doc_id, {_REFERENCE['duck']} AS reference, "
    f"{_select(LABEL_COLUMNS)} FROM joined)"
)
LABELS = [JOINED, RESULTS]


def joined_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def label_results(spark: SparkSession, sf: str) -> DataFrame:
    return joined_documents(spark, sf).selectExpr(
        "doc_id",
        f"{_REFERENCE['spark']} AS reference",
        *[f"{e} AS {n}" for n, e in LABEL_COLUMNS.items()],
    )


# --- summary results: the text itself where long enough, the template otherwise -----

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STRIPPED = f"trim(text, {WHITE})"
SUMMARIES = (
    "stripped AS (SELECT *, " + _STRIPPED + " AS body FROM raw), "
    "summaries AS (SELECT doc_id, reference, "
    "CASE WHEN length(body) < 50 THEN '* Topic: ' || coalesce(nullif(title, ''), 'Untitled') "
    "|| chr(10) || '* Speaker: ' || coalesce(nullif(speaker, ''), 'Unknown') "
    "|| chr(10) || '* Bank: ' || coalesce(nullif(central_bank, ''), 'Unknown') "
    "ELSE body END AS summary, "
    "CASE WHEN length(body) < 50 THEN 'failed' ELSE 'success' END AS _llm_status, "
    "CASE WHEN length(body) < 50 THEN 'Summary too short (' || CAST(length(body) AS VARCHAR) "
    "|| ' chars)' ELSE '' END AS _llm_error, "
    "CAST(1 AS BIGINT) AS _llm_attempts, length(body) < 50 AS _llm_fallback_used FROM stripped)"
)


def summary_results(spark: SparkSession, sf: str) -> DataFrame:
    from tidemill.functions import replies, text
    from tidemill.operators import scoring

    raw = raw_documents(spark, sf)
    parsed = raw.select(
        "doc_id",
        "reference",
        replies.check_summary("text").alias("_parsed"),
        text.summary_fallback().alias("_fallback"),
    )
    return scoring.settle_parsed(parsed, "_parsed", {"summary": F.col("_fallback")}).drop(
        "_fallback"
    )


# --- model replies: the whole text as reasoning around a JSON object ----------------

_MONETARY = (
    "CASE WHEN doc_id % 13 = 12 THEN 'somewhat_hawkish' WHEN doc_id % 7 = 5 THEN 'unsure' "
    "ELSE CASE doc_id % 5 WHEN 0 THEN 'very_dovish' WHEN 1 THEN 'dovish' WHEN 2 THEN 'neutral' "
    "WHEN 3 THEN 'hawkish' ELSE 'very_hawkish' END END"
)
_TRADE = (
    "CASE doc_id % 4 WHEN 0 THEN 'very_protectionist' WHEN 1 THEN 'neutral' "
    "WHEN 2 THEN 'globalist' ELSE 'very_globalist' END"
)
_OUTLOOK = (
    "CASE doc_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'very_positive' END"
)
_FLAG = "CAST(coalesce(toxic, 0) AS STRING)"
PARTS = {
    "kind": "CAST(doc_id % 7 AS INT)",
    "monetary": _MONETARY,
    "trade": _TRADE,
    "outlook": _OUTLOOK,
    "flag": _FLAG,
    "short": "doc_id % 11 = 10",
}
_Q = "chr(34)"
_FIELD = lambda name, value: f"{_Q} || '{name}' || {_Q} || ': ' || {value}"
_TEXT = lambda value: f"{_Q} || {value} || {_Q}"
_BODY = (
    "'{' || "
    + _FIELD("monetary_stance", _TEXT("monetary"))
    + " || ', ' || "
    + _FIELD("trade_stance", _TEXT("trade"))
    + " || ', ' || "
    + _FIELD("tariff_mention", "CASE WHEN kind = 6 THEN " + _TEXT("flag") + " ELSE flag END")
    + " || CASE WHEN short THEN '' ELSE ', ' || "
    + _FIELD("economic_outlook", _TEXT("outlook"))
    + " END"
)
_REPLY = (
    f"CASE kind WHEN 0 THEN body || '}}<|return|>' "
    "WHEN 1 THEN '<|start|>assistant<|channel|>analysis<|message|>' || text || "
    "'<|end|><|start|>assistant<|channel|>final<|message|>' || body || '}<|return|>' "
    "WHEN 2 THEN text || chr(10) || body || '} trailing words' "
    "WHEN 3 THEN text || body "
    "WHEN 4 THEN '<|channel|>analysis<|message|> ' || text || ' <|end|>' "
    "ELSE '<|channel|>final<|message|>' || body || '}' END"
)
REPLIES = [
    JOINED,
    f"parts AS (SELECT doc_id, text, {_select(PARTS)} FROM joined)".replace(
        "AS STRING", "AS VARCHAR"
    ),
    f"bodies AS (SELECT *, {_BODY} AS body FROM parts)",
    f"replies AS (SELECT *, {_REPLY} AS reply FROM bodies)",
]


def label_replies(spark: SparkSession, sf: str) -> DataFrame:
    parts = joined_documents(spark, sf).selectExpr(
        "doc_id", "text", *[f"{e} AS {n}" for n, e in PARTS.items()]
    )
    return parts.selectExpr("*", f"{_BODY} AS body").selectExpr("*", f"{_REPLY} AS reply")


# --- summary replies: an object with reasoning and summary --------------------------

_SAFE = "trim(translate(text, chr(34) || chr(92) || chr(9) || chr(10) || chr(13), '     '))"
_SUMMARY_VALUE = (
    "CASE doc_id % 5 "
    "WHEN 0 THEN '[' || " + _TEXT("safe") + " || ', ' || " + _TEXT("'• ' || lang") + " || ', ' || "
    + _TEXT("''") + " || ']' "
    "WHEN 1 THEN CAST(doc_id AS STRING) "
    "ELSE " + _TEXT("safe") + " END"
)
_SUMMARY_REPLY = (
    "'{' || "
    + _FIELD("reasoning", "CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS STRING) ELSE "
             + _TEXT("source") + " END")
    + " || ', ' || "
    + _FIELD("summary", _SUMMARY_VALUE)
    + " || '}<|return|>'"
)
SUMMARY_REPLIES = [
    f"safe_texts AS (SELECT *, {_SAFE} AS safe FROM documents)",
    f"summary_replies AS (SELECT doc_id, lang, safe, {_SUMMARY_REPLY} AS reply FROM safe_texts)"
    .replace("AS STRING", "AS VARCHAR"),
]


def summary_replies(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").selectExpr("*", f"{_SAFE} AS safe")
    return documents.selectExpr("doc_id", "lang", "safe", f"{_SUMMARY_REPLY} AS reply")


# --- attempt log: one record per user, its events are the tries ---------------------

_OUTCOME = (
    "CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'signup' THEN 'valid' "
    "WHEN 'view' THEN 'fatal' ELSE 'retry' END"
)
LOG_COLUMNS = {
    "record_id": "user_id",
    "ts": "ts",
    "event_id": "event_id",
    "outcome": _OUTCOME,
    "error_type": (
        "CASE event_type WHEN 'view' THEN 'ServiceUnavailable' WHEN 'error' THEN 'LLMServerError' "
        "WHEN 'click' THEN 'ValidationError' ELSE NULL END"
    ),
    "error_message": (
        "CASE WHEN event_type IN ('purchase', 'signup') THEN NULL "
        "ELSE event_type || ' at try ' || props END"
    ),
    "duration_ms": "CAST(floor(value * 100) AS BIGINT)",
}
LOG = f"log AS (SELECT {_select(LOG_COLUMNS)} FROM events)"


def attempt_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in LOG_COLUMNS.items()])


# --- draws: the hash randomness of tidemill.functions.draws in SQL ------------------


def duck_digest(key: str, seed: int, label: str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}|{label}')"


def duck_uniform(key: str, seed: int, label: str) -> str:
    return (
        f"(CAST(CAST('0x' || substr({duck_digest(key, seed, label)}, 1, 8) AS BIGINT) AS DOUBLE)"
        " / 4294967296.0)"
    )
