"""Model replies, attempts and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import inputs
from catalog.inputs import LOG, RAW, REPLIES, SUMMARY_REPLIES, WHITE, table
from catalog.registry import query, sql_with
from catalog.rows import CLEAN_CUSTOMERS, CUSTOMERS, customers
from tidemill.functions import draws, replies, text
from tidemill.operators import clean, parsing, scoring

_TOKEN = r"<\|[a-zA-Z_]+\|>"


@query(
    "l1_strip_tokens",
    sql_with(REPLIES, f"SELECT doc_id, regexp_replace(reply, '{_TOKEN}', '', 'g') AS clean FROM replies"),
)
def l1_strip_tokens(spark, sf):
    return inputs.label_replies(spark, sf).select("doc_id", replies.strip_tokens("reply").alias("clean"))


@query(
    "l2_final_channel",
    sql_with(
        REPLIES,
        # by the known shape of the replies
        "SELECT doc_id, CASE kind WHEN 0 THEN body || '}' WHEN 1 THEN body || '}' "
        "WHEN 2 THEN trim(text || chr(10) || body || '} trailing words', " + WHITE + ") "
        "WHEN 3 THEN trim(text || body, " + WHITE + ") WHEN 4 THEN trim(text, " + WHITE + ") "
        "ELSE body || '}' END AS final FROM replies",
    ),
)
def l2_final_channel(spark, sf):
    return inputs.label_replies(spark, sf).select("doc_id", replies.final_channel("reply").alias("final"))


@query(
    "l3_json",
    sql_with(
        REPLIES,
        "SELECT doc_id, CASE WHEN kind NOT IN (3, 4) THEN monetary END AS monetary_stance, "
        "CASE WHEN kind NOT IN (3, 4) THEN trade END AS trade_stance, "
        "CASE WHEN kind NOT IN (3, 4) THEN flag END AS tariff_mention, "
        "CASE WHEN kind NOT IN (3, 4) AND NOT short THEN outlook END AS economic_outlook, "
        "CASE kind WHEN 3 THEN 'Invalid JSON' WHEN 4 THEN 'No JSON found in response: ' || "
        "substring(reply, 1, 200) || '...' END AS error FROM replies",
    ),
)
def l3_json(spark, sf):
    answers = inputs.label_replies(spark, sf).select("doc_id", "reply")
    parsed = parsing.parse_json(answers, "reply", "p")
    names = ["monetary_stance", "trade_stance", "tariff_mention", "economic_outlook"]
    return parsed.select(
        "doc_id",
        *[F.try_element_at("p.fields", F.lit(name)).alias(name) for name in names],
        "p.error",
    )


_ORD = {
    "monetary": "CASE monetary WHEN 'very_dovish' THEN 1 WHEN 'dovish' THEN 2 WHEN 'neutral' "
    "THEN 3 WHEN 'hawkish' THEN 4 WHEN 'very_hawkish' THEN 5 {extra} END",
    "trade": "CASE trade WHEN 'very_protectionist' THEN 1 WHEN 'neutral' THEN 3 "
    "WHEN 'globalist' THEN 4 ELSE 5 END",
    "outlook": "CASE outlook WHEN 'negative' THEN 2 WHEN 'positive' THEN 4 ELSE 5 END",
}


def _parsed_sql(extra: str, flag_ok: str, error: str) -> str:
    monetary = _ORD["monetary"].format(extra=extra)
    ok = "error IS NULL"
    return sql_with(
        [
            *REPLIES,
            f"judged AS (SELECT *, {monetary} AS m, {_ORD['trade']} AS t, {_ORD['outlook']} AS o, "
            f"{flag_ok} AS flag_ok FROM replies)",
            f"errors AS (SELECT *, {error} AS error FROM judged)",
        ],
        f"SELECT doc_id, CASE WHEN {ok} THEN m END AS monetary_stance, "
        f"CASE WHEN {ok} THEN t END AS trade_stance, "
        f"CASE WHEN {ok} THEN CAST(flag AS INTEGER) END AS tariff_mention, "
        f"CASE WHEN {ok} THEN o END AS economic_outlook, error FROM errors",
    )


STRICT_SQL = _parsed_sql(
    "",
    "kind <> 6",
    "CASE WHEN kind = 4 THEN 'No JSON found in response: ' || substring(reply, 1, 200) || '...' "
    "WHEN kind = 3 THEN 'Invalid JSON' "
    "WHEN m IS NULL THEN 'Invalid monetary_stance' WHEN NOT flag_ok THEN 'Invalid tariff_mention' "
    "WHEN short THEN 'Invalid economic_outlook' END",
)


@query("l4_strict", STRICT_SQL)
def l4_strict(spark, sf):
    answers = inputs.label_replies(spark, sf).select("doc_id", "reply")
    parsed = parsing.parse_labels(answers, "reply", "p")
    return parsed.select("doc_id", "p.*")


@query(
    "l5_ordinal",
    sql_with(
        REPLIES,
        "SELECT doc_id, CAST("
        + _ORD["monetary"].format(extra="")
        + " AS INTEGER) AS strict_value, CAST("
        + _ORD["monetary"].format(extra="WHEN 'somewhat_hawkish' THEN 4")
        + f" AS INTEGER) AS lenient_value, {_ORD['trade']} AS trade, {_ORD['outlook']} AS outlook "
        "FROM replies",
    ),
)
def l5_ordinal(spark, sf):
    from tidemill.functions import fixed

    parts = inputs.label_replies(spark, sf)
    return parts.select(
        "doc_id",
        replies.ordinal("monetary", fixed.STRICT_MONETARY).alias("strict_value"),
        replies.ordinal("monetary", fixed.LENIENT_MONETARY).alias("lenient_value"),
        replies.ordinal("trade", fixed.STRICT_TRADE).alias("trade"),
        replies.ordinal("outlook", fixed.LENIENT_OUTLOOK).alias("outlook"),
    )


@query(
    "l6_lenient",
    _parsed_sql(
        "WHEN 'somewhat_hawkish' THEN 4",
        "true",
        "CASE WHEN kind IN (3, 4) THEN 'No JSON found in response: ' || substring(reply, 1, 100) "
        "|| '...' WHEN short THEN 'Missing required fields: [''economic_outlook'']' "
        "WHEN m IS NULL THEN 'Invalid monetary_stance: ' || monetary END",
    ),
)
def l6_lenient(spark, sf):
    answers = inputs.label_replies(spark, sf).select("doc_id", "reply")
    parsed = parsing.parse_labels_leniently(answers, "reply", "p")
    return parsed.select("doc_id", "p.*")


@query(
    "l7_summary_check",
    sql_with(
        [f"stripped AS (SELECT doc_id, trim(text, {WHITE}) AS body FROM documents)"],
        "SELECT doc_id, CASE WHEN length(body) >= 50 THEN body END AS summary, CASE WHEN length(body) < 50 THEN "
        "'Summary too short (' || CAST(length(body) AS VARCHAR) || ' chars)' END AS error "
        "FROM stripped",
    ),
)
def l7_summary_check(spark, sf):
    checked = table(spark, sf, "documents").select("doc_id", replies.check_summary("text").alias("p"))
    return checked.select("doc_id", "p.*")


_BULLETS = (
    "CASE WHEN safe = '' THEN '' WHEN starts_with(safe, '•') THEN safe || chr(10) "
    "ELSE '• ' || safe || chr(10) END || '• ' || lang"
)
_OBJECT = (
    f"CASE doc_id % 5 WHEN 0 THEN {_BULLETS} WHEN 1 THEN "
    "CAST(doc_id AS VARCHAR) ELSE safe END"
)
SUMMARY_OBJECT_SQL = (
    f"objects AS (SELECT doc_id, {_OBJECT} AS summary FROM summary_replies)"
)


@query(
    "l8_summary_object",
    sql_with(
        [*SUMMARY_REPLIES, SUMMARY_OBJECT_SQL],
        "SELECT doc_id, CASE WHEN length(summary) >= 50 THEN summary END AS summary, "
        "CASE WHEN length(summary) < 50 THEN 'Invalid summary response' END AS error FROM objects",
    ),
)
def l8_summary_object(spark, sf):
    answers = inputs.summary_replies(spark, sf).select("doc_id", "reply")
    parsed = parsing.parse_summary(answers, "reply", "p")
    return parsed.select("doc_id", "p.*")


_MESSAGE = (
    "CASE CAST(floor(value) AS BIGINT) % 6 WHEN 0 THEN 'Read Timeout on ' || event_type "
    "WHEN 1 THEN 'HTTP 429 for ' || props WHEN 2 THEN 'failed (502) ' || event_type "
    "WHEN 3 THEN 'code 15003 seen' WHEN 4 THEN 'Rate exceeded' ELSE 'reset by peer' END"
)
_STATUS = (
    "CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 "
    "ELSE NULL END"
)
_CLASS = (
    "CASE WHEN contains(lower(message), 'timeout') THEN 'LLMTimeoutError' "
    "WHEN regexp_matches(message, '(^|[^0-9])429([^0-9]|$)') OR contains(lower(message), 'rate') "
    "THEN 'LLMRateLimitError' "
    "WHEN regexp_matches(message, '(^|[^0-9])50[0234]([^0-9]|$)') THEN 'LLMServerError' "
    "ELSE 'RetryableError' END"
)


@query(
    "l9_error_class",
    sql_with(
        [f"calls AS (SELECT event_id, {_STATUS} AS http_status, {_MESSAGE} AS message FROM events)"],
        f"SELECT event_id, {_CLASS} AS by_message, CASE WHEN http_status IS NULL THEN {_CLASS} "
        "WHEN http_status = 429 THEN 'LLMRateLimitError' WHEN http_status >= 500 THEN "
        "'LLMServerError' WHEN http_status <> 200 THEN 'RetryableError' END AS by_status FROM calls",
    ),
)
def l9_error_class(spark, sf):
    calls = table(spark, sf, "events").selectExpr(
        "event_id", f"{_STATUS} AS http_status", f"{_MESSAGE} AS message"
    )
    return calls.select(
        "event_id",
        replies.error_class_of_message("message").alias("by_message"),
        replies.error_class_of_status("http_status", "message").alias("by_status"),
    )


_RESOLVED = [
    LOG,
    "tried AS (SELECT * FROM (SELECT *, row_number() OVER w AS attempt, "
    "sum(duration_ms) OVER (PARTITION BY record_id ORDER BY ts, event_id "
    "ROWS UNBOUNDED PRECEDING) AS elapsed FROM log "
    "WINDOW w AS (PARTITION BY record_id ORDER BY ts, event_id)) WHERE attempt <= 5)",
    "ends AS (SELECT record_id, min(attempt) FILTER (WHERE outcome <> 'retry') AS stop, "
    "max(attempt) AS last FROM tried GROUP BY record_id)",
    "resolved AS (SELECT t.record_id, CASE WHEN outcome = 'valid' THEN 'success' ELSE 'failed' "
    "END AS status, CASE WHEN outcome <> 'valid' THEN error_type END AS error_type, "
    "CASE WHEN outcome <> 'valid' THEN error_message END AS error_message, "
    "attempt AS attempts, outcome <> 'valid' AS fallback_used, "
    "CAST(elapsed AS BIGINT) AS duration_ms "
    "FROM tried t JOIN ends e ON t.record_id = e.record_id "
    "AND t.attempt = coalesce(e.stop, e.last))",
]


RESOLVED_SQL = sql_with(_RESOLVED, "SELECT * FROM resolved")


@query("l10_attempts", RESOLVED_SQL)
def l10_attempts(spark, sf):
    return scoring.resolve_attempts(inputs.attempt_log(spark, sf), "record_id", ["ts", "event_id"])


@query(
    "l11_backoff",
    "SELECT event_id, least(pow(2.0, event_id % 10), 60.0) AS call_delay, "
    "least(10.0 * pow(2.0, event_id % 6), 120.0) AS job_delay, "
    "least(30.0 * pow(2.0, event_id % 6), 300.0) AS long_job_delay, "
    "round(least(pow(2.0, event_id % 10), 60.0) * (1 + 0.2 * (2 * "
    + inputs.duck_uniform("event_id", 7, "retry")
    + " - 1)), 6) AS jittered FROM events",
)
def l11_backoff(spark, sf):
    attempt, job = F.col("event_id") % 10, F.col("event_id") % 6 + 1
    draw = draws.uniform("event_id", 7, "retry")
    return table(spark, sf, "events").select(
        "event_id",
        replies.call_backoff(attempt).alias("call_delay"),
        replies.job_backoff(job).alias("job_delay"),
        replies.job_backoff(job, 30.0, 300.0).alias("long_job_delay"),
        F.round(replies.call_backoff(attempt, draw), 6).alias("jittered"),
    )


_DELAY = (
    "least(pow(2.0, attempts), 60.0) * (1 + 0.2 * (2 * "
    + inputs.duck_uniform("record_id", 42, "retry")
    + " - 1))"
)


@query(
    "l11_next_retry",
    sql_with(
        [*_RESOLVED, "ends_at AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)"],
        f"SELECT record_id, ts + to_microseconds(CAST(round({_DELAY} * 1000000) AS BIGINT)) "
        "AS next_retry_at FROM resolved JOIN ends_at ON record_id = user_id WHERE status = 'failed'",
    ),
)
def l11_next_retry(spark, sf):
    """When each failed record is due again, counted from its last event."""
    log = inputs.attempt_log(spark, sf)
    resolved = scoring.resolve_attempts(log, "record_id", ["ts", "event_id"])
    last = log.groupBy("record_id").agg(F.max("ts").alias("ts"))
    letters = scoring.to_dead_letter(resolved).join(last, "record_id", "left")
    return scoring.schedule_retries(letters, "record_id", "ts").select("record_id", "next_retry_at")


@query(
    "l12_fallbacks",
    sql_with(
        [RAW],
        "SELECT reference, '* Topic: ' || coalesce(nullif(title, ''), 'Untitled')"
        " || chr(10) || '* Speaker: ' || coalesce(nullif(speaker, ''), 'Unknown') || chr(10) || "
        "'* Bank: ' || coalesce(nullif(central_bank, ''), 'Unknown') AS summary, "
        "3 AS monetary_stance, 3 AS trade_stance, 0 AS tariff_mention, 3 AS economic_outlook "
        "FROM raw",
    ),
)
def l12_fallbacks(spark, sf):
    values = [value.alias(name) for name, value in scoring.label_fallbacks().items()]
    return inputs.raw_documents(spark, sf).select(
        "reference", text.summary_fallback().alias("summary"), *values
    )


@query(
    "l13_dead_letter",
    sql_with(
        _RESOLVED,
        "SELECT record_id, error_type, duration_ms, status AS _llm_status, "
        "coalesce(error_message, '') AS _llm_error, attempts AS _llm_attempts, "
        "fallback_used AS _llm_fallback_used FROM resolved",
    ),
)
def l13_dead_letter(spark, sf):
    resolved = scoring.resolve_attempts(
        inputs.attempt_log(spark, sf), "record_id", ["ts", "event_id"]
    )
    return scoring.to_dead_letter(resolved)


@query(
    "l13_settled_replies",
    f"SELECT doc_id, coalesce(monetary_stance, 3) AS monetary_stance, "
    "coalesce(trade_stance, 3) AS trade_stance, coalesce(tariff_mention, 0) AS tariff_mention, "
    "coalesce(economic_outlook, 3) AS economic_outlook, CASE WHEN error IS NULL THEN 'success' "
    "ELSE 'failed' END AS _llm_status, coalesce(error, '') AS _llm_error, "
    "CAST(1 AS BIGINT) AS _llm_attempts, error IS NOT NULL AS _llm_fallback_used "
    f"FROM ({STRICT_SQL})",
)
def l13_settled_replies(spark, sf):
    answers = inputs.label_replies(spark, sf).select("doc_id", "reply")
    parsed = parsing.parse_labels(answers, "reply", "_p").drop("reply")
    return scoring.settle_parsed(parsed, "_p", scoring.label_fallbacks())


WORDS_SCHEMA = T.StructType(
    [T.StructField("words", T.LongType()), T.StructField("longest", T.LongType())]
)


def word_scorer():
    """Counts words; texts in French time out, very short ones are invalid replies."""

    def score(row: dict) -> dict:
        words = row["text"].split(" ")
        if row["lang"] == "fr":
            raise TimeoutError("no answer")
        if len(words) < 20:
            raise ValueError(f"only {len(words)} words")
        if row["doc_id"] % 10 == 9:
            raise RuntimeError("model crashed")
        return {"words": len(words), "longest": max(len(word) for word in words)}

    return score


WORDS_SQL = (
    "words AS (SELECT doc_id, lang, string_split(text, ' ') AS w FROM documents), "
    "judged AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'LLMTimeoutError' WHEN len(w) < 20 "
    "THEN 'ValidationError' WHEN doc_id % 10 = 9 THEN 'unexpected_error' END AS error_type, "
    "CASE WHEN lang = 'fr' THEN 'no answer' WHEN len(w) < 20 THEN 'only ' || "
    "CAST(len(w) AS VARCHAR) || ' words' WHEN doc_id % 10 = 9 THEN 'model crashed' ELSE '' END "
    "AS _llm_error, len(w) AS n, list_max(list_transform(w, lambda x: length(x))) AS m FROM words), "
    "scored AS (SELECT doc_id, CASE WHEN error_type IS NULL THEN n ELSE -1 END AS words, "
    "CASE WHEN error_type IS NULL THEN m ELSE -1 END AS longest, "
    "CASE WHEN error_type IS NULL THEN 'success' ELSE 'failed' END AS _llm_status, _llm_error, "
    "CAST(CASE WHEN error_type IN ('LLMTimeoutError', 'ValidationError') THEN 5 ELSE 1 END "
    "AS BIGINT) AS _llm_attempts, error_type IS NOT NULL AS _llm_fallback_used, error_type "
    "FROM judged)"
)


def score_words(df):
    scored = scoring.score_rows(
        df,
        word_scorer(),
        WORDS_SCHEMA,
        lambda row: {"words": -1, "longest": -1},
        key="doc_id",
        inputs=["text", "lang"],
    )
    return scored.drop("duration_ms")


@query("l14_scorer", f"WITH {WORDS_SQL} SELECT * FROM scored")
def l14_scorer(spark, sf):
    return score_words(table(spark, sf, "documents"))


@query(
    "l15_sample_enrich",
    sql_with(
        [
            CUSTOMERS,
            CLEAN_CUSTOMERS,
            "chosen AS (SELECT id FROM clean_customers ORDER BY "
            + inputs.duck_digest("id", 42, "sample")
            + ", id LIMIT 10)",
        ],
        "SELECT c.*, CASE WHEN s.id IS NULL THEN 'Not enriched (sample limit)' "
        "WHEN age % 2 = 0 THEN 'Error: busy' ELSE 'Aged ' || CAST(age AS VARCHAR) END AS ai_profile "
        "FROM clean_customers c LEFT JOIN chosen s ON c.id = s.id",
    ),
)
def l15_sample_enrich(spark, sf):
    def profile(sampled):
        odd = F.col("age") % 2 == 1
        return sampled.select(
            "id",
            F.when(odd, F.concat(F.lit("Aged "), F.col("age").cast("string"))).alias("ai_profile"),
            F.when(~odd, "busy").alias("error"),
        )

    return scoring.enrich_sample(clean.clean_customers(customers(spark, sf)), profile)
