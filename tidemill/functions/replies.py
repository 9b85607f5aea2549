"""Column expressions on model replies: control tokens, enums, summaries, error classes.

A check that can fail returns a struct whose `error` field is null on success.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.functions.text import col_of, strip, truncate


def strip_tokens(c: Column | str) -> Column:
    """All control tokens removed; the pattern is only tried on texts that can hold one."""
    c = col_of(c)
    return F.when(c.contains("<|"), F.regexp_replace(c, fixed.CONTROL_TOKEN, "")).otherwise(c)


def final_channel(c: Column | str) -> Column:
    """The user-facing part of a reply with channels.

    The `final` channel up to its end token (or the end of the text) if there is one,
    else the last message that holds no other token, else the text without tokens.
    """
    c = col_of(c)
    final = r"(?is)<\|channel\|>\s*final\s*<\|message\|>(.*?)(?:<\|end\|>|<\|return\|>|\z)"
    message = r"(?s)<\|message\|>([^<]*?)(?:<\|end\|>|<\|return\|>|\z)"
    messages = F.regexp_extract_all(c, F.lit(message), F.lit(1))
    return (
        F.when(F.regexp_like(c, F.lit(final)), strip_tokens(strip(F.regexp_extract(c, final, 1))))
        .when(F.size(messages) > 0, strip_tokens(strip(F.element_at(messages, -1))))
        .otherwise(strip(strip_tokens(c)))
    )


def ordinal(c: Column | str, scale: dict[str, int]) -> Column:
    """Label to number, null for an unknown label."""
    c = col_of(c)
    branches = None
    for label, value in scale.items():
        hit = c == label
        branches = F.when(hit, value) if branches is None else branches.when(hit, value)
    return branches


#: codes count as whole numbers everywhere
RATE_CODE = r"(^|[^0-9])429([^0-9]|$)"
SERVER_CODE = r"(^|[^0-9])50[0234]([^0-9]|$)"


def check_summary(c: Column | str, limit: int | None = None) -> Column:
    """struct(summary, error): stripped, at least 50 characters, past a `limit` cut and marked.

    The usual limit is `fixed.SUMMARY_KEEP_CHARS`; without one the summary stays whole.
    """
    c = col_of(c)
    text = strip(c)
    size = F.length(text)
    kept = F.when(size >= fixed.SUMMARY_MIN_CHARS, text)
    if limit is not None:
        kept = F.when(size > limit, F.concat(truncate(text, limit), F.lit("..."))).otherwise(kept)
    short = F.concat(F.lit("Summary too short ("), size.cast("string"), F.lit(" chars)"))
    error = F.when(c.isNull(), F.lit("Summary missing")).when(
        size < fixed.SUMMARY_MIN_CHARS, short
    )
    return F.struct(kept.alias("summary"), error.alias("error"))


def error_class_of_message(message: Column | str) -> Column:
    """Timeout, then rate limit, then server codes (as whole numbers), else retryable."""
    message = col_of(message)
    lower = F.lower(message)
    return (
        F.when(F.contains(lower, F.lit("timeout")), fixed.TIMEOUT)
        .when(
            F.regexp_like(message, F.lit(RATE_CODE))
            | F.contains(lower, F.lit("rate")),
            fixed.RATE_LIMIT,
        )
        .when(F.regexp_like(message, F.lit(SERVER_CODE)), fixed.SERVER)
        .otherwise(fixed.RETRYABLE)
    )


def error_class_of_status(http_status: Column | str, message: Column | str) -> Column:
    """Class of a service answer; null for a good one, the message decides without a status."""
    status = col_of(http_status)
    return (
        F.when(status.isNull(), error_class_of_message(message))
        .when(status == 429, fixed.RATE_LIMIT)
        .when(status >= 500, fixed.SERVER)
        .when(status != 200, fixed.RETRYABLE)
    )


def failure_class(message: Column | str) -> Column:
    """One of the five breakdown classes, by ordered tests on a stored error text."""
    message = F.coalesce(col_of(message), F.lit(""))
    has = lambda part: F.contains(message, F.lit(part))
    return (
        F.when(has(fixed.VALIDATION), fixed.VALIDATION)
        .when(has(fixed.TIMEOUT) | F.contains(F.lower(message), F.lit("timeout")), fixed.TIMEOUT)
        .when(has(fixed.RATE_LIMIT) | F.regexp_like(message, F.lit(RATE_CODE)), fixed.RATE_LIMIT)
        .when(has(fixed.SERVER) | F.regexp_like(message, F.lit(SERVER_CODE)), fixed.SERVER)
        .otherwise(fixed.UNEXPECTED)
    )


def backoff_seconds(
    step: Column | str,
    base: float = 1.0,
    factor: float = 2.0,
    ceiling: float = 60.0,
    jitter: float = 0.0,
    draw: Column | None = None,
) -> Column:
    """min(base * factor^step, ceiling), moved by up to +-jitter with a draw from [0, 1)."""
    delay = F.least(F.lit(base) * F.pow(F.lit(factor), col_of(step)), F.lit(ceiling))
    if jitter and draw is not None:
        delay = delay + delay * F.lit(jitter) * (F.lit(2.0) * draw - F.lit(1.0))
    return F.greatest(F.lit(0.0), delay)


def call_backoff(attempt: Column | str, draw: Column | None = None) -> Column:
    """Row calls: attempts count from 0, base 1 s, ceiling 60 s."""
    return backoff_seconds(attempt, 1.0, 2.0, 60.0, 0.2 if draw is not None else 0.0, draw)


def job_backoff(
    attempt: Column | str, base: float = 10.0, ceiling: float = 120.0, draw: Column | None = None
) -> Column:
    """Long jobs: attempts count from 1."""
    jitter = 0.2 if draw is not None else 0.0
    return backoff_seconds(col_of(attempt) - 1, base, 2.0, ceiling, jitter, draw)
