"""Running a user's scorer over every row, with attempts, fallbacks and status columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.functions import draws, fixed, replies


class ScoreError(Exception):
    """Raise from a scorer with one of the error classes of `fixed` to steer the attempts."""

    def __init__(self, message: str, error_class: str = fixed.RETRYABLE):
        super().__init__(message)
        self.error_class = error_class

    def __reduce__(self):
        return (type(self), (str(self), self.error_class))


RESULT_FIELDS = [
    T.StructField("_llm_status", T.StringType()),
    T.StructField("_llm_error", T.StringType()),
    T.StructField("_llm_attempts", T.LongType()),
    T.StructField("_llm_fallback_used", T.BooleanType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
]


def score_rows(
    df: DataFrame,
    scorer: Callable[[dict], dict],
    values: T.StructType,
    fallback: Callable[[dict], dict],
    key: str = "reference",
    inputs: list[str] | None = None,
    max_attempts: int = 5,
    pause: Callable[[int], float] | None = None,
    workers: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """key, the scorer's values and the status columns, one row per input row.

    The scorer sees one row as a dict and returns a dict with the fields of `values`. An
    error never fails the task: a retryable one is tried again up to `max_attempts`,
    "service unavailable" and unknown errors stop at once, and the row then takes the
    fallback. Partitions run in parallel: a slow scorer wants more of them than a scan
    gives, which `partitions` sets. `workers` threads serve scorers that wait for I/O, and
    `pause(attempt)` gives seconds to wait between tries.
    """
    schema = T.StructType([df.schema[key], *values.fields, *RESULT_FIELDS])
    arrow_schema = to_arrow_schema(schema)
    fields = [field.name for field in values.fields]
    classes = {
        "TimeoutError": fixed.TIMEOUT,
        "ConnectionError": fixed.UNAVAILABLE,
        "ConnectionRefusedError": fixed.UNAVAILABLE,
        "ValueError": fixed.VALIDATION,
        "KeyError": fixed.VALIDATION,
        "JSONDecodeError": fixed.VALIDATION,
    }
    final = (fixed.UNAVAILABLE, fixed.UNEXPECTED)
    unexpected = fixed.UNEXPECTED

    def score_one(row: dict) -> dict:
        import time

        started, error, kind, result = time.monotonic(), "", None, None
        attempt = 0
        while attempt < max_attempts:
            attempt += 1
            try:
                answer = scorer(row)
                result = {name: answer[name] for name in fields}
                break
            except Exception as failure:
                error = str(failure)
                kind = getattr(failure, "error_class", None) or classes.get(
                    type(failure).__name__, unexpected
                )
                if kind in final:
                    break
                if pause is not None and attempt < max_attempts:
                    time.sleep(pause(attempt - 1))
        good = result is not None
        if not good:
            result = fallback(row)
        return {
            key: row[key],
            **{name: result[name] for name in fields},
            "_llm_status": "success" if good else "failed",
            "_llm_error": "" if good else error,
            "_llm_attempts": attempt,
            "_llm_fallback_used": not good,
            "error_type": None if good else kind,
            "duration_ms": int((time.monotonic() - started) * 1000),
        }

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        with ThreadPoolExecutor(max_workers=workers) as pool:
            apply = pool.map if workers > 1 else map
            for batch in batches:
                # few rows at a time as Python objects: texts may be long
                for start in range(0, batch.num_rows, 256):
                    rows = batch.slice(start, 256).to_pylist()
                    scored = list(apply(score_one, rows))
                    yield pa.RecordBatch.from_pylist(scored, schema=arrow_schema)

    wanted = list(dict.fromkeys([key, *(inputs or df.columns)]))
    rows = df.select(*wanted)
    return (rows.repartition(partitions) if partitions else rows).mapInArrow(run, schema)


def label_fallback(row: dict) -> dict:
    """Neutral ordinals."""
    return {"monetary_stance": 3, "trade_stance": 3, "tariff_mention": 0, "economic_outlook": 3}


def settle_parsed(
    df: DataFrame, parsed: str, fallbacks: dict[str, Column], attempts: Column | int = 1
) -> DataFrame:
    """Flatten a parsed struct with an `error` field into values and status columns.

    Rows with an error take the fallbacks; the error text of a good row is "", not null.
    """
    error = F.col(f"{parsed}.error")
    good = error.isNull()
    values = {
        name: F.when(good, F.col(f"{parsed}.{name}")).otherwise(fallback)
        for name, fallback in fallbacks.items()
    }
    status = {
        "_llm_status": F.when(good, "success").otherwise("failed"),
        "_llm_error": F.coalesce(error, F.lit("")),
        "_llm_attempts": (attempts if isinstance(attempts, Column) else F.lit(attempts)).cast(
            "bigint"
        ),
        "_llm_fallback_used": ~good,
    }
    return df.withColumns({**values, **status}).drop(parsed)


def label_fallbacks() -> dict[str, Column]:
    return {name: F.lit(value) for name, value in fixed.LABEL_FALLBACK.items()}


def resolve_attempts(
    log: DataFrame,
    key: str,
    order_by: list[str],
    outcome: str = "outcome",
    error_type: str = "error_type",
    message: str = "error_message",
    duration: str = "duration_ms",
    max_attempts: int = 5,
) -> DataFrame:
    """One result row per key from a log of tries with outcome valid, retry or fatal.

    Only the first `max_attempts` tries count. Filtering on the rank lets Spark keep that
    many rows per key before the shuffle, so a key with very many tries costs no more.
    """
    in_order = W.partitionBy(key).orderBy(*order_by)
    tried = (
        log.select(key, *dict.fromkeys([*order_by, outcome, error_type, message, duration]))
        .withColumn("attempt", F.row_number().over(in_order))
        .filter(F.col("attempt") <= max_attempts)
    )
    so_far = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    tried = tried.withColumn("_elapsed", F.sum(duration).over(so_far))
    attempt = F.col("attempt")
    at_valid = F.when(F.col(outcome) == "valid", attempt)
    at_fatal = F.when(F.col(outcome) == "fatal", attempt)
    step = F.struct(
        attempt.alias("attempt"),
        F.col(error_type).alias("error_type"),
        F.col(message).alias("message"),
        F.col("_elapsed").alias("elapsed"),
    )
    ends = tried.groupBy(key).agg(
        F.min_by(step, at_valid).alias("valid"),
        F.min_by(step, at_fatal).alias("fatal"),
        F.max_by(step, attempt).alias("last"),
    )
    good = F.col("valid").isNotNull() & (
        F.col("fatal").isNull() | (F.col("valid.attempt") < F.col("fatal.attempt"))
    )
    end = F.when(good, F.col("valid")).otherwise(F.coalesce("fatal", "last"))
    return ends.select(
        key,
        F.when(good, "success").otherwise("failed").alias("status"),
        F.when(~good, end["error_type"]).alias("error_type"),
        F.when(~good, end["message"]).alias("error_message"),
        end["attempt"].cast("bigint").alias("attempts"),
        (~good).alias("fallback_used"),
        end["elapsed"].alias("duration_ms"),
    )


def to_dead_letter(resolved: DataFrame) -> DataFrame:
    """Resolved attempts under the names of the status columns."""
    return resolved.select(
        *[c for c in resolved.columns if c not in RESOLVED_NAMES and c != "error_message"],
        F.col("status").alias("_llm_status"),
        F.coalesce("error_message", F.lit("")).alias("_llm_error"),
        F.col("attempts").alias("_llm_attempts"),
        F.col("fallback_used").alias("_llm_fallback_used"),
    )


RESOLVED_NAMES = {"status", "attempts", "fallback_used"}


def schedule_retries(
    letters: DataFrame, key: str, failed_at: str, seed: int = 42, jitter: bool = True
) -> DataFrame:
    """Failed rows with `next_retry_at`: the time of failure plus the backoff of their tries."""
    draw = draws.uniform(key, seed, "retry") if jitter else None
    delay = replies.call_backoff(F.col("_llm_attempts"), draw)
    pause = F.make_dt_interval(secs=F.round(delay, 6).cast("decimal(18,6)"))
    failed = letters.filter(F.col("_llm_status") == "failed")
    return failed.withColumn("next_retry_at", F.col(failed_at) + pause)


#: keys of a sample that are broadcast
SENT_ROWS = 100_000


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n keys picked by their digest: the same ones on every run with the same seed."""
    return df.select(key).orderBy(draws.digest(key, seed, "sample"), key).limit(n)


def enrich_sample(
    df: DataFrame,
    profile: Callable[[DataFrame], DataFrame],
    key: str = "id",
    n: int = 10,
    seed: int = 42,
    marker: str = "Not enriched (sample limit)",
) -> DataFrame:
    """Profiles for a sample of n rows, a marker on all others, error text where it failed.

    `profile` turns the sampled rows into (key, ai_profile, error); of several answers for a
    key the one with the largest digest counts, so rows never multiply. Only a sample of at
    most SENT_ROWS keys is broadcast, answers never by a hint: their size is the model's.
    """
    keys = sample_keys(df, key, n, seed)
    chosen = df.join(F.broadcast(keys) if n <= SENT_ROWS else keys, key, "left_semi")
    answers = profile(chosen).select(key, "ai_profile", "error")
    picked = F.max_by(F.struct("ai_profile", "error"), F.xxhash64("ai_profile", "error"))
    answers = answers.groupBy(key).agg(picked.alias("_answer")).select(key, "_answer.*", F.lit(True).alias("_asked"))
    text_out = (
        F.when(F.col("_asked").isNull(), marker)
        .when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
        .otherwise(F.col("ai_profile"))
    )
    return (
        df.join(answers, key, "left")
        .withColumn("ai_profile", text_out)
        .drop("error", "_asked")
    )
