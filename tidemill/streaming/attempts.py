"""State over a stream: tries of the same record, and records that arrive again."""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "done boolean, tries string"


def settle_attempts(
    log: DataFrame,
    key: str,
    time: str,
    tie: str,
    late: str = "10 minutes",
    base: float = 1.0,
    ceiling: float = 60.0,
    forget: float = 86400.0,
    outcome: str = "outcome",
    error_type: str = "error_type",
    message: str = "error_message",
    duration: str = "duration_ms",
    max_attempts: int = 5,
) -> DataFrame:
    """The rows of `scoring.resolve_attempts` from a stream of tries, each as soon as it is sure.

    A record keeps its first `max_attempts` tries in the order of `time` and `tie`, in
    whichever order they arrive. It is settled when the watermark has passed its first valid
    or fatal try or its last allowed one, or when no further try came within the backoff:
    `base` seconds, doubled with every try, at most `ceiling`. Tries later than `late` are
    lost, and so are those that come after a record was settled; the mark that it was is kept
    for `forget` seconds. Rows without a key settle nothing but move the watermark, so a
    source may send them as heartbeats. Rows without a time are left out, and so are times up
    to 1970, where Spark's watermark begins.
    """
    kind = log.schema[key].dataType.simpleString()
    columns = ["_micros", tie, outcome, error_type, message, duration]

    def ending(tries: list) -> int | None:
        ends = [i for i, t in enumerate(tries) if t[2] in ("valid", "fatal")]
        return ends[0] if ends else max_attempts - 1 if len(tries) >= max_attempts else None

    def settled(record, tries: list) -> pd.DataFrame:
        stop = ending(tries)
        stop = len(tries) - 1 if stop is None else stop
        good = tries[stop][2] == "valid"
        spent = [t[5] for t in tries[: stop + 1] if t[5] is not None]
        row = [
            record, "success" if good else "failed", None if good else tries[stop][3], None if good else tries[stop][4],
            stop + 1, not good, pd.array([sum(spent) if spent else None], dtype="Int64"),
        ]
        names = [key, "status", "error_type", "error_message", "attempts", "fallback_used", "duration_ms"]
        return pd.DataFrame({name: value if name == "duration_ms" else [value] for name, value in zip(names, row)})

    def listed(chunk: pd.DataFrame, column: str) -> list:
        # a missing value is None or not equal to itself; plain lists cost far less per record than frames
        return [None if x is None or x != x else x for x in chunk[column].tolist()]

    def wake(state, at: int) -> None:
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))

    def work(group: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, tries = state.get if state.exists else (False, "[]")
        tries = json.loads(tries)
        if state.hasTimedOut:
            if done:
                state.remove()
                return
            yield settled(group[0], tries)
            state.update((True, "[]"))
            wake(state, state.getCurrentWatermarkMs() + int(forget * 1000))
            return
        if group[0] is None:
            return
        if done:
            wake(state, state.getCurrentWatermarkMs() + int(forget * 1000))
            return
        for chunk in chunks:
            fresh = ([*t[:5], None if t[5] is None else int(t[5])] for t in zip(*(listed(chunk, c) for c in columns)))
            tries = heapq.nsmallest(max_attempts, itertools.chain(tries, fresh), key=lambda t: (t[0], t[1]))
        state.update((False, json.dumps(tries)))
        stop = ending(tries)
        pause = 0 if stop is not None else min(base * 2 ** len(tries), ceiling)
        wake(state, tries[-1 if stop is None else stop][0] // 1000 + int(pause * 1000) + 1)

    at = F.col(time).cast("timestamp")
    rows = log.select(key, at.alias("_at"), F.unix_micros(at).alias("_micros"), *columns[1:])
    rows = rows.filter(F.col("_at").isNotNull()).withWatermark("_at", late)
    schema = f"`{key}` {kind}, status string, error_type string, error_message string, attempts bigint, fallback_used boolean, duration_ms bigint"
    return rows.groupBy(key).applyInPandasWithState(work, schema, STATE, "append", "EventTimeTimeout")


def first_arrivals(
    arriving: DataFrame, key: str, time: str, late: str = "1 day", results: DataFrame | None = None
) -> DataFrame:
    """Rows of a stream whose key neither came before nor has a row in `results`.

    A key is remembered until the watermark is `late` past its first arrival. Of different
    rows with one key the first to arrive goes on. Rows without a key count as one key. Rows
    behind the watermark are lost, and so are times up to 1970, where Spark's watermark begins.
    """
    fresh = arriving.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return fresh if results is None else fresh.join(results.select(key).distinct(), key, "left_anti")
