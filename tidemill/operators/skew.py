"""Left joins and anti joins on a key whose left side may be dominated by a few values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def heavy_keys(
    df: DataFrame, key: str, min_rows: int = 1_000_000, tracked: int = 10_000
) -> dict:
    """key value -> how many ways to split it, for values above one partition's fair share.

    One pass over the key column with a frequent-items sketch: no shuffle by key, and at
    most 1000 values come back. A value the sketch misjudges is only split needlessly, or
    left to the adaptive skew join. Null counts as a value: such rows match nothing, but a
    left join would still send them all to one task.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(key).alias("set"),
        F.expr(f"approx_top_k(`{key}`, 1000, {tracked})").alias("top"),
    ).first()
    counts = {hit["item"]: hit["count"] for hit in row["top"] or []}
    counts[None] = row["n"] - row["set"]
    fair = max(min_rows, row["n"] / partitions)
    return {
        value: min(4096, max(2, round(count * partitions / row["n"])))
        for value, count in counts.items()
        if count > fair
    }


def _ways(key: str, heavy: dict) -> Column:
    """The number of ways of each row's key, from one literal map."""
    pairs = [F.lit(x) for value, ways in heavy.items() if value is not None for x in (value, ways)]
    known = F.element_at(F.create_map(*pairs), F.col(key)) if pairs else F.lit(None).cast("int")
    null = F.lit(heavy.get(None, 1))
    return F.when(F.col(key).isNull(), null).otherwise(F.coalesce(known, F.lit(1)))


def salt_left(df: DataFrame, key: str, heavy: dict) -> DataFrame:
    """Spread a heavy key's rows by a hash of their place, so that equal rows spread too.

    The key's partner rows are there under every salt, so any salt gives the same result.
    """
    place = F.xxhash64(F.monotonically_increasing_id())
    return df.withColumn(SALT, F.pmod(place, _ways(key, heavy).cast("bigint")).cast("int"))


def salt_right(df: DataFrame, key: str, heavy: dict) -> DataFrame:
    """One copy per salt for the heavy keys, one copy for all others; null never matches."""
    return df.filter(F.col(key).isNotNull()).withColumn(SALT, F.explode(F.sequence(F.lit(0), _ways(key, heavy) - 1)))


def left_joins(
    left: DataFrame,
    rights: list[DataFrame],
    key: str,
    min_rows: int = 1_000_000,
    heavy: dict | None = None,
) -> DataFrame:
    """left join of several tables on one key.

    All joins share the partitioning on the key, so the left side moves once. Catalyst may
    still broadcast a right side that is small by its statistics. `heavy` saves the look at
    the key column: pass what `heavy_keys` found on a cheaper table with the same keys, or
    an empty dict for a key that is known to be unique.
    """
    heavy = heavy_keys(left, key, min_rows) if heavy is None else heavy
    if not heavy:
        return reduce(lambda df, right: df.join(right, key, "left"), rights, left)
    salted = reduce(
        lambda df, right: df.join(salt_right(right, key, heavy), [key, SALT], "left"),
        rights,
        salt_left(left, key, heavy),
    )
    return salted.drop(SALT)


def anti_join(
    left: DataFrame,
    done: DataFrame,
    key: str,
    min_rows: int = 1_000_000,
    heavy: dict | None = None,
) -> DataFrame:
    """Rows of `left` whose key is not in `done`."""
    keys = done.select(key).distinct()
    heavy = heavy_keys(left, key, min_rows) if heavy is None else heavy
    if not heavy:
        return left.join(keys, key, "left_anti")
    return (
        salt_left(left, key, heavy)
        .join(salt_right(keys, key, heavy), [key, SALT], "left_anti")
        .drop(SALT)
    )
