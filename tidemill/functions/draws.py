"""Repeatable pseudo-random values derived from a row's key.

The same row gets the same draw on every attempt of a task and in every run with the
same seed, which `rand()` does not give once its input order moves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import col_of


def digest(key: Column | str, seed: int | str, label: str) -> Column:
    return F.md5(F.concat_ws("|", col_of(key).cast("string"), F.lit(str(seed)), F.lit(label)))


def uniform(key: Column | str, seed: int | str, label: str) -> Column:
    """A double in [0, 1) from the first 32 bits of the digest."""
    bits = F.conv(F.substring(digest(key, seed, label), 1, 8), 16, 10).cast("double")
    return bits / F.lit(4294967296.0)
