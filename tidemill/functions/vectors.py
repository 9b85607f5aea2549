"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.functions.text import col_of


def hash_embedding(text: Column | str, dim: int = fixed.EMBEDDING_DIM) -> Column:
    """Deterministic vector of a text: the 32 bytes of its SHA-256, each `/255 - 0.5`, repeated.

    Only 32 values are distinct, so they are worked out once and the array is repeated.
    """
    digest = F.sha2(col_of(text), 256)
    values = F.array(
        *[
            F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 255.0 - 0.5
            for i in range(min(32, dim))
        ]
    )
    if dim <= 32:
        return values
    repeated = F.flatten(F.array_repeat(values, -(-dim // 32)))
    return repeated if dim % 32 == 0 else F.slice(repeated, 1, dim)


def certainty(distance: Column | str) -> Column:
    """Cosine distance 0..2 to certainty 1..0."""
    return F.lit(1.0) - col_of(distance) / 2.0
