"""Replacement of personal identifiers in text.

The patterns are this package's own and applied in this order, each on the text left by
the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
}


# A text without this character cannot match, so the pattern is not tried on it.
NEEDED = {"email": "@", "ip": "."}


def masked(column: str) -> Column:
    """The text with every identifier replaced by its kind in brackets."""
    text = F.col(column)
    for kind, pattern in PATTERNS.items():
        text = F.regexp_replace(text, pattern, f"[{kind.upper()}]")
    return text


def mask_text(df: DataFrame, column: str = "text") -> DataFrame:
    """The text masked in place, and emails, ips, cards, phones: how often each was found.

    Every kind is its own projection on the text the last kind left, which is worked out
    once. Matches are counted only in texts that a replacement changed.
    """
    for kind, pattern in PATTERNS.items():
        current = F.col(column)
        masked = F.regexp_replace(current, pattern, f"[{kind.upper()}]")
        if kind in NEEDED:
            masked = F.when(current.contains(NEEDED[kind]), masked).otherwise(current)
        df = df.withColumn("_masked", masked)
        found = F.when(F.col("_masked") != current, F.regexp_count(current, F.lit(pattern)))
        found = found.otherwise(F.when(current.isNotNull(), 0))
        df = df.withColumns({f"{kind}s": found, column: F.col("_masked")})
    return df.drop("_masked")
