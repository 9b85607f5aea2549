"""Scalar text, number and default expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions import fixed

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NOT_PRINTABLE = r"[\p{C}\p{Z}&&[^ \n\t]]"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def truncate(c: Column | str, limit: int | None) -> Column:
    """First `limit` characters (code points); all of them without a limit."""
    return col_of(c) if limit is None else F.substring(col_of(c), 1, limit)


def longer_than(c: Column | str, limit: int = fixed.MIN_TEXT_CHARS) -> Column:
    return F.length(col_of(c)) > limit


def or_default(c: Column | str, default: str) -> Column:
    """Null and empty both give the default."""
    return F.coalesce(F.nullif(col_of(c), F.lit("")), F.lit(default))


def embed_text(title: Column | str, summary: Column | str, limit: int | None = None) -> Column:
    """Title, blank line, summary; the title alone without a summary; a marker without both."""
    title, summary = col_of(title), col_of(summary)
    has_summary = F.coalesce(summary, F.lit("")) != ""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), summary)
    text = F.when(has_summary, both).otherwise(or_default(title, "Untitled speech"))
    return truncate(text, limit)


def twin_embed_text(title: Column | str, summary: Column | str) -> Column:
    return F.concat(
        F.coalesce(col_of(title), F.lit("")),
        F.lit("\n\n"),
        F.coalesce(col_of(summary), F.lit("")),
    )


def scrub(
    text: Column | str, title: Column | str, limit: int | None = None
) -> Column:
    """Drop NUL, strip, blank out what does not print; too short falls back to the title.

    With a `limit` the text is cut to it. Blanking replaces one character by one, so cutting
    first gives the same text for less.
    """
    kept = strip(F.replace(col_of(text), F.lit("\x00"), F.lit("")))
    kept = kept if limit is None else truncate(kept, limit)
    fallback = F.concat(F.lit("Speech: "), or_default(title, "Untitled"))
    clean = F.regexp_replace(kept, NOT_PRINTABLE, " ")
    return F.when(F.length(kept) >= 10, clean).otherwise(fallback)


def title_case(c: Column | str) -> Column:
    """Every run of letters starts upper case and goes on lower case."""
    runs = F.regexp_extract_all(
        F.lower(col_of(c)), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1)
    )
    cased = F.transform(
        runs,
        lambda run: F.concat(F.upper(run.substr(1, 1)), run.substr(F.lit(2), F.length(run))),
    )
    return F.array_join(cased, "")


def cap(c: Column | str, upper: float) -> Column:
    """Upper clip that leaves null as null."""
    c = col_of(c)
    return F.when(c > upper, F.lit(upper)).otherwise(c)


def bin_label(c: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (edges[i], edges[i+1]]; outside all bins is null."""
    c = col_of(c)
    branches = None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (c > low) & (c <= high)
        branches = F.when(hit, label) if branches is None else branches.when(hit, label)
    return branches


def fixed_point(c: Column | str, digits: int) -> Column:
    """Text of a double at `digits` places, rounded on its exact binary value (half to even)."""
    return F.translate(F.format_number(col_of(c).cast("double"), digits), ",", "")


def round_binary(c: Column | str, digits: int) -> Column:
    """Round a double on its exact binary value: 2.675 to two places is 2.67."""
    return fixed_point(c, digits).cast("double")


def rate_text(part: Column, whole: Column) -> Column:
    """`95.0%`, or `N/A` when there is nothing to divide by."""
    share = F.lit(100) * part / F.nullif(whole, F.lit(0))
    return F.coalesce(F.concat(fixed_point(share, 1), F.lit("%")), F.lit("N/A"))


def render(template: str, columns: dict[str, Column | str]) -> Column:
    """Fill `{name}` places of a template from columns; null counts as empty text."""
    parts = []
    for index, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if index % 2:
            value = col_of(columns.get(piece, piece)).cast("string")
            parts.append(F.coalesce(value, F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def label_prompt(text: Column | str = "text", limit: int | None = None) -> Column:
    """The whole text, or its first `limit` characters (`fixed.LABEL_TEXT_CHARS` is usual)."""
    return render(fixed.LABEL_PROMPT, {"text": truncate(text, limit)})


def summary_prompt(
    title: Column | str = "title",
    speaker: Column | str = "speaker",
    central_bank: Column | str = "central_bank",
    text: Column | str = "text",
    limit: int | None = None,
) -> Column:
    """The whole text, or its first `limit` characters (`fixed.SUMMARY_TEXT_CHARS` is usual)."""
    return render(
        fixed.SUMMARY_PROMPT,
        {
            "title": or_default(title, "Untitled"),
            "speaker": or_default(speaker, "Unknown"),
            "central_bank": or_default(central_bank, "Unknown"),
            "text": truncate(text, limit),
        },
    )


def summary_fallback(
    title: Column | str = "title",
    speaker: Column | str = "speaker",
    central_bank: Column | str = "central_bank",
    limit: int | None = None,
) -> Column:
    """Three starred lines made from the row itself, the title whole or cut to `limit`."""
    return F.concat(
        F.lit("* Topic: "),
        truncate(or_default(title, "Untitled"), limit),
        F.lit("\n* Speaker: "),
        or_default(speaker, "Unknown"),
        F.lit("\n* Bank: "),
        or_default(central_bank, "Unknown"),
    )
