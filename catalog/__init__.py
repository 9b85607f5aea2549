"""Registered queries: every operator on the supplied tables, with its SQL twin."""

from catalog.registry import ORACLES, QUERIES  # noqa: F401
from catalog import (  # noqa: F401  (registers on import)
    rows,
    joins,
    counts,
    answers,
    search,
    twins,
    storage,
    jobs,
)
