"""Quality rules: decision lists learned by sequential covering from labelled statistics.

`text_statistics` measures every whole text. `learn` grows conjunctions of thresholds that
separate bad rows from good ones, prunes each on rows it was not grown on, and stops when a
rule is no longer precise. `verdict` emits the list as one ordered conditional Column.

Defined results: a null text has no words and all counts 0; it fails the base rules. Labels
that are null are not learned from; a document labelled twice counts as bad if any label says
so. Without labelled rows of both kinds the list is empty and keeps what the base keeps.
Repeated rows are each measured. Texts are read whole, at any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = re.compile(r"[#*$%&|<>]")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
UPPER = re.compile(r"[A-Z]")
DIGIT = re.compile(r"[0-9]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct"]
WINDOW = 8


@dataclass(frozen=True)
class RuleSettings:
    sample_rows: int = 20_000  # bound on the labelled rows that rules are learned from
    thresholds: int = 48
    most_conditions: int = 4
    most_rules: int = 16
    least_covered: int = 8
    precision: float = 0.97


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def rows(self, table: dict[str, np.ndarray]) -> np.ndarray:
        value = table[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


def _repeat_words(found: list[str]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence too."""
    n = len(found) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)
    codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed + codes[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    twin = np.zeros(n, bool)
    twin[1:] = ranked[1:] == ranked[:-1]
    twin[:-1] |= ranked[1:] == ranked[:-1]
    at = order[twin]
    if not len(at):
        return 0
    # equal hashes only propose windows; the words decide
    seen = Counter(tuple(found[i : i + WINDOW]) for i in at.tolist())
    covered = np.zeros(len(found) + 1, np.int64)
    for i in at.tolist():
        if seen[tuple(found[i : i + WINDOW])] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((covered.cumsum() > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    found = [w for w in BLANKS.split(text) if w]
    lines = [x for x in text.split("\n") if BLANKS.sub("", x)]
    return (
        len(found),
        sum(map(len, found)),
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        _repeat_words(found),
        len(lines),
        len(UPPER.findall(text)),
        len(DIGIT.findall(text)),
        len(set(found)),
    )


def text_statistics(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The columns of `keep` and the counts of every row's whole text."""
    kept = docs.select(*keep).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(value.as_py()) for value in batch.column("_text")]
            arrays = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept.fields), *arrays], names=[*kept.names, *COUNTS]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + [f"{c} long" for c in COUNTS]
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(count, ", ".join(fields))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """The ratios that rules may test."""
    size, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "f_words": F.col("n_words").cast("double"),
        "f_word_length": F.col("word_chars") / size,
        "f_symbols": F.col("n_symbols") / size,
        "f_dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "f_repeats": F.col("n_repeat_words") / size,
        "f_line_words": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "f_upper": F.col("n_upper") / chars,
        "f_digits": F.col("n_digits") / chars,
        "f_distinct": F.col("n_distinct") / size,
    }


def _grow(table: dict, bad: np.ndarray, live: np.ndarray, cuts: dict, s: RuleSettings) -> list[Condition]:
    """Add the condition with the largest information gain until no good row is covered."""
    rule, covered = [], live.copy()
    while len(rule) < s.most_conditions and (covered & ~bad).any():
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        best, gain = None, 1e-9
        for name, values in cuts.items():
            for value in values:
                for above in (True, False):
                    option = Condition(name, above, float(value))
                    inside = covered & option.rows(table)
                    q, m = int((inside & bad).sum()), int((inside & ~bad).sum())
                    if q >= s.least_covered:
                        now = q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))
                        if now > gain:
                            best, gain = option, now
        if best is None:
            break
        rule.append(best)
        covered &= best.rows(table)
    return rule


def _rows(rule: list[Condition], table: dict, n: int) -> np.ndarray:
    inside = np.ones(n, bool)
    for condition in rule:
        inside &= condition.rows(table)
    return inside


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, settings: RuleSettings | None = None) -> list[list[Condition]]:
    """Sequential covering over arrays of one length: rules for bad rows, in order."""
    s = settings or RuleSettings()
    n = len(bad)
    grow = np.arange(n) % 3 != 0
    cuts = {k: np.unique(np.quantile(v, np.linspace(0.0, 1.0, s.thresholds + 1)[:-1])) for k, v in table.items() if n}
    left, rules = np.ones(n, bool), []
    while len(rules) < s.most_rules and (left & grow & bad).sum() >= s.least_covered:
        rule = _grow(table, bad, left & grow, cuts, s)

        def worth(size: int) -> float:
            inside = _rows(rule[:size], table, n) & left & ~grow
            p, m = int((inside & bad).sum()), int((inside & ~bad).sum())
            return (p - m) / (p + m) if p + m else -1.0

        if not rule:
            break
        rule = rule[: max(range(len(rule), 0, -1), key=worth)]
        inside = _rows(rule, table, n) & left
        hits, aside = int((inside & bad).sum()), inside & ~grow
        if hits < s.precision * inside.sum() or aside.any() and (aside & bad).sum() < s.precision * aside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def learn(docs: DataFrame, text: str, key: str, labels: DataFrame, label: str, settings: RuleSettings | None = None) -> list[list[Condition]]:
    """Rules for rows of `docs` whose label (joined by `key`) is 0."""
    s = settings or RuleSettings()
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    marks = marks.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    sample = marks.orderBy(F.xxhash64("_key"), "_key").limit(s.sample_rows)
    # broadcast: two numbers a row, and never more than sample_rows of them
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_words")).join(F.broadcast(sample), "_key")
    counted = text_statistics(rows, "_words", [F.col("_key"), F.col("_label")]).filter(~base_failed())
    ratios = features()
    found = counted.select("_key", "_label", *[v.alias(k) for k, v in ratios.items()]).orderBy(F.xxhash64("_key"), "_key")
    found = found.limit(s.sample_rows).collect()
    table = {k: np.array([r[k] for r in found], float) for k in ratios}
    return learn_rules(table, np.array([r["_label"] == 0 for r in found], bool), s)


def verdict(rules: list[list[Condition]]) -> Column:
    """The rules as one ordered conditional: false where one fires, else true."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column()
        out = out.when(test, False)
    return out.otherwise(True)
