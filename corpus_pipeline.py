"""From documents to token files: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage but the last returns the columns of `documents`; between stages the rows are
written and read again, so a lost executor never costs more than one stage.

1. Language: documents go whose language cannot be told (no text or letter) or is told with a
   score below 0.5.
2. Near-duplicates: of each group of similar documents the one with the smallest doc id stays,
   a null one last, and of equal ids the one with the least digest of its columns.
3. Decontamination: documents go that hold a benchmark item.
4. Mixing: documents are repeated or left out so that sources meet their target weights.
5. Tokens: ids are written to files and read back, one row per document.

Stages tell rows apart, not doc ids: rows whose ids are null or repeated are documents of
their own, and each goes or stays by its own text.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, language, mixing, neardup, tokens
from tidemill.llm.common import materialize, numbered, table
from tidemill.llm.queries import leak_settings, token_settings
from tidemill.session import work_dir

LEAST_SCORE = 0.5
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _own_names(stage):
    """Further columns of the documents have reserved names inside a stage, so none can clash."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = [c if c in OWN else f"_further_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*inside), sf_dir)
        return out.toDF(*docs.columns) if out.columns == inside else out

    return run_stage


@_own_names
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs, "text", "lang", "doc_id")
    told = language.predict(docs, "text", model, [F.col(c) for c in docs.columns])
    return told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


@_own_names
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs, "near-rows")
    found = neardup.near_duplicates(rows, "_row", "text").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), "_row").alias("order")
    ranked = found.join(rows.select("_row", order), "_row")
    groups = ranked.groupBy("component_id").agg(F.count("*").alias("n"), F.min("order").alias("first")).filter("n > 1")
    gone = ranked.join(groups, "component_id").filter(F.col("_row") != F.col("first._row")).select("_row")
    return _without(rows, materialize(gone, "gone")).drop("_row")


@_own_names
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))  # equal rows go or stay together
    leaks = decontaminate.find_leaks(rows, "_row", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", leak_settings())
    gone = materialize(leaks.select(F.col("doc_id").alias("_row")).distinct(), "gone")
    return _without(rows, gone).drop("_row")


@_own_names
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs, "doc_id", "text", "source").select(docs.columns)


@_own_names
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "pipeline-tokens")
    tokens.write_tokens(docs, "doc_id", "text", path, token_settings())
    return tokens.read_tokens(spark, path)


def _without(docs: DataFrame, gone: DataFrame, listed: int = 250_000) -> DataFrame:
    """Rows of `docs` whose `_row` is not in `gone`; a counted short list is broadcast."""
    gone = F.broadcast(gone) if gone.count() <= listed else gone
    return docs.join(gone, "_row", "left_anti")


STAGES = [
    ("language", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: the language model and the tokenizer have no SQL; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
