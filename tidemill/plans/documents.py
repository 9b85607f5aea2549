"""From raw documents to a labelled, summarized, embedded and searchable product.

Scoring is the expensive step, so its results are stored before anything else reads
them; the joins after it are plain DataFrame work that can be repeated at will.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.config import Layout, RunOptions
from tidemill.functions import replies, text
from tidemill.operators import clean, parsing, product, resume, scoring, stats
from tidemill.operators.search import require_one_dim
from tidemill.operators.skew import left_joins
from tidemill.sources import collections, files

KEY = "reference"
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class DocumentSteps:
    """What the user brings: rows in, rows out, keyed by reference.

    label    -> the four label fields and the status columns
    summary  -> summary and the status columns
    embed    -> gets `embed_text`, adds `embedding`
    """

    label: Step
    summary: Step
    embed: Step


def label_replies(df: DataFrame, reply: str = "reply", key: str = KEY) -> DataFrame:
    """Label results from a column of model replies."""
    parsed = parsing.parse_labels(df.select(key, reply), reply, "_parsed").drop(reply)
    return scoring.settle_parsed(parsed, "_parsed", scoring.label_fallbacks())


def summary_replies(df: DataFrame, reply: str = "reply", key: str = KEY) -> DataFrame:
    """Summary results from a column of model replies, the template where a reply is no good."""
    template = text.summary_fallback().alias("_fallback")
    read = parsing.parse_summary(df.select(key, reply, template), reply, "_object").drop(reply)
    checked = read.withColumn("_checked", replies.check_summary("_object.summary"))
    error = F.coalesce("_object.error", "_checked.error").alias("error")
    parsed = checked.withColumn("_parsed", F.struct(F.col("_checked.summary"), error))
    settled = scoring.settle_parsed(parsed, "_parsed", {"summary": F.col("_fallback")})
    return settled.drop("_fallback", "_object", "_checked")


def clean_step(raw: DataFrame, options: RunOptions, key: str = KEY) -> DataFrame:
    return clean.clean_documents(clean.head_sample(raw, [key], options.sample_size))


def embed_inputs(
    documents: DataFrame, summaries: DataFrame, key: str = KEY, heavy: dict | None = None
) -> DataFrame:
    """Documents with their summary and the scrubbed text that gets embedded."""
    return embed_texts(product.join_summaries(documents, summaries, key, heavy))


def embed_texts(joined: DataFrame) -> DataFrame:
    """The same from rows that hold their summary already."""
    combined = text.embed_text("title", "summary")
    return joined.withColumn("embed_text", text.scrub(combined, "title"))


def index_objects(
    enriched: DataFrame, vectors: DataFrame, key: str = KEY, heavy: dict | None = None
) -> DataFrame:
    """Search objects with their vector.

    The product holds the labels already, and its text is cut before the rows move.
    """
    objects = clean.document_objects(enriched, key)
    return left_joins(objects, [vectors.select(key, "embedding")], key, heavy=heavy)


def embedded(rows: DataFrame, embed: Step, key: str = KEY) -> DataFrame:
    """Whole search objects from a step that adds its vector to the rows it gets, else (key, embedding).

    With whole objects no text has to move to meet its vector.
    """
    made = embed(rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    return clean.document_objects(made, key) if set(rows.columns) <= set(made.columns) else made.select(key, "embedding")


def check_vectors(documents: DataFrame, vectors: DataFrame) -> int:
    """One vector of one size for every document; gives the size."""
    wanted, found = documents.count(), vectors.count()
    if wanted != found:
        raise ValueError(f"DataFrame has {wanted} rows but got {found} embeddings")
    return require_one_dim(vectors)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a stage and go on from the stored copy."""
    files.write_product(df, path)
    return files.read_product(df.sparkSession, path)


def run_documents(
    raw: DataFrame,
    steps: DocumentSteps,
    layout: Layout,
    processed_at: str,
    options: RunOptions = RunOptions(),
    run_id: str = "run",
    name: str = "documents",
    chunks: int = 1,
    log: Callable[[str], None] = print,
) -> dict:
    """The whole job. A rerun with the same run_id goes on where the last one stopped.

    Texts move once, into the product; what gets embedded is read from there. Scored stages
    are read from their stores, which become the stages' products when the job is done.
    """
    spark = raw.sparkSession
    trial = "trial_" if options.is_trial else ""
    at = lambda stage: layout.product(stage, options)
    documents = stored(clean_step(raw, options), at("cleaned"))
    product.require_unique(documents, KEY)
    stores = []  # kept until the job is done: a rerun finds finished stages in them
    even = {}  # a unique key has no heavy values, so no join needs to look for them

    def scored(stage: str, rows: DataFrame, step: Step) -> DataFrame:
        store = layout.results(f"{trial}{stage}", run_id)
        found = resume.score_with_resume(rows, step, store, KEY, chunks, heavy=even)
        stores.append((found, store, at(stage)))
        return found

    labels = scored("labels", documents, steps.label)
    stats.require_success(labels, "Classification")
    summaries = scored("summaries", documents, steps.summary)
    stats.require_success(summaries, "Summarization")
    joined = product.assemble_product(documents, labels, summaries, processed_at, heavy=even)
    enriched = stored(joined, at("enriched"))
    vectors = scored("embeddings", embed_texts(enriched), lambda rows: embedded(rows, steps.embed))
    dim = check_vectors(documents, vectors)

    summary = stats.product_stats(enriched).first().asDict()
    path = layout.collection(name, options)
    collections.ensure_collection(spark, path, collections.DOCUMENT_PROPERTIES)
    if set(vectors.columns) == {KEY, "embedding"}:
        objects = index_objects(enriched, vectors, heavy=even)
        indexed = collections.load_collection(objects, path, KEY, dim=dim, heavy=even)
    else:
        _, store, target = stores.pop()
        files.write_product(vectors.select(KEY, "embedding"), target)
        indexed = collections.place_objects(store, path, spark, KEY, "idempotent", dim, even)
    for found, store, target in stores:
        resume.place_results(found, store, target)
    log(f"{name}: {summary['num_records']} records, {indexed['object_count']} indexed")
    return {**summary, **indexed, "product": at("enriched"), "is_trial": options.is_trial}
