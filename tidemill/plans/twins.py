"""From a document product to its synthetic twin: made, scored, embedded, stored, indexed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.config import Layout, RunOptions
from tidemill.functions import fixed, masks, text
from tidemill.operators import clean, privacy, stats, twin
from tidemill.plans.documents import KEY, check_vectors, stored
from tidemill.sources import collections, files
from tidemill.sources.versions import Repository

ALIASES = {"central_bank": "country", "speaker": "author"}
FREE_TEXT = ["title", "summary"]
QUASI = ["country", "is_gov"]
TARGET = "monetary_stance"
VALUES = ["country", "author", *fixed.LABEL_FIELDS, "is_gov"]


def twin_source(product: DataFrame, mask_personal: bool = False) -> DataFrame:
    """The checked product, renamed and cut down to what a twin is made from."""
    clean.require_columns(product, fixed.REQUIRED_FOR_TWIN, "Run the document job first.")
    source = twin.select_for_twin(clean.apply_aliases(product, ALIASES))
    texts = [name for name in FREE_TEXT if name in source.columns] if mask_personal else []
    return source.withColumns({name: masks.masked(name) for name in texts})


def run_twin(
    product: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    layout: Layout,
    generated_at: str,
    options: RunOptions = RunOptions(),
    run_id: str = "run",
    name: str = "synthetic_documents",
    seed: int = 42,
    mask_personal: bool = True,
    log: Callable[[str], None] = print,
) -> dict:
    """Real and synthetic rows never share a path or a collection.

    The twin is committed as a snapshot before it is judged, embedded and published, so
    every later step reads the same rows.
    """
    spark = product.sparkSession
    repository = Repository(spark, layout.twin("versions", options))
    source = stored(twin_source(product, mask_personal), layout.snapshot("source", options))
    quality = stats.input_quality(product).first()
    if quality["high_failure_rate"]:
        log(f"{quality['failed_any']} of {quality['total_records']} input rows hold fallbacks")
    roles = twin.infer_roles(source, KEY)
    snapshot = repository.write(
        twin.make_twin(source, roles, KEY, seed), "summaries", run_id, snapshot_type="summaries"
    )
    made = repository.read("summaries", snapshot["commit_id"])
    present = lambda names: [n for n in names if n in source.columns]
    attributes = [c for c in source.columns if c != KEY]
    scored = privacy.scores(
        source, made, attributes, present(QUASI), TARGET, present(VALUES)
    )
    report = privacy.evaluation_report(source, made, scored, generated_at, f"twin-{run_id}")
    files.write_report(report, layout.twin("validation_report", options), "".join(c for c in generated_at if c.isalnum()))

    # a step that adds its vector to the rows it gets spares a join that moves every text
    embedded = embed(made.withColumn("embed_text", text.twin_embed_text("title", "summary")))
    if set(made.columns) <= set(embedded.columns):
        rows = clean.twin_objects(embedded.withColumn("embedding", F.col("embedding").cast("array<float>")), KEY)
    else:
        narrow = stored(embedded.select(KEY, F.col("embedding").cast("array<float>")), layout.snapshot("vectors", options))
        rows = clean.twin_objects(made, KEY).join(narrow, KEY, "left")
    staged = layout.snapshot("objects", options)
    vector_path = layout.snapshot("embeddings", options)
    counts = files.write_snapshot(stored(rows, staged), vector_path, KEY).first()
    vectors = files.read_product(spark, vector_path)
    dim = check_vectors(made, vectors)

    final = made.withColumn("generated_at", F.lit(generated_at))
    commit = repository.write(final, "documents", run_id, is_synthetic="true")
    path = layout.collection(name, options)
    collections.ensure_collection(spark, path, collections.TWIN_PROPERTIES)
    indexed = collections.place_objects(staged, path, spark, KEY, dim)
    return {
        **scored,
        **indexed,
        "num_records": commit["num_rows"],
        "commit_id": commit["commit_id"],
        "snapshot_id": snapshot["commit_id"],
        "dimensions": counts["dimensions"],
        "size_mb": counts["size_mb"],
    }
