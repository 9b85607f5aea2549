"""Sources and sinks. Each query writes what it read and answers from the stored copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.answers import RESOLVED_SQL, WORDS_SQL, score_words
from catalog.counts import PROGRESS_SQL
from catalog.inputs import LABELS, table
from catalog.registry import query, sql_with
from catalog.twins import TWIN_SQL, made
from tidemill.config import TRIAL_RUN, Layout
from tidemill.functions import vectors
from tidemill.operators import clean, resume, stats
from tidemill.plans import documents as document_job
from tidemill.session import work_dir
from tidemill.sources import collections, files
from tidemill.sources.versions import Repository
from tidemill.streaming.arrivals import process_arrivals
from tidemill.streaming.attempts import first_arrivals, settle_attempts

_DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"
_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, sf):
    return table(spark, sf, "documents").select(*_COLUMNS)


@query(
    "s1_csv_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def s1_csv_scan(spark, sf):
    """Orders as a CSV folder with a header, read back with a declared schema."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    folder = work_dir(spark, "csv")
    orders.write.option("header", True).csv(f"{folder}/orders.csv")
    return files.read_csv_folder(spark, folder, orders.schema)


@query("s2_s3_product", _DOCUMENTS)
def s2_s3_product(spark, sf):
    path = Layout(work_dir(spark, "product")).product("documents")
    files.write_product(documents(spark, sf), path)
    return files.read_product(spark, path)


@query(
    "s4_trial_apart",
    f"SELECT 'full' AS run, count(*) AS rows FROM documents UNION ALL SELECT 'trial', count(*) "
    "FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 10)",
)
def s4_trial_apart(spark, sf):
    layout = Layout(work_dir(spark, "trial"))
    everything = documents(spark, sf)
    files.write_product(everything, layout.product("documents"))
    sample = clean.head_sample(everything, ["doc_id"], TRIAL_RUN.sample_size)
    files.write_product(sample, layout.product("documents", TRIAL_RUN))
    full = files.read_product(spark, layout.product("documents"))
    trial = files.read_product(spark, layout.product("documents", TRIAL_RUN))
    counted = lambda df, run: df.agg(
        F.lit(run).alias("run"), F.count(F.lit(1)).alias("rows")
    )
    return counted(full, "full").unionByName(counted(trial, "trial"))


@query(
    "s5_versioned",
    "SELECT 'documents' AS product, CAST(0 AS BIGINT) AS seq, count(*) AS num_rows, "
    "CAST(5 AS INTEGER) AS num_columns, 'first' AS run_id FROM documents UNION ALL "
    "SELECT 'documents', 1, count(*), 5, 'third' FROM documents WHERE length(text) > 100",
)
def s5_versioned(spark, sf):
    """Three writes, the second without a change: two commits."""
    repository = Repository(spark, work_dir(spark, "versions"))
    rows = documents(spark, sf)
    repository.write(rows, "documents", "first")
    repository.write(rows.repartition("doc_id"), "documents", "second")
    repository.write(clean.clean_documents(rows), "documents", "third")
    return repository.log("documents").select(
        "product", "seq", "num_rows", "num_columns", F.col("metadata")["run_id"].alias("run_id")
    )


@query("s6_read_at_commit", _DOCUMENTS)
def s6_read_at_commit(spark, sf):
    """The first version, read after a second one was committed."""
    repository = Repository(spark, work_dir(spark, "versions"))
    first = repository.write(documents(spark, sf), "documents")
    repository.write(clean.clean_documents(documents(spark, sf)), "documents")
    return repository.read("documents", first["commit_id"])


@query("s6_read_at_main", _DOCUMENTS + " WHERE length(text) > 100")
def s6_read_at_main(spark, sf):
    repository = Repository(spark, work_dir(spark, "versions"))
    repository.write(documents(spark, sf), "documents")
    repository.write(clean.clean_documents(documents(spark, sf)), "documents")
    return repository.read("documents")


@query("s7_intermediate", "SELECT vec_id, len(embedding) AS n, label FROM embeddings")
def s7_intermediate(spark, sf):
    path = Layout(work_dir(spark, "intermediate")).snapshot("vectors")
    files.write_product(table(spark, sf, "embeddings"), path)
    stored = files.read_product(spark, path)
    return stored.select("vec_id", F.size("embedding").cast("bigint").alias("n"), "label")


@query(
    "s8_report",
    sql_with(
        LABELS,
        "SELECT stamp, count(*) AS total_processed, count(*) FILTER (WHERE _llm_status = 'failed') "
        "AS failed FROM results, (VALUES ('latest'), ('20240501')) t(stamp) GROUP BY stamp",
    ),
)
def s8_report(spark, sf):
    folder = work_dir(spark, "report")
    files.write_report(stats.success_summary(inputs.label_results(spark, sf)), folder, "20240501")
    found = spark.read.json([f"{folder}/latest", f"{folder}/20240501"])
    stamp = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return found.select(stamp.alias("stamp"), "total_processed", "failed")


@query(
    "s9_snapshot",
    "SELECT count(*) AS num_records, CAST(64 AS INTEGER) AS dimensions FROM documents",
)
def s9_snapshot(spark, sf):
    rows = documents(spark, sf).select("doc_id", vectors.hash_embedding("text", 64).alias("embedding"))
    path = f"{work_dir(spark, 'snapshot')}/embeddings"
    return files.write_snapshot(rows, path, "doc_id").drop("size_mb")


@query("s10_twin_snapshot", sql_with(TWIN_SQL, "SELECT * FROM twin"))
def s10_twin_snapshot(spark, sf):
    repository = Repository(spark, work_dir(spark, "twin"))
    repository.write(made(spark, sf), "summaries", snapshot_type="synthetic_summaries")
    return repository.read("summaries")


def _objects(spark, sf):
    raw = clean.clean_documents(inputs.raw_documents(spark, sf))
    embedded = raw.withColumn("embedding", vectors.hash_embedding("title", 64))
    path = f"{work_dir(spark, 'objects')}/objects"
    return document_job.stored(clean.document_objects(embedded), path)


@query(
    "s11_collection",
    sql_with(
        inputs.DOCS,
        "SELECT reference, date, central_bank, speaker, title, text, "
        "3 AS monetary_stance, 3 AS trade_stance, false AS tariff_mention, 3 AS economic_outlook, "
        "is_gov AS is_governor, CAST(64 AS INTEGER) AS dim FROM cleaned",
    ),
)
def s11_collection(spark, sf):
    """Loaded twice: the second load adds nothing."""
    path = Layout(work_dir(spark, "collection")).collection("documents")
    collections.ensure_collection(spark, path, collections.DOCUMENT_PROPERTIES)
    objects = _objects(spark, sf)
    collections.load_collection(objects, path)
    collections.load_collection(objects, path)
    stored = collections.read_collection(spark, path)
    return stored.withColumn("dim", F.size("embedding")).drop("embedding")


@query(
    "s11_append",
    sql_with(inputs.DOCS, "SELECT reference, CAST(2 AS BIGINT) AS copies FROM cleaned"),
)
def s11_append(spark, sf):
    """Append mode keeps both loads."""
    path = Layout(work_dir(spark, "collection")).collection("documents")
    objects = _objects(spark, sf)
    for _ in range(2):
        collections.load_collection(objects, path, mode="append")
    stored = collections.read_collection(spark, path)
    return stored.groupBy("reference").agg(F.count(F.lit(1)).alias("copies"))


# by the code of the key's last character: every third is replaced, every fifth deleted
_CHANGED_SQL = sql_with(
    inputs.DOCS,
    "SELECT reference, CASE WHEN n % 3 = 0 THEN 'changed ' || title ELSE title END AS title, "
    "CAST(16 AS INTEGER) AS dim FROM (SELECT *, ascii(right(reference, 1)) AS n FROM cleaned) WHERE n % 5 <> 0",
)


def _changed_collection(spark, sf):
    path = Layout(work_dir(spark, "collection")).collection("documents")
    last = F.ascii(F.right("reference", F.lit(1)))
    objects = _objects(spark, sf).select("reference", "title").withColumn("embedding", vectors.hash_embedding("title", 16))
    collections.load_collection(objects, path)
    changed = objects.filter(last % 3 == 0).withColumn("title", F.concat(F.lit("changed "), "title"))
    collections.load_collection(changed, path, mode="replace")
    collections.delete_objects(objects.filter(last % 5 == 0).select("reference"), path)
    return path


@query("s11_replace", _CHANGED_SQL)
def s11_replace(spark, sf):
    """Replaced and deleted objects, folded on read; the loaded files stay as they are."""
    stored = collections.read_collection(spark, _changed_collection(spark, sf))
    return stored.select("reference", "title", F.size("embedding").alias("dim"))


@query("s11_compact", _CHANGED_SQL)
def s11_compact(spark, sf):
    """The same after the changes were folded into one base and dropped."""
    path = _changed_collection(spark, sf)
    collections.compact_collection(spark, path)
    collections.drop_folded(spark, path)
    stored = collections.read_collection(spark, path)
    return stored.select("reference", "title", F.size("embedding").alias("dim"))


@query(
    "s12_ensure_collection",
    "SELECT true AS created, false AS created_again, count(*) AS objects FROM documents",
)
def s12_ensure_collection(spark, sf):
    """Declared once; a second declaration leaves the loaded rows alone."""
    path = Layout(work_dir(spark, "collection")).collection("documents")
    created = collections.ensure_collection(spark, path, collections.DOCUMENT_PROPERTIES)
    raw = inputs.raw_documents(spark, sf)
    embedded = raw.withColumn("embedding", vectors.hash_embedding("title", 16))
    collections.load_collection(clean.document_objects(embedded), path)
    again = collections.ensure_collection(spark, path, {"reference": "text"})
    stored = collections.read_collection(spark, path)
    return stored.agg(
        F.lit(created).alias("created"),
        F.lit(again).alias("created_again"),
        F.count(F.lit(1)).alias("objects"),
    )


@query(
    "s13_kinds",
    " UNION ALL ".join(
        f"SELECT '{name}' AS property, '{kind}' AS kind, count({name}) AS filled FROM orders"
        for name, kind in [
            ("o_orderkey", "int"),
            ("o_custkey", "int"),
            ("o_orderstatus", "text"),
            ("o_totalprice", "number"),
            ("o_orderdate", "text"),
            ("o_orderpriority", "text"),
        ]
    ),
)
def s13_kinds(spark, sf):
    return collections.describe_properties(table(spark, sf, "orders"))


@query(
    "s14_count_delete",
    sql_with(
        inputs.DOCS,
        "SELECT count(*) AS before, true AS existed, CAST(0 AS BIGINT) AS after, "
        "false AS existed_again FROM cleaned",
    ),
)
def s14_count_delete(spark, sf):
    path = Layout(work_dir(spark, "collection")).collection("documents")
    collections.load_collection(_objects(spark, sf), path)
    before = collections.count_objects(spark, path)
    existed = collections.delete_collection(spark, path)
    after = collections.count_objects(spark, path)
    again = collections.delete_collection(spark, path)
    row = [(before, existed, after, again)]
    schema = "before bigint, existed boolean, after bigint, existed_again boolean"
    return spark.createDataFrame(row, schema)


@query("a16_object_count", "SELECT count(*) AS objects FROM embeddings")
def a16_object_count(spark, sf):
    path = Layout(work_dir(spark, "collection")).collection("vectors")
    collections.load_collection(table(spark, sf, "embeddings"), path, "vec_id")
    count = collections.count_objects(spark, path)
    return spark.createDataFrame([(count,)], "objects bigint")


@query(
    "s15_required_columns",
    sql_with(LABELS, "SELECT reference, monetary_stance, trade_stance FROM results"),
)
def s15_required_columns(spark, sf):
    needed = ["reference", "monetary_stance", "trade_stance"]
    return clean.require_columns(inputs.label_results(spark, sf), needed).select(*needed)


# --- resumable work -----------------------------------------------------------------


@query("k_resume", f"WITH {WORDS_SQL} SELECT * FROM scored")
def k_resume(spark, sf):
    """Labelled documents first, as if a run had died; then the rest, in three chunks."""
    store = Layout(work_dir(spark, "resume")).results("words", "run-1")
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang")
    known = table(spark, sf, "labels").select("doc_id")
    resume.append_results(score_words(rows.join(known, "doc_id", "left_semi")), store)
    return resume.score_with_resume(rows, score_words, store, "doc_id", chunks=3)


@query(
    "k2_remaining",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
    "WHERE l.doc_id IS NULL",
)
def k2_remaining(spark, sf):
    store = Layout(work_dir(spark, "resume")).results("labels", "run-1")
    resume.append_results(table(spark, sf, "labels"), store)
    done = resume.load_results(spark, store)
    return resume.remaining_rows(table(spark, sf, "documents").select("doc_id"), done, "doc_id")


@query("k5_finalize", _DOCUMENTS)
def k5_finalize(spark, sf):
    """One chunk stored twice, the second time with its columns in another order."""
    store = Layout(work_dir(spark, "resume")).results("documents", "run-1")
    rows = documents(spark, sf)
    resume.append_results(rows, store)
    resume.append_results(rows.select(*reversed(rows.columns)), store)
    return resume.finalize_results(spark, store, "doc_id")


@query(
    "k6_cleanup",
    "SELECT count(*) AS stored, true AS gone FROM documents",
)
def k6_cleanup(spark, sf):
    store = Layout(work_dir(spark, "resume")).results("documents", "run-1")
    stored = resume.append_results(documents(spark, sf), store)["rows"]
    resume.cleanup_results(spark, store)
    row = [(stored, resume.load_results(spark, store) is None)]
    return spark.createDataFrame(row, "stored bigint, gone boolean")


@query(
    "k7_progress",
    f"WITH {WORDS_SQL} SELECT count(*) AS processed, "
    "count(*) FILTER (WHERE _llm_status = 'failed') AS failed, "
    "count(*) FILTER (WHERE _llm_status = 'success') AS success FROM scored",
)
def k7_progress(spark, sf):
    """The last of the progress reports of a run in four chunks."""
    store = Layout(work_dir(spark, "resume")).results("words", "run-1")
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang")
    reports = []
    resume.score_with_resume(rows, score_words, store, "doc_id", 4, reports.append)
    schema = "processed bigint, failed bigint, success bigint"
    return spark.createDataFrame([reports[-1]], schema)


def _arriving(rows, folder, least, file_rows):
    """Write rows as `least` files, more where a file would hold over `file_rows`; how many."""
    files = max(least, -(-rows.count() // file_rows))
    rows.repartition(files).write.mode("append").parquet(folder)
    return files


@query(
    "k_stream_arrivals",
    sql_with(
        inputs.DOCS,
        "SELECT reference, title, length(text) AS chars, is_gov FROM cleaned",
    ),
)
def k_stream_arrivals(spark, sf):
    """The cleaning step on a stream of files, run until everything present is done."""
    folder = work_dir(spark, "stream")
    rows = inputs.raw_documents(spark, sf)
    files = _arriving(rows, f"{folder}/in", 4, 20_000)

    def transform(df):
        cleaned = clean.clean_documents(df)
        return cleaned.select(
            "reference", "title", F.length("text").cast("bigint").alias("chars"), "is_gov"
        )

    def work_off():
        return process_arrivals(
            spark, f"{folder}/in", rows.schema, transform, f"{folder}/out", f"{folder}/state", files // 2
        )

    work_off()
    return work_off()


@query("l10_stream_attempts", RESOLVED_SQL)
def l10_stream_attempts(spark, sf):
    """The tries as files in any order; a heartbeat behind the last one settles all records."""
    folder = work_dir(spark, "tries")
    log = inputs.attempt_log(spark, sf)
    files = _arriving(log, f"{folder}/in", 3, 250_000)
    beat = log.agg((F.max("ts") + F.expr("INTERVAL 20000 DAYS")).alias("ts"))
    beat = beat.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema])
    beat.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    pause = 86400.0 * 5000
    settle = lambda rows: settle_attempts(rows, "record_id", "ts", "event_id", "5000 days", pause, pause)
    return process_arrivals(spark, f"{folder}/in", log.schema, settle, f"{folder}/out", f"{folder}/state", files * 2 // 3)


@query(
    "k2_stream_once",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
    "WHERE l.doc_id IS NULL",
)
def k2_stream_once(spark, sf):
    """Documents that arrive twice, some of them settled before the stream began."""
    folder = work_dir(spark, "once")
    rows = table(spark, sf, "documents").selectExpr("doc_id", "timestamp_seconds(1700000000 + pmod(doc_id, 60)) AS arrived")
    for _ in range(2):
        files = _arriving(rows, f"{folder}/in", 3, 250_000)
    settled = table(spark, sf, "labels")
    once = lambda df: first_arrivals(df, "doc_id", "arrived", "1 day", settled).select("doc_id")
    return process_arrivals(spark, f"{folder}/in", rows.schema, once, f"{folder}/out", f"{folder}/state", files * 2 // 3)


@query("k7_stored_progress", PROGRESS_SQL)
def k7_stored_progress(spark, sf):
    """Two chunks with a look after each: the second look counts the second chunk's files only."""
    folder = work_dir(spark, "progress")
    rows = inputs.label_results(spark, sf)
    early = F.pmod(F.xxhash64("reference"), F.lit(2)) == 0
    for part in (early, ~early):
        resume.append_results(rows.filter(part), f"{folder}/results")
        found = resume.stored_progress(spark, f"{folder}/results", f"{folder}/ledger", mock_mode=True)
    return found
