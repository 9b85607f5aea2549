"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import DOCS, LABELS, RAW, SUMMARIES, WHITE, table
from catalog.registry import query, sql_with
from tidemill.functions import fixed, text
from tidemill.operators import clean, index


@query(
    "p1_null_fill",
    "SELECT d.doc_id, d.lang, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, "
    "coalesce(l.quality / 2.0, 0.0) AS score, coalesce(l.quality = 1, false) AS is_gov, "
    "coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, '') AS note "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def p1_null_fill(spark, sf):
    joined = inputs.joined_documents(spark, sf).selectExpr(
        "doc_id",
        "lang",
        "quality",
        "toxic",
        "CAST(quality / 2.0 AS DOUBLE) AS score",
        "quality = 1 AS is_gov",
        "CASE WHEN toxic = 1 THEN 'toxic' END AS note",
    )
    return clean.fill_nulls(joined)


@query("p2_min_length", "SELECT doc_id, text, n_chars FROM documents WHERE length(text) > 100")
def p2_min_length(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return documents.filter(text.longer_than("text", 100))


@query(
    "p3_head_sample",
    "SELECT doc_id, lang, source, text FROM documents ORDER BY doc_id LIMIT 10",
)
def p3_head_sample(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return clean.head_sample(documents, ["doc_id"], 10)


@query("p4_existing_columns", "SELECT doc_id, lang, n_chars FROM documents")
def p4_existing_columns(spark, sf):
    wanted = ["doc_id", "title", "lang", "speaker", "n_chars"]
    return clean.select_existing(table(spark, sf, "documents"), wanted)


@query(
    "p5_status_renames",
    sql_with(
        LABELS,
        "SELECT reference, _llm_status AS _llm_status_class, _llm_error AS _llm_error_class, "
        "_llm_attempts AS _llm_attempts_class, _llm_fallback_used AS _llm_fallback_class "
        "FROM results",
    ),
)
def p5_status_renames(spark, sf):
    results = inputs.label_results(spark, sf).select("reference", *fixed.STATUS_COLUMNS)
    return clean.rename_strict(results, fixed.CLASS_NAMES)


@query(
    "p6_constants",
    f"SELECT doc_id, '{inputs.RUN_TIME}' AS processed_at, true AS is_synthetic FROM documents",
)
def p6_constants(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id")
    return clean.add_constants(documents, processed_at=inputs.RUN_TIME, is_synthetic=True)


@query(
    "p7_surrogate_id",
    "SELECT printf('SYNTH-%06d', row_number() OVER (ORDER BY o_orderkey) - 1) AS reference, "
    "o_orderkey, o_custkey FROM orders",
)
def p7_surrogate_id(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return index.with_synth_ids(orders, ["o_orderkey"])


@query(
    "p8_narrow_casts",
    sql_with(
        LABELS,
        "SELECT reference, CAST(monetary_stance AS TINYINT) AS monetary_stance, "
        "CAST(trade_stance AS TINYINT) AS trade_stance, "
        "CAST(tariff_mention AS TINYINT) AS tariff_mention, "
        "CAST(economic_outlook AS TINYINT) AS economic_outlook, "
        "_llm_status, _llm_error, _llm_attempts, _llm_fallback_used FROM results",
    ),
)
def p8_narrow_casts(spark, sf):
    return clean.narrow_results(inputs.label_results(spark, sf))


_CUTS = [
    fixed.EMBED_TEXT_CHARS,
    fixed.TWIN_INDEX_CHARS,
    fixed.LABEL_TEXT_CHARS,
    fixed.EMBEDDER_INPUT_CHARS,
    fixed.INDEX_TEXT_CHARS,
]


@query(
    "p9_truncate",
    "SELECT doc_id, "
    + ", ".join(
        f"md5(substring(text, 1, {n})) AS cut_{n}, length(substring(text, 1, {n})) AS len_{n}"
        for n in _CUTS
    )
    + " FROM documents",
)
def p9_truncate(spark, sf):
    columns = []
    for n in _CUTS:
        cut = text.truncate("text", n)
        columns += [F.md5(cut).alias(f"cut_{n}"), F.length(cut).cast("bigint").alias(f"len_{n}")]
    return table(spark, sf, "documents").select("doc_id", *columns)


@query(
    "p10_defaults",
    sql_with(
        [RAW],
        "SELECT reference, coalesce(nullif(title, ''), 'Untitled') AS title, "
        "coalesce(nullif(speaker, ''), 'Unknown') AS speaker FROM raw",
    ),
)
def p10_defaults(spark, sf):
    raw = inputs.raw_documents(spark, sf)
    return raw.select(
        "reference",
        text.or_default("title", "Untitled").alias("title"),
        text.or_default("speaker", "Unknown").alias("speaker"),
    )


# a third of the documents have no summary, some of those no title either
_SUMMARY = "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN text ELSE '' END"
_TITLE = "CASE WHEN doc_id % 6 = 3 THEN NULL WHEN doc_id % 12 = 2 THEN '' ELSE title END"
_EMBED = (
    "CASE WHEN coalesce(summary, '') <> '' THEN coalesce(title, '') || chr(10) || chr(10) || "
    "summary ELSE coalesce(nullif(title, ''), 'Untitled speech') END"
)
_SUMMED = f"summed AS (SELECT doc_id, reference, {_TITLE} AS title, {_SUMMARY} AS summary FROM raw)"


def _summed(spark, sf):
    return inputs.raw_documents(spark, sf).selectExpr(
        "doc_id", "reference", f"{_TITLE} AS title", f"{_SUMMARY} AS summary"
    )


@query(
    "p11_embed_text",
    sql_with(
        [RAW, _SUMMED],
        f"SELECT reference, {_EMBED} AS whole, substring({_EMBED}, 1, 1500) AS cut FROM summed",
    ),
)
def p11_embed_text(spark, sf):
    return _summed(spark, sf).select(
        "reference",
        text.embed_text("title", "summary").alias("whole"),
        text.embed_text("title", "summary", fixed.EMBED_TEXT_CHARS).alias("cut"),
    )


@query(
    "p12_twin_embed_text",
    sql_with(
        [RAW, _SUMMED],
        "SELECT reference, coalesce(title, '') || chr(10) || chr(10) || coalesce(summary, '') "
        "AS embed_text FROM summed",
    ),
)
def p12_twin_embed_text(spark, sf):
    return _summed(spark, sf).select(
        "reference", text.twin_embed_text("title", "summary").alias("embed_text")
    )


# every text gets a bell, a soft hyphen and a no-break space; a quarter is only padding
_DIRTY = (
    "CASE WHEN doc_id % 4 = 3 THEN ' ' || chr(10) || 'abc' || chr(9) ELSE "
    "chr(10) || ' ' || chr(7) || text || chr(173) || title || chr(160) || 'end' || chr(10) END"
)
_SCRUBBED = (
    f"replace(replace(replace(trim(dirty, {WHITE}), chr(7), ' '), chr(173), ' '), chr(160), ' ')"
)


@query(
    "p13_scrub",
    sql_with(
        [RAW, f"dirt AS (SELECT reference, title, {_DIRTY} AS dirty FROM raw)"],
        f"SELECT reference, CASE WHEN length({_SCRUBBED}) >= 10 THEN {_SCRUBBED} ELSE "
        "'Speech: ' || coalesce(nullif(title, ''), 'Untitled') END AS clean FROM dirt",
    ),
)
def p13_scrub(spark, sf):
    # chr() stops at 255 in Spark, which is enough here
    dirty = inputs.raw_documents(spark, sf).selectExpr("reference", "title", f"{_DIRTY} AS dirty")
    return dirty.select("reference", text.scrub("dirty", "title").alias("clean"))


CUSTOMERS = (
    "customers AS (SELECT printf('CUST-%04d', c_custkey) AS id, c_name AS name, "
    "CAST(18 + c_custkey % 58 AS INTEGER) AS age, n_name AS region, c_mktsegment AS category, "
    "c_acctbal AS spend, c_custkey % 5 <> 0 AS active "
    "FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"
)
CLEAN_CUSTOMERS = (
    "clean_customers AS (SELECT id, name, age, "
    "array_to_string(list_transform(string_split(lower(region), ' '), "
    "lambda w: upper(w[1:1]) || w[2:]), ' ') AS region, category, "
    "CASE WHEN spend > 9000 THEN 9000.0 ELSE spend END AS spend, active, "
    "CASE WHEN spend > 0 AND spend <= 1000 THEN 'Low Value' "
    "WHEN spend > 1000 AND spend <= 5000 THEN 'Medium Value' "
    "WHEN spend > 5000 THEN 'High Value' END AS tier FROM customers)"
)


def customers(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = table(spark, sf, "customer").join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return joined.selectExpr(
        "format_string('CUST-%04d', c_custkey) AS id",
        "c_name AS name",
        "CAST(18 + c_custkey % 58 AS INT) AS age",
        "n_name AS region",
        "c_mktsegment AS category",
        "c_acctbal AS spend",
        "c_custkey % 5 <> 0 AS active",
    )


@query(
    "p14_p16_customer_clean",
    sql_with([CUSTOMERS, CLEAN_CUSTOMERS], "SELECT * FROM clean_customers"),
)
def p14_p16_customer_clean(spark, sf):
    return clean.clean_customers(customers(spark, sf))


@query(
    "p14_title_case",
    "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), "
    "lambda w: upper(w[1:1]) || w[2:]), ' ') AS p_type FROM part",
)
def p14_title_case(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.title_case("p_type").alias("p_type"))


@query(
    "p15_clip",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 9000 THEN 9000.0 "
    "ELSE l_extendedprice END AS price FROM lineitem",
)
def p15_clip(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text.cap("l_extendedprice", 9000.0).alias("price")
    )


@query(
    "p16_bins",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND o_totalprice <= 1000 THEN 'Low Value' "
    "WHEN o_totalprice > 1000 AND o_totalprice <= 5000 THEN 'Medium Value' "
    "WHEN o_totalprice > 5000 THEN 'High Value' END AS tier FROM orders",
)
def p16_bins(spark, sf):
    edges = [0.0, 1000.0, 5000.0, float("inf")]
    labels = ["Low Value", "Medium Value", "High Value"]
    return table(spark, sf, "orders").select(
        "o_orderkey", text.bin_label("o_totalprice", edges, labels).alias("tier")
    )


@query(
    "p17_failed_rows",
    sql_with(LABELS, "SELECT reference, _llm_error FROM results WHERE _llm_status = 'failed'"),
)
def p17_failed_rows(spark, sf):
    results = inputs.label_results(spark, sf)
    return results.filter(F.col("_llm_status") == "failed").select("reference", "_llm_error")


@query(
    "p18_confidence",
    sql_with(
        LABELS,
        "SELECT reference, _llm_status, CASE WHEN _llm_status = 'success' THEN 'high' "
        "ELSE 'low' END AS confidence FROM results",
    ),
)
def p18_confidence(spark, sf):
    results = inputs.label_results(spark, sf).select("reference", "_llm_status")
    return clean.with_confidence(results)


@query(
    "p19_aliases",
    "SELECT doc_id, lang AS central_bank, source AS speaker, text AS content FROM documents",
)
def p19_aliases(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return clean.apply_aliases(
        documents,
        {"lang": "central_bank", "source": "speaker", "text": "content", "body": "text"},
    )


@query(
    "p20_column_defaults",
    sql_with(
        [RAW],
        "SELECT reference, coalesce(speaker, 'Unknown') AS speaker, "
        "coalesce(title, 'Untitled') AS title FROM raw",
    ),
)
def p20_column_defaults(spark, sf):
    raw = inputs.raw_documents(spark, sf).select("reference", "speaker", "title")
    return clean.default_columns(
        raw, {"speaker": "Unknown", "title": "Untitled", "central_bank": "Unknown"}
    )


@query(
    "p21_search_object",
    sql_with(
        [*DOCS, inputs.JOINED, inputs.RESULTS],
        "SELECT c.reference, c.date, c.central_bank, c.speaker, c.title, "
        "c.text, r.monetary_stance, r.trade_stance, "
        "r.tariff_mention = 1 AS tariff_mention, r.economic_outlook, c.is_gov AS is_governor "
        "FROM cleaned c JOIN results r ON c.reference = r.reference",
    ),
)
def p21_search_object(spark, sf):
    documents = clean.clean_documents(inputs.raw_documents(spark, sf))
    labels = inputs.label_results(spark, sf).select("reference", *fixed.LABEL_FIELDS)
    return clean.document_objects(documents.join(labels, "reference", "left"))


@query(
    "p21_twin_object",
    sql_with(
        [RAW, SUMMARIES],
        "SELECT r.reference, r.date, r.central_bank AS country, "
        "coalesce(r.speaker, 'Unknown') AS author, r.title, "
        "s.summary, 3 AS monetary_stance, 3 AS trade_stance, "
        "false AS tariff_mention, 3 AS economic_outlook, coalesce(r.is_gov, false) AS is_gov, "
        "true AS is_synthetic FROM raw r JOIN summaries s ON r.reference = s.reference",
    ),
)
def p21_twin_object(spark, sf):
    summaries = inputs.summary_results(spark, sf).select("reference", "summary")
    documents = inputs.raw_documents(spark, sf).join(summaries, "reference", "left")
    return clean.twin_objects(
        clean.apply_aliases(documents, {"central_bank": "country", "speaker": "author"})
    )


@query(
    "p22_label_prompt",
    "SELECT doc_id, 'Analyze this central bank speech:' || chr(10) || chr(10) || "
    "text AS prompt FROM documents",
)
def p22_label_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.label_prompt("text").alias("prompt"))


@query(
    "p22_summary_prompt",
    sql_with(
        [RAW],
        "SELECT reference, 'Summarize this central bank speech in a few bullet points.' || "
        "chr(10) || chr(10) || 'Speech: ' || coalesce(nullif(title, ''), 'Untitled') || chr(10) || "
        "'Speaker: ' || coalesce(nullif(speaker, ''), 'Unknown') || ' (' || central_bank || ')' || "
        "chr(10) || chr(10) || 'Text excerpt:' || chr(10) || text || chr(10) "
        "|| chr(10) || 'Provide your reasoning first, then a bullet-point summary of the key "
        "points.' || chr(10) || 'The summary should be a single text string with bullet points "
        "(using • or -), not a JSON array.' AS prompt FROM raw",
    ),
)
def p22_summary_prompt(spark, sf):
    return inputs.raw_documents(spark, sf).select(
        "reference", text.summary_prompt().alias("prompt")
    )


@query(
    "p22_profile_prompt",
    sql_with(
        [CUSTOMERS, CLEAN_CUSTOMERS],
        "SELECT id, 'Generate a brief customer profile (1 sentence) for:' || chr(10) || '- Age: ' "
        "|| CAST(age AS VARCHAR) || ', Region: ' || region || ', Category: ' || category || "
        "', Tier: ' || coalesce(tier, '') || chr(10) || 'Be concise.' AS prompt "
        "FROM clean_customers",
    ),
)
def p22_profile_prompt(spark, sf):
    cleaned = clean.clean_customers(customers(spark, sf))
    return cleaned.select("id", text.render(fixed.PROFILE_PROMPT, {}).alias("prompt"))
