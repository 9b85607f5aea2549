import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import fixed, vectors
from tidemill.operators import embed, parsing, resume, scoring, search
from tidemill.session import path_exists

VALUE = T.StructType([T.StructField("value", T.LongType())])


def by_key(df, key="reference"):
    return {row[key]: row for row in df.collect()}


def scorer_with(failures):
    """Raises the listed errors one after the other for a row, then answers."""
    tried = {}

    def score(row):
        seen = tried[row["reference"]] = tried.get(row["reference"], 0) + 1
        planned = failures.get(row["reference"], [])
        if seen <= len(planned):
            raise planned[seen - 1]
        return {"value": len(row["text"]) + seen}

    return score


def run(documents, failures, **options):
    scored = scoring.score_rows(
        documents.coalesce(1), scorer_with(failures), VALUE, lambda row: {"value": -1}, **options
    )
    return by_key(scored)


def test_first_valid_attempt_counts(documents):
    rows = run(documents, {"BIS_2024_002": [ValueError("bad"), TimeoutError("slow")]})
    good = rows["BIS_2024_001"]
    assert (good["value"], good["_llm_status"], good["_llm_error"]) == (201, "success", "")
    assert (good["_llm_attempts"], good["_llm_fallback_used"], good["error_type"]) == (1, False, None)
    assert (rows["BIS_2024_002"]["_llm_attempts"], rows["BIS_2024_002"]["value"]) == (3, 203)


def test_attempts_run_out(documents):
    row = run(documents, {"BIS_2024_001": [ValueError(f"bad {i}") for i in range(9)]})["BIS_2024_001"]
    assert (row["value"], row["_llm_status"], row["_llm_attempts"]) == (-1, "failed", 5)
    assert (row["_llm_error"], row["error_type"]) == ("bad 4", fixed.VALIDATION)
    assert row["_llm_fallback_used"] is True


@pytest.mark.parametrize(
    "error, kind, attempts",
    [
        (ConnectionError("gone"), fixed.UNAVAILABLE, 1),
        (RuntimeError("odd"), fixed.UNEXPECTED, 1),
        (scoring.ScoreError("429", fixed.RATE_LIMIT), fixed.RATE_LIMIT, 2),
    ],
)
def test_errors_that_stop_at_once(documents, error, kind, attempts):
    row = run(documents, {"ECB_2024_001": [error] * 9}, max_attempts=2)["ECB_2024_001"]
    assert (row["error_type"], row["_llm_attempts"]) == (kind, attempts)


def test_missing_answer_field_is_invalid(documents):
    scored = scoring.score_rows(documents, lambda row: {}, VALUE, lambda row: {"value": 0}, max_attempts=1)
    assert set(r["error_type"] for r in scored.collect()) == {fixed.VALIDATION}


def test_threads_and_partitions_change_nothing(documents):
    score = lambda row: {"value": sum(map(ord, row["reference"]))}
    wanted = None
    for partitions, workers in [(1, 1), (2, 5), (8, 2)]:
        scored = scoring.score_rows(
            documents, score, VALUE, lambda row: {"value": 0}, workers=workers, partitions=partitions
        )
        got = {k: r["value"] for k, r in by_key(scored).items()}
        wanted = wanted or got
        assert got == wanted


def log(spark, tries):
    rows = []
    for record, outcomes in tries.items():
        for n, outcome in enumerate(outcomes):
            failed = outcome != "valid"
            rows.append(
                (record, n, outcome, outcome.upper() if failed else None, f"{outcome} {n}" if failed else None, 10)
            )
    return spark.createDataFrame(
        rows,
        "id string, at int, outcome string, error_type string, error_message string, duration_ms bigint",
    )


def test_attempt_log(spark):
    tries = {
        "ok": ["valid"],
        "later": ["retry", "retry", "valid", "fatal"],
        "stopped": ["retry", "fatal", "valid"],
        "spent": ["retry"] * 5 + ["valid"],
        "short": ["retry", "retry"],
        "many": ["retry"] * 500,
    }
    resolved = by_key(scoring.resolve_attempts(log(spark, tries), "id", ["at"]), "id")
    shown = {
        k: (r["status"], r["error_type"], r["error_message"], r["attempts"], r["duration_ms"])
        for k, r in resolved.items()
    }
    assert shown == {
        "ok": ("success", None, None, 1, 10),
        "later": ("success", None, None, 3, 30),
        "stopped": ("failed", "FATAL", "fatal 1", 2, 20),
        "spent": ("failed", "RETRY", "retry 4", 5, 50),
        "short": ("failed", "RETRY", "retry 1", 2, 20),
        "many": ("failed", "RETRY", "retry 4", 5, 50),
    }
    letters = by_key(scoring.to_dead_letter(scoring.resolve_attempts(log(spark, tries), "id", ["at"])), "id")
    assert letters["ok"]["_llm_error"] == "" and letters["spent"]["_llm_attempts"] == 5


def test_attempt_ranks_are_limited_before_the_shuffle(spark):
    resolved = scoring.resolve_attempts(log(spark, {"a": ["valid"]}), "id", ["at"])
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_settled_rows_take_fallbacks(spark):
    df = spark.createDataFrame([("a", "nothing"), ("b", "{}")], "reference string, reply string")
    parsed = parsing.parse_labels(df, "reply", "_p").drop("reply")
    rows = scoring.settle_parsed(parsed, "_p", scoring.label_fallbacks())
    row = by_key(rows)["a"]
    assert [row[name] for name in fixed.LABEL_FIELDS] == [3, 3, 0, 3]
    assert row["_llm_status"] == "failed" and row["_llm_fallback_used"]


def test_sample_enrichment(spark):
    df = spark.range(100).selectExpr("concat('C', id) AS id", "id AS n")
    profile = lambda s: s.select(
        "id",
        F.when(F.col("n") % 2 == 0, "fine").alias("ai_profile"),
        F.when(F.col("n") % 2 == 1, "busy").alias("error"),
    )
    first, again = (scoring.enrich_sample(df, profile).toPandas() for _ in range(2))
    asked = first[first.ai_profile != "Not enriched (sample limit)"]
    assert len(first) == 100 and len(asked) == 10
    assert set(asked.ai_profile) <= {"fine", "Error: busy"}
    pd.testing.assert_frame_equal(first.sort_values("id"), again.sort_values("id"))
    assert scoring.enrich_sample(df.limit(3), profile).filter("ai_profile LIKE 'Not%'").count() == 0


def test_hash_embedding_equals_the_digest(spark):
    import hashlib

    df = spark.createDataFrame([("Hello wörld",), ("",)], "t string")
    for row in df.select("t", vectors.hash_embedding("t").alias("v")).collect():
        digest = hashlib.sha256(row["t"].encode()).hexdigest()
        want = [int(digest[(i * 2) % 64 : (i * 2) % 64 + 2], 16) / 255.0 - 0.5 for i in range(1024)]
        assert row["v"] == want
    for dim in (3, 32, 40):
        assert df.select(F.size(vectors.hash_embedding("t", dim))).first()[0] == dim


def test_embedder_gets_batches_in_order(spark):
    def embedder(texts, mode):
        assert len(texts) <= 32
        return [[float(len(t)), 1.0 if mode == "query" else 0.0] for t in texts]

    df = spark.range(200).selectExpr("id", "repeat('x', CAST(id * 100 AS INT)) AS q").coalesce(1)
    for row in embed.embed_queries(df, embedder, "q").collect():
        assert row["embedding"] == [row["id"] * 100.0, 1.0]
    for row in embed.embed_queries(df, embedder, "q", limit=8192).collect():
        assert row["embedding"] == [min(row["id"] * 100.0, 8192.0), 1.0]
    with pytest.raises(Exception, match="gave 1 vectors"):
        embed.embed_column(df, lambda texts, mode: [[0.0]], "q").collect()


def test_search_ties_go_to_the_smaller_key(spark):
    rows = [(i, [float(1 + i % 3)] * 8) for i in range(50)] + [(99, [-1.0] * 8), (98, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(0, [0.1] * 8)], "query_id bigint, embedding array<float>")
    found = sorted(search.top_k(df, queries, 5).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in found] == [0, 1, 2, 3, 4]
    assert all(r["distance"] == 0.0 and r["certainty"] == 1.0 for r in found)
    everything = search.top_k(df, queries, 100).collect()
    assert len(everything) == 51 and max(r["distance"] for r in everything) == 2.0


def test_search_agrees_with_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 16)).round(3)
    df = spark.createDataFrame(
        [(i, row.tolist()) for i, row in enumerate(data)], "vec_id bigint, embedding array<double>"
    )
    queries = df.filter("vec_id < 40").withColumnRenamed("vec_id", "query_id")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    distance = np.round(1 - unit[:40] @ unit.T, 12)
    want = {
        (q, r): int(np.lexsort((np.arange(300), distance[q]))[r]) for q in range(40) for r in range(7)
    }
    for size in (64 * 2**20, 10 * 16 * 8):
        found = search.top_k(df.repartition(5), queries, 7, query_bytes=size).collect()
        assert {(r["query_id"], r["rank"] - 1): r["vec_id"] for r in found} == want


def test_dimensions_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, embedding array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        search.require_one_dim(df)
    with pytest.raises(ValueError, match="missing"):
        search.require_one_dim(spark.createDataFrame([(1, None)], "id int, embedding array<double>"))


def counting(spark, calls):
    def score(df):
        calls.append(sorted(r["reference"] for r in df.collect()))
        return df.select("reference", F.lit(True).alias("processed"))

    return score


def test_resume_skips_what_is_stored(spark, documents, folder):
    calls = []
    done = documents.filter("reference LIKE 'BIS%'").selectExpr("reference", "true AS processed")
    resume.append_results(done, folder)
    results = resume.score_with_resume(documents, counting(spark, calls), folder)
    assert calls == [["ECB_2024_001"]] and results.count() == 3
    again = resume.score_with_resume(documents, counting(spark, calls), folder)
    assert calls[1:] == [[]] and again.count() == 3
    resume.cleanup_results(spark, folder)
    assert not path_exists(spark, folder) and resume.load_results(spark, folder) is None
    resume.cleanup_results(spark, folder)


def test_a_run_that_dies_keeps_its_chunks(spark, folder):
    rows = spark.range(200).selectExpr("concat('r', id) AS reference", "id")
    calls = []

    def dies_in_third(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return df.select("reference", (F.col("id") * 2).alias("v"))

    with pytest.raises(RuntimeError, match="lost"):
        resume.score_with_resume(rows, dies_in_third, folder, chunks=4)
    kept = resume.load_results(spark, folder).count()
    assert 0 < kept < 200
    reports = []
    results = resume.score_with_resume(rows, dies_in_third, folder, chunks=4, report=reports.append)
    assert reports[-1]["processed"] == 200 - kept
    assert {r["reference"]: r["v"] for r in results.collect()} == {f"r{i}": 2 * i for i in range(200)}


def test_chunk_written_twice_counts_once(spark, documents, folder):
    rows = documents.selectExpr("reference", "title")
    resume.append_results(rows, folder)
    resume.append_results(rows.select("title", "reference"), folder)
    final = resume.finalize_results(spark, folder, "reference")
    assert final.count() == 3 and final.columns == ["reference", "title"]


def test_no_rows_is_an_error(spark, documents, folder):
    with pytest.raises(RuntimeError, match="no rows"):
        resume.score_with_resume(documents.limit(0), lambda df: df.select("reference"), folder)
