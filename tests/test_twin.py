import pytest
from pyspark.sql import functions as F

from tidemill.config import TRIAL_RUN, Layout
from tidemill.functions import masks, vectors
from tidemill.operators import privacy, twin
from tidemill.plans import customers, twins
from tidemill.plans.documents import DocumentSteps, label_replies, run_documents, summary_replies
from tidemill.sources import collections, files, samples
from tidemill.sources.versions import Repository


@pytest.fixture
def source(spark):
    return spark.range(600).selectExpr(
        "format_string('DOC-%04d', id) AS reference",
        "concat('day ', id % 50) AS date",
        "IF(id % 3 = 0, 'FED', concat('B', id % 7)) AS country",
        "IF(id % 11 = 0, NULL, concat('author ', id)) AS author",
        "CAST(1 + id % 5 AS INT) AS monetary_stance",
        "CAST(1 + id % 4 AS INT) AS trade_stance",
        "IF(id % 13 = 0, NULL, CAST(1 + id % 3 AS INT)) AS economic_outlook",
        "CAST(id % 2 AS INT) AS tariff_mention",
        "id % 4 = 0 AS is_gov",
        "concat('summary ', id) AS summary",
    )


def test_roles(source):
    roles = twin.infer_roles(source, "reference")
    assert roles.categorical == ["date", "country", "author", "summary"]
    assert roles.numeric == ["monetary_stance", "trade_stance", "economic_outlook"]
    assert roles.binary == ["tariff_mention", "is_gov"]
    assert roles.bounds["trade_stance"] == (1, 5)


@pytest.mark.parametrize("digits", [1, 3])
def test_twin_invariants(spark, source, digits):
    roles = twin.infer_roles(source, "reference")
    made = twin.make_twin(source, roles, "reference", 7, digits).cache()
    rows, real = made.collect(), source.collect()
    assert made.columns == [*source.columns, "is_synthetic"]
    assert sorted(r["reference"] for r in rows) == [f"SYNTH-{i:06d}" for i in range(600)]
    for name in roles.categorical:
        assert sorted(str(r[name]) for r in rows) == sorted(str(r[name]) for r in real)
        assert [r[name] for r in rows] != [r[name] for r in real]
    for name in roles.numeric:
        assert {r[name] for r in rows} <= {None, 1, 2, 3, 4, 5}
        assert sum(r[name] is None for r in rows) == sum(r[name] is None for r in real)
    assert {r["tariff_mention"] for r in rows} == {0, 1}
    assert all(r["is_synthetic"] for r in rows)


def test_perturbation_stays_close_and_flips_a_fifth(source):
    roles = twin.infer_roles(source, "reference")
    pairs = twin.perturb(source, "reference", roles, 7).alias("t").join(source.alias("s"), "reference")
    row = pairs.agg(
        F.max(F.abs(F.col("t.monetary_stance") - F.col("s.monetary_stance"))),
        F.avg((F.col("t.is_gov") != F.col("s.is_gov")).cast("int")),
        F.avg((F.col("t.monetary_stance") != F.col("s.monetary_stance")).cast("int")),
    ).first()
    assert row[0] == 1 and 0.14 < row[1] < 0.26 and 0.4 < row[2] < 0.75


def test_twin_is_the_same_for_any_partitioning(source):
    roles = twin.infer_roles(source, "reference")
    made = [
        sorted(map(str, twin.make_twin(source.repartition(n), roles, "reference", 7).collect()))
        for n in (1, 2, 8)
    ]
    assert made[0] == made[1] == made[2]
    other = sorted(map(str, twin.make_twin(source, roles, "reference", 8).collect()))
    assert other != made[0]


def test_holdout(source):
    training, held = twin.holdout_split(source)
    assert held.count() > 0 and training.count() + held.count() == 600
    training, held = twin.holdout_split(source.limit(499), minimum=500)
    assert held.count() == 0 and training.count() == 499


def test_scores_of_a_copy_and_of_a_stranger(spark, source):
    columns = ["country", "monetary_stance", "is_gov"]
    copy = privacy.scores(source, source, columns, ["country"], "monetary_stance", columns)
    assert copy["mia_score"] == 0.0 and copy["quality_score"] == 1.0 and not copy["privacy_passed"]
    stranger = source.withColumn("country", F.lit("X"))
    far = privacy.scores(source, stranger, columns, ["country"], "monetary_stance", columns)
    assert far["mia_score"] == 1.0 and far["aia_score"] == 1.0 and far["privacy_passed"]
    gaps = {r["column"]: r["distance"] for r in privacy.marginal_distances(source, stranger, columns).collect()}
    assert gaps["country"] == pytest.approx(1.0) and gaps["is_gov"] == 0.0


def test_guess_is_the_most_frequent_value(spark):
    real = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), (None, 4)], "q string, t int")
    synthetic = spark.createDataFrame([("a", 1), ("a", 2), (None, 4), (None, 4), (None, 5)], "q string, t int")
    row = privacy.inference_rate(real, synthetic, ["q"], "t").first()
    assert (row["real_rows"], row["guessed_rows"]) == (5, 3)
    empty = privacy.leak_rate(real, synthetic.limit(0), ["q", "t"]).first()
    assert (empty["twin_rows"], empty["leak_rate"]) == (0, 0.0)


def test_report_fills_missing_scores(source):
    report = privacy.evaluation_report(source, source, {"mia_score": None}, "now", "j").first()
    assert (report["mia_score"], report["privacy_passed"], report["holdout_disabled"]) == (0.0, False, False)
    assert report["includes_summary"] and report["report_version"] == "3.0"


def test_masks(spark):
    text = (
        "Mail a.b+c@mail.example.com or x@y.org, call +1 (743) 555-3824, "
        "host 70.23.22.57, card 2123465659789240 or 2123-4656-5978-9240."
    )
    row = masks.mask_text(spark.createDataFrame([(text,), (None,)], "text string")).first()
    assert row["text"] == "Mail [EMAIL] or [EMAIL], call [PHONE], host [IP], card [CARD] or [CARD]."
    assert (row["emails"], row["ips"], row["cards"], row["phones"]) == (2, 1, 2, 1)


def test_phones_without_brackets(spark):
    texts = ["at 555-123-4567 now", "or +44 20 7946 0958.", "not 12-34 or 2024-01-02"]
    rows = masks.mask_text(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r["text"] for r in rows] == ["at [PHONE] now", "or [PHONE].", "not 12-34 or 2024-01-02"]


REPLY = (
    '<|channel|>final<|message|>{"monetary_stance": "hawkish", "trade_stance": "neutral", '
    '"tariff_mention": 1, "economic_outlook": "positive"}<|return|>'
)


def steps(reply=REPLY):
    return DocumentSteps(
        label=lambda df: label_replies(df.withColumn("reply", F.lit(reply))),
        summary=lambda df: summary_replies(
            df.withColumn(
                "reply",
                F.concat(F.lit('{"reasoning": "r", "summary": "'), F.repeat("title", 12), F.lit('"}')),
            )
        ),
        embed=lambda df: df.withColumn("embedding", vectors.hash_embedding("embed_text", 16)),
    )


def test_documents_then_twin(spark, documents, folder):
    many = documents.crossJoin(spark.range(20)).withColumn(
        "reference", F.concat("reference", F.lit("-"), F.col("id").cast("string"))
    ).drop("id")
    layout = Layout(folder)
    silent = lambda line: None
    full = run_documents(many, steps(), layout, "2024-05-01T00:00:00", log=silent)
    assert (full["num_records"], full["tariff_mentions"], full["object_count"]) == (60, 60, 60)
    assert full["governor_speeches"] == 40 and full["vector_dimensions"] == 16
    trial = run_documents(many, steps(), layout, "2024-05-01T00:00:00", TRIAL_RUN, log=silent)
    assert trial["num_records"] == 10 and trial["collection"] != full["collection"]
    assert files.read_product(spark, full["product"]).count() == 60

    product = files.read_product(spark, full["product"])
    embed = lambda df: df.withColumn("embedding", vectors.hash_embedding("embed_text", 16))
    made = twins.run_twin(product, embed, layout, "2024-05-02T00:00:00", log=silent)
    assert (made["num_records"], made["object_count"], made["dimensions"]) == (60, 60, 16)
    assert made["collection"] not in (full["collection"], trial["collection"])
    stored = collections.read_collection(spark, made["collection"])
    assert stored.filter("NOT is_synthetic OR reference NOT LIKE 'SYNTH-%'").count() == 0
    repository = Repository(spark, layout.twin("versions"))
    assert repository.read("documents", made["commit_id"]).count() == 60
    report = files.read_report(spark, layout.twin("validation_report"))
    assert report["total_records"] == 60 and report["holdout_disabled"] is False
    with pytest.raises(ValueError, match="summary"):
        twins.twin_source(product.drop("summary"))


def test_job_stops_when_every_label_failed(spark, documents, folder):
    with pytest.raises(RuntimeError, match="Classification failed for all 3 rows"):
        run_documents(documents, steps("no json"), Layout(folder), "now", log=lambda line: None)


def test_customer_job(spark, folder):
    people = samples.sample_customers(spark, 100)
    profile = lambda s: s.select("id", F.lit("fine").alias("ai_profile"), F.lit(None).cast("string").alias("error"))
    answer = customers.run_customers(people, profile, folder)
    assert answer["total_records"] == 100 and answer["enriched_count"] == 10
    assert sum(answer["region_distribution"].values()) == 100 and answer["storage_error"] is None
    assert files.read_report(spark, folder)["tier_distribution"] == answer["tier_distribution"]
    rows = spark.read.parquet(f"{folder}-distributions").filter("column = 'tier'").collect()
    assert {r["value"]: r["count"] for r in rows} == answer["tier_distribution"]
    assert answer["tier_values"] == len(rows)
    long = customers.customer_report(customers.enrich_customers(people, profile), listed=2).first()
    assert long["region_distribution"] is None and long["region_values"] > 2
    lost = customers.run_customers(people, profile, "nowhere://bucket/x", log=lambda line: None)
    assert lost["total_records"] == 100 and lost["storage_error"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_compared_and_permuted_without_moving(spark, source):
    roles = twin.infer_roles(source, "reference")
    made = twin.make_twin(source, roles, "reference", 7)
    for column in roles.categorical:  # all values are kept, each column in the order of its digests
        order = lambda name: F.md5(F.concat_ws("|", "reference", F.lit("7"), F.lit(name)))
        want = [r[0] for r in source.orderBy(order(column)).select(column).collect()]
        assert [r[0] for r in made.orderBy("reference").select(column).collect()] == want
    assert twin.longest_column(source, roles.categorical) == "summary"
    cells = twin.permuted_columns(source, "reference", ["author", "summary"], 7, sent={"summary": "reference"})
    assert cells.filter("summary NOT LIKE 'DOC-%'").isEmpty()

    schema = "a string, b double, c string, d array<int>"
    real = spark.createDataFrame([("1:x", 0.0, None, [1]), (None, 1.5, "", [2]), ("a", 2.0, "b", [3])], schema)
    other = spark.createDataFrame([("1:x", -0.0, None, [1]), ("", 1.5, None, [2]), ("ab", 2.0, "", [3]), ("a", 2.0, "b", [4])], schema)
    leaked = privacy.leak_rate(real, other, ["a", "b", "c", "d"])
    assert (leaked.first()["twin_rows"], leaked.first()["leaked_rows"]) == (4, 1)
    assert not [line for line in _plan(leaked).splitlines() if "Exchange hashpartitioning" in line and "c#" in line]


def test_texts_do_not_move_to_meet_their_vectors(spark, documents, folder):
    plans, layout = [], Layout(folder)

    def embed(rows):
        plans.append(_plan(rows))
        return rows.withColumn("embedding", vectors.hash_embedding("embed_text", 16))

    silent = lambda line: None
    run = lambda step, where: run_documents(documents, DocumentSteps(steps().label, steps().summary, step), where, "now", log=silent)
    full = run(embed, layout)
    narrow = run(lambda rows: embed(rows).select("reference", "embedding"), Layout(f"{folder}/narrow"))
    assert not any("Exchange" in plan or "Join" in plan for plan in plans) and len(plans) == 2
    rows = [collections.read_collection(spark, r["collection"]) for r in (full, narrow)]
    assert rows[0].columns == rows[1].columns and sorted(map(str, rows[0].collect())) == sorted(map(str, rows[1].collect()))
    again = run(embed, layout)
    assert again["object_count"] == full["object_count"] == 3
    for place in (layout, Layout(f"{folder}/narrow")):
        assert files.read_product(spark, place.product("embeddings")).columns == ["reference", "embedding"]
        assert files.read_product(spark, place.product("labels")).count() == 3
