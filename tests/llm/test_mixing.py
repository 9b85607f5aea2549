import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing
from tools.compare import compare, connect


def test_targets_reshare_until_none_is_above(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 20), ("d", 500), (None, 5)]
    df = spark.createDataFrame(sizes, "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    weights, caps = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {k: 3 * v for k, v in sizes}
    left, free, want = sum(v for _, v in sizes), set(caps), {}
    while True:
        share = {k: left * weights[k] / sum(weights[x] for x in free) for k in free}
        above = {k for k in free if share[k] > caps[k]}
        if not above:
            want |= share
            break
        want |= {k: caps[k] for k in above}
        left -= sum(caps[k] for k in above)
        free -= above
    assert got == pytest.approx(want)


def test_taken_is_near_target_and_capped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs, "doc_id", "text", "source").collect()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    for source, want in target.items():
        assert taken[source] == pytest.approx(want, rel=0.15)


def test_reruns_and_partitions_agree(spark, documents):
    one = mixing.mix(documents, "doc_id", "text", "source").collect()
    two = mixing.mix(documents.repartition(7), "doc_id", "text", "source").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_odd_rows(odd, empty, spark):
    rows = mixing.mix(odd, "doc_id", "text", "source").collect()
    assert len(rows) == odd.count()
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(empty, "doc_id", "text", "source").count() == 0
    emitted = mixing.emit(odd.filter("doc_id <> 7"), "doc_id", "text", "source")
    assert emitted.columns == odd.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(odd.filter("doc_id <> 7"), "doc_id", "text", "source").collect()}
    assert {r["doc_id"]: r["n"] for r in emitted.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in copies.items() if v}


def test_emit_counts_rows_that_share_a_key(spark):
    rows = [(None, f"w{i} " * (i % 3 + 1), "a") for i in range(20)] + [(1, f"v{i}", "b") for i in range(20)] + [(2, "same", "b")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = mixing.mix(docs, "doc_id", "text", "source").groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    emitted = mixing.emit(docs, "doc_id", "text", "source")
    assert emitted.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in emitted.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r["doc_id"]: r["n"] for r in copies}
    distinct = emitted.filter("doc_id is null or doc_id = 1").groupBy("doc_id", "text").count()
    assert distinct.agg(F.max("count")).first()[0] <= 3
    again = mixing.emit(docs.repartition(5), "doc_id", "text", "source")
    assert sorted(map(str, emitted.collect())) == sorted(map(str, again.collect()))


def test_weights_are_a_setting(spark, tmp_path, odd):
    settings = mixing.MixSettings(weights=(1.0, 5.0), most_copies=2.0)
    odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    connection = connect(str(tmp_path))
    connection.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")

    def run(spark, sf):
        df = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", "source", settings)
        return df.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

    assert compare(spark, connection, "mix", run, mixing.mix_sql(settings), str(tmp_path)).startswith("ok")
