import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_neardup import brute as groups
from tidemill.llm import mixing


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_stage_against_its_own_input(spark, sf, documents):
    docs, columns = documents, documents.columns
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        source = docs
        docs = stage(spark, docs, sf)
        if name != "tokens":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = docs.collect()
        ids = [r["doc_id"] for r in after]
        if name == "language":
            letters = {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
            assert set(ids) <= letters and len(ids) >= 0.98 * len(letters)
        elif name == "near-duplicates":
            kept = groups([(i, r["text"]) for i, r in before.items()], 5)
            assert sorted(ids) == sorted(i for i, x in kept.items() if x[2])
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            gone = {d for d, _ in leaks([(i, r["text"]) for i, r in before.items()], items)}
            assert gone and sorted(ids) == sorted(set(before) - gone)
        elif name == "mixing":
            mixed = mixing.mix(source, "doc_id", "text", "source").filter("copies > 0").collect()
            want = {r["doc_id"]: r["copies"] for r in mixed}
            assert {i: ids.count(i) for i in set(ids)} == want
        else:
            texts, start, expected = sorted((r["doc_id"], r["text"]) for r in source.collect()), 0, []
            for doc_id, text in texts:
                own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
                expected.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
                start += len(own)
            assert rows_of(docs.select("doc_id", "start", "n_tokens", "ids_crc32")) == sorted(expected, key=str)


def test_run_takes_the_stages_in_order(spark, sf, documents):
    result = corpus_pipeline.run(spark, sf)
    assert result.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert result.select(F.sum("n_tokens")).first()[0] == result.select(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-duplicates", "decontamination", "mixing", "tokens"]


def odd_ids(spark, documents):
    """Rows with null and repeated ids: copies, a near copy, and texts of their own."""
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in ("oak", "elm", "fir", "yew", "ash", "may")]
    ids = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (3, texts[3] + " more"),
           (5, texts[4]), (5, texts[5]), (5, texts[5]), (6, texts[4]), (4, texts[4]), (None, None), (None, None)]
    df = spark.createDataFrame(ids, "doc_id long, text string")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in documents.schema if f.name not in ("doc_id", "text")]
    return texts, df.select("doc_id", "text", *rest).select(documents.columns)


def test_near_duplicates_with_null_and_repeated_ids(spark, sf, documents):
    texts, docs = odd_ids(spark, documents)
    stayed = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    assert stayed.columns == documents.columns
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[3] + " more"), (4, texts[4]), (5, texts[5]), (None, None), (None, None)]
    assert rows_of(stayed.select("doc_id", "text")) == sorted(want, key=str)


def test_decontamination_with_null_and_repeated_ids(spark, sf, documents):
    texts, docs = odd_ids(spark, documents)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    leaked = docs.limit(1).withColumn("text", F.lit(item))
    docs = docs.union(leaked).union(leaked.withColumn("doc_id", F.lit(5).cast("long")))
    stayed = corpus_pipeline.decontamination_stage(spark, docs, sf)
    assert rows_of(stayed.select("doc_id", "text")) == rows_of(docs.filter(~F.col("text").eqNullSafe(item)).select("doc_id", "text"))
