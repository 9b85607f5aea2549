"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import alignment, decontaminate, language, mixing, neardup, pii, prefixes, quality, scoring, sentencepieces, suffixes, tokens, warc
from tidemill.llm.common import table
from tidemill.session import work_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))  # a null key is not held out


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents.filter(~held_out("doc_id")), "text", "lang", "doc_id")
    return language.predict(documents, "text", model, [F.col("doc_id"), held_out("doc_id").alias("held_out")])


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = quality.learn(documents, "text", "doc_id", labels, "quality")
    counted = quality.text_statistics(documents, "text", [F.col("doc_id")])
    for name, ratio in quality.features().items():
        counted = counted.withColumn(name, ratio)
    return counted.select(
        "doc_id", *quality.COUNTS[:5], quality.base_failed().alias("base_failed"),
        (~quality.base_failed() & quality.verdict(rules)).alias("kept"),
    )


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_leaks(documents, "doc_id", "text", benchmark, "item_id", "text", leak_settings())


def leak_settings() -> decontaminate.LeakSettings:
    return decontaminate.LeakSettings(short_documents=True)


@query("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html", path)
    return warc.read_archives(spark, path, payloads=False).drop("payload", "url")


def token_settings() -> tokens.TokenSettings:
    import public_tokenizers

    return tokens.TokenSettings(tokenizer=public_tokenizers.path(TOKENIZER))


@query("op5_token_ids")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", path, token_settings())
    return tokens.read_tokens(spark, path)


@query("op6_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", neardup.NearSettings(shingle=4))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("op8_repeated_strings")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_mixing", mixing.mix_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").filter("quality = 1")
    return scoring.score_words(table(spark, sf_dir, "documents"), "doc_id", "text", target, "doc_id")


def piece_settings() -> sentencepieces.PieceSettings:
    import public_tokenizers

    return sentencepieces.PieceSettings(model=public_tokenizers.path(PIECES))


@query("op11_sentencepiece")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = piece_settings()
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), "doc_id", "text", settings)
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return sentencepieces.decode(encoded, settings).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def align_settings() -> alignment.AlignSettings:
    import public_tokenizers

    return alignment.AlignSettings(a=public_tokenizers.path(TOKENIZER), b=public_tokenizers.path(PIECES))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = align_settings()
    aligned = alignment.align(table(spark, sf_dir, "documents"), "doc_id", "text", settings)
    return alignment.score(aligned, alignment.link_counts(aligned, settings), settings)


@query("op13_conversation_trie", prefixes.TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefixes.rebuild(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return prefixes.trie(rebuilt)
