"""JSON in model replies to checked values.

A reply is parsed in steps, each its own projection. Catalyst keeps an expensive
expression that a later projection uses more than once where it is, so the text is
searched and the JSON read once per row, however often the fields are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.functions.replies import ordinal, strip_tokens
from tidemill.functions.text import strip, truncate

JSON_OPTIONS = {"allowSingleQuotes": "false"}
FIELDS = "map<string,string>"
TYPED = (
    "monetary_stance string, trade_stance string, tariff_mention bigint, "
    "economic_outlook string, _bad string"
)
WORK = ["_clean", "_part", "_fields", "_typed", "_values", "_variant", "_kinds", "_rescued"]


def _no_json(reply: str, limit: int) -> Column:
    return F.concat(F.lit("No JSON found in response: "), truncate(reply, limit), F.lit("..."))


def _with_part(df: DataFrame, reply: str) -> DataFrame:
    """_part: from the first `{` on, without tokens. What follows the object is not read."""
    start = F.locate("{", F.col("_clean"))
    return df.withColumn("_clean", strip_tokens(reply)).withColumn(
        "_part", F.when(start > 0, F.col("_clean").substr(start, F.length("_clean")))
    )


def _with_fields(df: DataFrame, part: str = "_part") -> DataFrame:
    """_fields: values as text, nested ones as JSON text; of a repeated key the last."""
    return df.withColumn("_fields", F.from_json(part, FIELDS, JSON_OPTIONS))


def parse_json(df: DataFrame, reply: str, into: str = "parsed") -> DataFrame:
    """Adds struct(fields map<string,string>, error): the first JSON object of a noisy text."""
    read = _with_fields(_with_part(df, reply))
    error = F.when(F.col("_part").isNull(), _no_json(reply, 200)).when(
        F.col("_fields").isNull(), F.lit("Invalid JSON")
    )
    result = F.struct(F.col("_fields").alias("fields"), error.alias("error"))
    return read.withColumn(into, result).drop(*WORK)


def _label_values(source: str, scales: list[dict[str, int]], flag: Column) -> Column:
    """Ordinals and flag, null where the value is none of the allowed ones."""
    names = ["monetary_stance", "trade_stance", "economic_outlook"]
    read = [ordinal(F.col(source)[n], s).alias(n) for n, s in zip(names, scales)]
    return F.struct(*read, flag.alias("tariff_mention"))


def _label_result(error: Column, into: str, read: DataFrame) -> DataFrame:
    kept = [
        F.when(F.col("_error").isNull(), F.col(f"_values.{name}")).cast("int").alias(name)
        for name in fixed.LABEL_FIELDS
    ]
    judged = read.withColumn("_error", error)
    result = F.struct(*kept, F.col("_error").alias("error"))
    return judged.withColumn(into, result).drop("_error", *WORK)


def parse_labels(df: DataFrame, reply: str, into: str = "parsed") -> DataFrame:
    """Adds struct(four ordinals, error): enum strings as spelled, flag the JSON number 0 or 1.

    The bigint field turns down "1", true and 1.0, and an enum never equals the text of a
    number, list or object, so no value is coerced.
    """
    read = _with_part(df, reply).withColumn(
        "_typed", F.from_json("_part", TYPED, JSON_OPTIONS | {"columnNameOfCorruptRecord": "_bad"})
    )
    typed = F.col("_typed")
    flag = F.when(typed["tariff_mention"].isin(0, 1), typed["tariff_mention"])
    scales = [fixed.STRICT_MONETARY, fixed.STRICT_TRADE, fixed.STRICT_OUTLOOK]
    read = read.withColumn("_values", _label_values("_typed", scales, flag))
    values = F.col("_values")
    # a value of the wrong type marks the record too, but leaves the other fields
    anything = F.coalesce(*[typed[name].cast("string") for name in fixed.LABEL_FIELDS])
    broken = typed["_bad"].isNotNull() & anything.isNull()
    error = (
        F.when(F.col("_part").isNull(), _no_json(reply, 200))
        .when(broken & F.from_json("_part", FIELDS, JSON_OPTIONS).isNull(), "Invalid JSON")
        .when(values["monetary_stance"].isNull(), "Invalid monetary_stance")
        .when(values["trade_stance"].isNull(), "Invalid trade_stance")
        .when(values["tariff_mention"].isNull(), "Invalid tariff_mention")
        .when(values["economic_outlook"].isNull(), "Invalid economic_outlook")
    )
    return _label_result(error, into, read)


def parse_labels_leniently(df: DataFrame, reply: str, into: str = "parsed") -> DataFrame:
    """Adds struct(four ordinals, error): first flat `{...}`, seven spellings, flag also as text."""
    flat = F.nullif(F.regexp_extract(reply, r"\{[^}]+\}", 0), F.lit(""))
    read = _with_fields(df.withColumn("_part", flat))
    text = F.col("_fields")["tariff_mention"]
    as_boolean = F.from_json("_part", "tariff_mention boolean", JSON_OPTIONS)["tariff_mention"]
    as_number = F.from_json("_part", "tariff_mention double", JSON_OPTIONS)["tariff_mention"]
    flag = (
        F.when(text.isin("0", "1"), text.try_cast("int"))
        .when(text.isin("true", "false"), as_boolean.cast("int"))
        .when(as_number.isin(0.0, 1.0), as_number.cast("int"))
    )
    scales = [fixed.LENIENT_MONETARY, fixed.LENIENT_TRADE, fixed.LENIENT_OUTLOOK]
    read = read.withColumn("_values", _label_values("_fields", scales, flag))
    fields, values = F.col("_fields"), F.col("_values")
    missing = F.filter(
        F.array(*[F.lit(name) for name in fixed.LABEL_FIELDS]),
        lambda name: ~F.map_contains_key(fields, name),
    )

    def invalid(name: str) -> Column:
        shown = F.coalesce(fields[name], F.lit("None"))
        return F.concat(F.lit(f"Invalid {name}: "), shown)

    listed = F.concat(F.lit("['"), F.array_join(missing, "', '"), F.lit("']"))
    error = (
        F.when(F.col("_part").isNull(), _no_json(reply, 100))
        .when(fields.isNull(), F.lit("Invalid JSON"))
        .when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), listed))
        .when(values["monetary_stance"].isNull(), invalid("monetary_stance"))
        .when(values["trade_stance"].isNull(), invalid("trade_stance"))
        .when(values["economic_outlook"].isNull(), invalid("economic_outlook"))
        .when(values["tariff_mention"].isNull(), invalid("tariff_mention"))
    )
    return _label_result(error, into, read)


def parse_summary(
    df: DataFrame, reply: str, into: str = "parsed", limit: int | None = None
) -> DataFrame:
    """Adds struct(summary, error) from a reply holding `reasoning` and `summary`.

    Two strings with a summary of 50 to `limit` characters pass as they are. Otherwise the
    summary alone is rescued: a list becomes bullet lines, other values their text, cut to
    `limit` (`fixed.SUMMARY_OBJECT_CHARS` is usual). Without a limit nothing is too long.
    """
    read = _with_fields(_with_part(df, reply)).withColumn("_variant", F.try_parse_json("_part"))

    def kind(name: str) -> Column:
        value = F.try_variant_get("_variant", f"$.{name}", "variant")
        return F.coalesce(F.schema_of_variant(value), F.lit("")).alias(name)

    read = read.withColumn("_kinds", F.struct(kind("reasoning"), kind("summary")))
    kinds, text = F.col("_kinds"), F.col("_fields")["summary"]
    items = F.filter(
        F.from_json(text, "array<string>", JSON_OPTIONS),
        lambda item: F.coalesce(item, F.lit("")) != "",
    )
    bullets = F.array_join(
        F.transform(
            items,
            lambda item: F.when(item.startswith("•"), item).otherwise(
                F.concat(F.lit("• "), item)
            ),
        ),
        "\n",
    )
    is_list = kinds["summary"].startswith("ARRAY")
    read = read.withColumn("_rescued", F.when(is_list, bullets).otherwise(strip(text)))
    passes = F.coalesce(
        (kinds["reasoning"] == "STRING")
        & (kinds["summary"] == "STRING")
        & (F.length(text) >= fixed.SUMMARY_MIN_CHARS)
        & (F.lit(True) if limit is None else F.length(text) <= limit),
        F.lit(False),
    )
    rescued = F.col("_rescued")
    too_short = F.coalesce(F.length(rescued), F.lit(0)) < fixed.SUMMARY_MIN_CHARS
    error = (
        F.when(F.col("_part").isNull(), _no_json(reply, 200))
        .when(F.col("_fields").isNull(), F.lit("Invalid JSON"))
        .when(~passes & too_short, F.lit("Invalid summary response"))
    )
    value = F.when(passes, text).otherwise(truncate(rescued, limit))
    judged = read.withColumn("_error", error).withColumn("_value", value)
    result = F.struct(
        F.when(F.col("_error").isNull(), F.col("_value")).alias("summary"),
        F.col("_error").alias("error"),
    )
    return judged.withColumn(into, result).drop("_error", "_value", *WORK)
