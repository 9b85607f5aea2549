"""Row cleaning and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import fixed, text

_ZERO_BY_TYPE = [
    (T.StringType, ""),
    (T.IntegralType, 0),
    (T.FractionalType, 0.0),
    (T.BooleanType, False),
]


def fill_nulls(df: DataFrame) -> DataFrame:
    """Null to the zero value of its type; NaN, dates, arrays and structs stay as they are."""

    def filled(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        for kind, zero in _ZERO_BY_TYPE:
            if isinstance(field.dataType, kind):
                return F.coalesce(column, F.lit(zero).cast(field.dataType)).alias(field.name)
        return column

    return df.select(*[filled(field) for field in df.schema.fields])


def clean_documents(
    df: DataFrame, text_column: str = "text", min_chars: int = fixed.MIN_TEXT_CHARS
) -> DataFrame:
    """Fill nulls and keep texts longer than the minimum.

    The length test is put on the stored column: a null text fails it just as an empty one
    does, and Parquet can be read with the not-null filter.
    """
    return fill_nulls(df.filter(text.longer_than(text_column, min_chars)))


def head_sample(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """First n rows in key order, nulls first; 0 keeps everything.

    A first pass reads the leading key column alone and finds how far the n rows reach; the
    second is filtered by that key, so a scan skips the files and row groups beyond it. `df`
    is read twice, so it has to be stored or cheap to compute.
    """
    if n <= 0:
        return df
    lead = order_by[0]
    last = df.select(lead).orderBy(lead).limit(n).agg(F.max(lead)).first()[0]
    reached = F.col(lead).isNull() if last is None else F.col(lead).isNull() | (F.col(lead) <= F.lit(last))
    return df.filter(reached).orderBy(*order_by).limit(n)


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[name for name in wanted if name in df.columns])


def require_columns(df: DataFrame, required: list[str], hint: str = "") -> DataFrame:
    """Fail before any job starts, naming what is missing."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}. {hint}".strip())
    return df


def rename_strict(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename, but fail on a name that is not there."""
    return require_columns(df, list(names)).withColumnsRenamed(names)


def apply_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename those columns of an alias map that exist."""
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns})


def default_columns(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Null to a per-column default, for the columns that exist."""
    present = {name: value for name, value in defaults.items() if name in df.columns}
    return df.fillna(present) if present else df


def add_constants(df: DataFrame, **values) -> DataFrame:
    """Constant columns, e.g. one run timestamp for all rows."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def narrow_results(df: DataFrame, key: str = "reference") -> DataFrame:
    """Label results in their stored types. ANSI mode raises on a value that does not fit."""
    types = {name: "tinyint" for name in fixed.LABEL_FIELDS} | {
        "_llm_status": "string",
        "_llm_error": "string",
        "_llm_attempts": "bigint",
        "_llm_fallback_used": "boolean",
    }
    return df.select(key, *[F.col(name).cast(kind).alias(name) for name, kind in types.items()])


def with_confidence(df: DataFrame, status: str = "_llm_status") -> DataFrame:
    return df.withColumn(
        "confidence", F.when(F.col(status) == "success", "high").otherwise("low")
    )


def clean_customers(df: DataFrame) -> DataFrame:
    """Title-case regions, clip spend at 9000, tier by spend."""
    spend = text.cap("spend", 9000.0)
    tier = text.bin_label(
        "spend",
        [0.0, 1000.0, 5000.0, float("inf")],
        ["Low Value", "Medium Value", "High Value"],
    )
    # the clip does not move a row between tiers, so both read the stored column
    return df.withColumns({"region": text.title_case("region"), "spend": spend, "tier": tier})


def _or_missing(df: DataFrame, name: str, default, kind: str = "string") -> Column:
    """A column in its stored type; null, or no such column, gives the default."""
    fallback = F.lit(default).cast(kind)
    return F.coalesce(F.col(name).cast(kind), fallback) if name in df.columns else fallback


def document_objects(df: DataFrame, key: str = "reference", limit: int | None = None) -> DataFrame:
    """What a document search collection stores, one row per document.

    Texts are whole, or their first `limit` characters (`fixed.INDEX_TEXT_CHARS` is usual).
    """
    governor = "is_governor" if "is_governor" in df.columns else "is_gov"
    return df.select(
        key,
        _or_missing(df, "date", "").alias("date"),
        _or_missing(df, "central_bank", "Unknown").alias("central_bank"),
        _or_missing(df, "speaker", "Unknown").alias("speaker"),
        _or_missing(df, "title", "Untitled").alias("title"),
        text.truncate(_or_missing(df, "text", ""), limit).alias("text"),
        *_label_objects(df),
        _or_missing(df, governor, False, "boolean").alias("is_governor"),
        *_vector(df),
    )


def twin_objects(df: DataFrame, key: str = "reference", limit: int | None = None) -> DataFrame:
    """What a synthetic collection stores: the summary instead of the text, always marked.

    Summaries are whole, or their first `limit` characters (`fixed.TWIN_INDEX_CHARS` is usual).
    """
    return df.select(
        key,
        _or_missing(df, "date", "").alias("date"),
        _or_missing(df, "country", "Unknown").alias("country"),
        _or_missing(df, "author", "Unknown").alias("author"),
        _or_missing(df, "title", "Untitled").alias("title"),
        text.truncate(_or_missing(df, "summary", ""), limit).alias("summary"),
        *_label_objects(df),
        _or_missing(df, "is_gov", False, "boolean").alias("is_gov"),
        F.lit(True).alias("is_synthetic"),
        *_vector(df),
    )


def _vector(df: DataFrame) -> list[str]:
    """The vector goes along where the rows carry one."""
    return ["embedding"] if "embedding" in df.columns else []


def _label_objects(df: DataFrame) -> list[Column]:
    columns = []
    for name in fixed.LABEL_FIELDS:
        kind = "boolean" if name == "tariff_mention" else "int"
        columns.append(_or_missing(df, name, fixed.LABEL_FALLBACK[name], kind).alias(name))
    return columns
