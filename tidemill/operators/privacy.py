"""How close a synthetic table is to its source. Definitions are this package's own.

membership resistance   1 - share of synthetic rows whose attributes equal a real row's
inference resistance    1 - share of real rows whose target the twin gives away, that is
                        the twin's most frequent target for the row's quasi-identifiers
quality                 1 - mean over columns of the total variation distance of values
closest record          number of attributes in which a row differs from the nearest record
All counts are grouped before they are joined, so frequent values cost one row each.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.dependent import decoded, encoded
from tidemill.session import delete_path, work_dir

#: two to the power of so many parts of a record are compared
MOST_ATTRIBUTES = 12


def _grouped(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def _record_digest(df: DataFrame, attributes: list[str]) -> tuple[Column, list[str]]:
    """SHA-256 of a record's plain values, so that long texts are compared without moving, and the columns it leaves out."""
    plain = (T.StringType, T.IntegralType, T.DecimalType, T.FractionalType, T.BooleanType, T.DateType, T.BinaryType)
    taken = [c for c in attributes if isinstance(df.schema[c].dataType, plain)]
    parts = []
    for c in taken:
        kind = df.schema[c].dataType
        # -0.0 equals 0.0
        value = F.col(c) + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(c)
        value = F.hex(c) if isinstance(kind, T.BinaryType) else value.cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    digest = F.unhex(F.sha2(F.concat(F.lit(""), *parts).cast("binary"), 256))
    return digest.alias("_record"), [c for c in attributes if c not in taken]


def leak_rate(real: DataFrame, twin: DataFrame, attributes: list[str]) -> DataFrame:
    """twin_rows, leaked_rows, leak_rate of exact attribute matches; null equals null."""
    short, others = _record_digest(real, attributes)
    sides = real.select(*others, short, F.lit(0).alias("_n"), F.lit(1).alias("_real")).unionAll(
        twin.select(*others, short, F.lit(1).alias("_n"), F.lit(0).alias("_real"))
    )
    groups = sides.groupBy(*others, "_record").agg(
        F.sum("_n").alias("n"), F.max("_real").alias("known")
    )
    counted = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("twin_rows"),
        F.coalesce(F.sum(F.col("n") * F.col("known")), F.lit(0)).alias("leaked_rows"),
    )
    rate = F.coalesce(F.col("leaked_rows") / F.nullif("twin_rows", F.lit(0)), F.lit(0.0))
    return counted.withColumn("leak_rate", rate)


def inference_rate(
    real: DataFrame, twin: DataFrame, quasi: list[str], target: str
) -> DataFrame:
    """real_rows, guessed_rows, inference_rate when guessing the target from the twin.

    The guess is the twin's most frequent target among rows with the same
    quasi-identifiers, the smallest one on a tie; without such rows there is no guess.
    """
    votes = _grouped(twin.filter(F.col(target).isNotNull()), [*quasi, target], "votes")
    best = votes.groupBy(*[F.col(q).alias(f"_q_{q}") for q in quasi]).agg(
        F.min(F.struct((-F.col("votes")).alias("v"), F.col(target).alias("guess"))).alias("best")
    )
    truth = _grouped(real, [*quasi, target], "n")
    same = reduce(lambda a, b: a & b, [F.col(q).eqNullSafe(F.col(f"_q_{q}")) for q in quasi])
    hit = F.col(target).eqNullSafe(F.col("best.guess")) & F.col("best").isNotNull()
    counted = truth.join(best, same, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("real_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.lit(0)).alias("guessed_rows"),
    )
    rate = F.coalesce(F.col("guessed_rows") / F.nullif("real_rows", F.lit(0)), F.lit(0.0))
    return counted.withColumn("inference_rate", rate)


def marginal_distances(real: DataFrame, twin: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distance): total variation distance of the value shares, 0 equal to 1 apart."""

    def cells(df: DataFrame, side: int) -> DataFrame:
        pairs = F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        )
        return df.select(pairs.alias("cell"), F.lit(side).alias("side")).select("cell.*", "side")

    both = cells(real, 0).unionAll(cells(twin, 1))
    counted = both.groupBy("column", "value").agg(
        F.count_if(F.col("side") == 0).alias("real"), F.count_if(F.col("side") == 1).alias("twin")
    )
    totals = counted.groupBy("column").agg(
        F.sum("real").alias("real_total"), F.sum("twin").alias("twin_total")
    )
    # one row per column of the table
    shares = counted.join(F.broadcast(totals), "column")
    gap = F.abs(
        F.coalesce(F.col("real") / F.nullif("real_total", F.lit(0)), F.lit(0.0))
        - F.coalesce(F.col("twin") / F.nullif("twin_total", F.lit(0)), F.lit(0.0))
    )
    return shares.groupBy("column").agg((F.sum(gap) / 2.0).alias("distance"))


def closest_record(df: DataFrame, records: DataFrame, attributes: list[str]) -> DataFrame:
    """The attributes of `df` once each, `rows` that have them, and `distance` to the nearest record.

    Two rows that differ in d attributes agree on all the others, so it is enough to look up
    the parts of a row: all attributes, then all but one, and so on down. Equal rows are
    counted first, a part is looked up among the distinct parts of the records, and only rows
    without a hit go on to smaller parts. Without records the distance is null.
    """
    if len(attributes) > MOST_ATTRIBUTES:
        raise ValueError(f"at most {MOST_ATTRIBUTES} attributes, got {len(attributes)}")
    spark, width = df.sparkSession, len(attributes)
    values = F.array(*map(encoded, attributes)).alias("values")
    folder = work_dir(spark, "closest")

    def written(part: DataFrame, name: str) -> DataFrame:
        part.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    todo = written(df.groupBy(values).agg(F.count(F.lit(1)).alias("rows")), "rows")
    known = written(records.select(values).distinct(), "records")
    empty, found = known.isEmpty(), []
    for agreeing in range(width if not empty else 0, 0, -1):
        # a star never is a value's code
        parts = F.explode(
            F.array(*[
                F.array(*[F.element_at("values", i + 1) if i in kept else F.lit("*") for i in range(width)])
                for kept in combinations(range(width), agreeing)
            ])
        ).alias("part")
        hits = todo.select("values", parts).join(known.select(parts).distinct(), "part", "left_semi")
        hits = hits.select("values").distinct().withColumn("hit", F.lit(True))
        marked = written(todo.join(hits, "values", "left"), f"agreeing-{agreeing}")
        found.append(marked.filter("hit").select("values", "rows", F.lit(width - agreeing).alias("distance")))
        todo = marked.filter("hit IS NULL").drop("hit")
    last = F.lit(None if empty else width).cast("int").alias("distance")
    settled = reduce(DataFrame.unionAll, found, todo.select("values", "rows", last))
    for name in ("rows", "records"):
        if not empty and width:
            delete_path(spark, f"{folder}/{name}")
    back = [decoded(F.element_at("values", i + 1), df.schema[c].dataType).alias(c) for i, c in enumerate(attributes)]
    return settled.select(*back, "rows", "distance")


def closeness(sides: dict[str, DataFrame], records: DataFrame, attributes: list[str]) -> DataFrame:
    """(part, distance, rows) of several tables against the same records.

    A twin should not be nearer to the records it was made from than rows that were held out.
    """
    counted = [
        closest_record(df, records, attributes)
        .groupBy("distance")
        .agg(F.sum("rows").alias("rows"))
        .select(F.lit(part).alias("part"), "distance", "rows")
        for part, df in sides.items()
    ]
    return reduce(DataFrame.unionAll, counted)


def scores(
    real: DataFrame,
    twin: DataFrame,
    attributes: list[str],
    quasi: list[str],
    target: str,
    columns: list[str],
) -> dict:
    """mia_score, aia_score, quality_score and privacy_passed (mean privacy above 0.7)."""
    leak = leak_rate(real, twin, attributes).first()
    guess = inference_rate(real, twin, quasi, target).first()
    gap = marginal_distances(real, twin, columns).agg(F.avg("distance")).first()[0]
    mia, aia = 1.0 - leak["leak_rate"], 1.0 - guess["inference_rate"]
    return {
        "mia_score": mia,
        "aia_score": aia,
        "quality_score": 1.0 - (gap or 0.0),
        "privacy_passed": (mia + aia) / 2.0 > 0.7,
    }


def evaluation_report(
    real: DataFrame, twin: DataFrame, scored: dict, generated_at: str, job_id: str = "", least_holdout: int = 0
) -> DataFrame:
    """One row: sizes, scores (a missing one is 0), the verdict, columns and version tags."""
    inputs, total = real.count(), twin.count()
    row = {
        "total_records": total,
        "input_records": inputs,
        "mia_score": float(scored.get("mia_score") or 0),
        "aia_score": float(scored.get("aia_score") or 0),
        "quality_score": float(scored.get("quality_score") or 0),
        "privacy_passed": bool(scored.get("privacy_passed", False)),
        "job_id": job_id,
        "generated_at": generated_at,
        "synthesis_type": "metadata-classification-summary-based",
        "synthesis_columns": list(real.columns),
        "includes_summary": "summary" in real.columns,
        "holdout_disabled": inputs < least_holdout,
        "report_version": "3.0",
        "report_type": "synthetic-twin-evaluation",
    }
    schema = (
        "total_records bigint, input_records bigint, mia_score double, aia_score double, "
        "quality_score double, privacy_passed boolean, job_id string, generated_at string, "
        "synthesis_type string, synthesis_columns array<string>, includes_summary boolean, "
        "holdout_disabled boolean, report_version string, report_type string"
    )
    return twin.sparkSession.createDataFrame([row], schema)
