"""Customer table: cleaned, a sample enriched with profiles, summarized as a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import clean, scoring, stats
from tidemill.sources import files

SPREAD = ["region", "tier"]
LISTED = 10_000  # values of a column that the report itself lists


def enrich_customers(
    customers: DataFrame, profile: Callable[[DataFrame], DataFrame], key: str = "id"
) -> DataFrame:
    return scoring.enrich_sample(clean.clean_customers(customers), profile, key)


def customer_report(enriched: DataFrame, listed: int = LISTED) -> DataFrame:
    """One row: totals, and of region and tier the number of values and the distribution as a map.

    A map has an entry per value and is null for a column of more than `listed` values;
    `stats.distributions` has all of them as rows.
    """
    spread = stats.distributions(enriched, SPREAD)
    sizes = spread.groupBy("column").agg(F.count(F.lit(1)).alias("values"))
    # one row per column of SPREAD, so at most `listed` entries a column are gathered
    entries = spread.join(F.broadcast(sizes), "column").withColumn(
        "entry", F.when(F.col("values") <= listed, F.struct(F.col("value"), F.col("count")))
    )

    def columns(name: str):
        mine = F.col("column") == name
        values = F.coalesce(F.max(F.when(mine, F.col("values"))), F.lit(0))
        entry = F.map_from_entries(F.array_sort(F.collect_list(F.when(mine, F.col("entry")))))
        return (
            values.alias(f"{name}_values"),
            F.when(values <= listed, entry).alias(f"{name}_distribution"),
        )

    found = [c for name in SPREAD for c in columns(name)]
    maps = entries.agg(*found).withColumn("_one", F.lit(1))
    totals = stats.customer_summary(enriched).withColumn("_one", F.lit(1))
    return totals.join(maps, "_one").drop("_one")


def run_customers(
    customers: DataFrame,
    profile: Callable[[DataFrame], DataFrame],
    folder: str,
    key: str = "id",
    log: Callable[[str], None] = print,
) -> dict:
    """A report that cannot be stored is still returned, with the reason.

    The whole distributions are stored as a table beside it, in `folder` + "-distributions".
    """
    enriched = enrich_customers(customers, profile, key)
    report = customer_report(enriched)
    row = report.first().asDict(recursive=True)
    try:
        files.write_report(report, folder)
        spread = stats.distributions(enriched, SPREAD)
        spread.write.mode("overwrite").parquet(f"{folder.rstrip('/')}-distributions")
        problem = None
    except Exception as failure:  # noqa: BLE001
        problem = str(failure)
        log(f"report not stored: {problem}")
    return {**row, "storage_error": problem}
