"""A generated customer table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import draws

# Fixed values.
REGIONS = ["North", "South", "East", "West", "Central"]
CATEGORIES = ["Premium", "Standard", "Basic"]


def sample_customers(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """Ids CUST-0000.., age 18 to 75, spend 100 to 10000 at two places, four in five active."""

    def draw(label: str) -> Column:
        return draws.uniform("id", seed, label)

    def pick(values: list[str], label: str) -> Column:
        options = F.array(*[F.lit(v) for v in values])
        return F.element_at(options, F.floor(draw(label) * len(values)).cast("int") + 1)

    return spark.range(n).select(
        F.format_string("CUST-%04d", "id").alias("id"),
        F.format_string("Customer %d", "id").alias("name"),
        (F.floor(draw("age") * 58) + 18).cast("int").alias("age"),
        pick(REGIONS, "region").alias("region"),
        pick(CATEGORIES, "category").alias("category"),
        F.round(draw("spend") * 9900.0 + 100.0, 2).alias("spend"),
        (draw("active") > 0.2).alias("active"),
    )
