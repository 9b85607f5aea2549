"""A synthetic twin that keeps how columns depend on each other.

The columns are joined by the tree of greatest mutual information, and values are drawn from
the root of the tree down, each one given the value of its parent. Information comes from
grouped counts, draws from hashes of the row's number, so every run gives the same twin.

Values are compared as text and null is a value like any other. Every column costs one join
of the twin's rows so far. A value's range of draws is cut into blocks, and rows meet the
ranges of one block only: neither a frequent value nor a column of unique values makes a
large group.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import draws
from tidemill.operators.index import digits_for, synth_id

#: draws of a parent's value that meet in one join key
BLOCK = 64
#: blocks that are made from one row at a time
STRIDE = 4096


def encoded(column: str) -> Column:
    """The value as text that also tells null from an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def decoded(code: Column, kind: T.DataType) -> Column:
    return F.when(code != "", F.substring(code, 2, 2**31 - 1)).cast(kind)


def pair_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, information): mutual information in nats of every two columns.

    Entropies of the columns and of their pairs come from one grouping of the values.
    """
    pairs = [*((c, c) for c in columns), *combinations(columns, 2)]
    cells = [
        F.struct(
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            encoded(a).alias("value_a"),
            encoded(b).alias("value_b"),
        )
        for a, b in pairs
    ]
    counted = df.select(F.inline(F.array(*cells))).groupBy("column_a", "column_b", "value_a", "value_b")
    n = F.col("n").cast("double")
    spread = (
        counted.agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column_a", "column_b")
        .agg(F.sum("n").cast("double").alias("rows"), F.sum(n * F.ln(n)).alias("weight"))
    )
    # one row per column, and one per pair of columns
    alone = spread.filter("column_a = column_b")
    left = alone.select("column_a", F.col("weight").alias("_a"))
    right = alone.select("column_b", F.col("weight").alias("_b"))
    both = spread.filter("column_a <> column_b").join(left, "column_a").join(right, "column_b")
    shared = F.ln("rows") - (F.col("_a") + F.col("_b") - F.col("weight")) / F.col("rows")
    return both.select("column_a", "column_b", F.greatest(shared, F.lit(0.0)).alias("information"))


def dependency_tree(information: DataFrame, columns: list[str]) -> list[tuple[str, str | None]]:
    """(column, parent) in drawing order, the first column without a parent.

    The driver reads one number per pair of columns. Of equal numbers the earlier columns win.
    """
    known = {}
    for row in information.collect():
        known[row["column_a"], row["column_b"]] = known[row["column_b"], row["column_a"]] = round(row["information"], 9)
    tree: list[tuple[str, str | None]] = [(c, None) for c in columns[:1]]
    while len(tree) < len(columns):
        inside = [c for c, _ in tree]
        edges = [(c, p) for p in inside for c in columns if c not in inside]
        tree.append(max(edges, key=lambda edge: known.get(edge, 0.0)))
    return tree


def draw_ranges(df: DataFrame, parent: str | None, child: str, hex_digits: int = 3) -> DataFrame:
    """(parent, block, child, first, past, mine): which draws of a parent's value give which child value.

    Draws of a parent's value run from 0 to its number of rows, and each child value owns as
    many as it has rows beside that parent's value, in the order of the values' digests.
    `mine` is how many rows the child value has altogether. A range is there once per block.
    """
    above = encoded(parent) if parent else F.lit("")
    counts = df.groupBy(above.alias("parent"), encoded(child).alias("child")).agg(F.count(F.lit(1)).alias("n"))
    placed = counts.withColumn("_digest", F.md5("child")).withColumn("_bucket", F.substring("_digest", 1, hex_digits))
    # earlier values of the bucket, and all earlier buckets, of which there are at most 16^hex_digits
    inside = W.partitionBy("parent", "_bucket").orderBy("_digest").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("parent").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("parent", "_bucket").agg(F.sum("n").alias("_size"))
    starts = sizes.select("parent", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    mine = counts.groupBy("child").agg(F.sum("n").alias("mine"))
    ranges = (
        placed.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, ["parent", "_bucket"])
        .withColumn("first", F.col("_start") + F.col("_local"))
        .withColumn("past", F.col("first") + F.col("n"))
        .join(mine, "child")
    )
    low, high = F.expr(f"first DIV {BLOCK}"), F.expr(f"(past - 1) DIV {BLOCK}")
    # a frequent value has many blocks: they are listed stride by stride
    ranges = ranges.select("parent", "child", "first", "past", "mine", low.alias("_low"), high.alias("_high"))
    strides = ranges.withColumn("_stride", F.explode(F.expr(f"sequence(_low DIV {STRIDE}, _high DIV {STRIDE})")))
    block = F.explode(F.expr(f"sequence(greatest(_low, _stride * {STRIDE}), least(_high, _stride * {STRIDE} + {STRIDE - 1}))"))
    return strides.select("parent", "child", "first", "past", "mine", block.alias("block"))


def dependent_twin(
    df: DataFrame,
    columns: list[str],
    key: str = "reference",
    seed: int = 42,
    tree: list[tuple[str, str | None]] | None = None,
) -> DataFrame:
    """A table as long as `df` with new ids, the given columns, and `is_synthetic`.

    `tree` gives the parents; left out, it is found from the data. Every value and every pair
    of a column and its parent occurs in `df`, about as often as there; combinations of more
    columns are drawn. An empty table gives an empty twin.
    """
    tree = tree or dependency_tree(pair_information(df, columns), columns)
    total = df.count()
    digits = digits_for(total)
    rows = df.sparkSession.range(total).withColumnRenamed("id", "position")
    for column, parent in tree:
        own, rest = f"_code_{column}", f"_rows_{column}"
        above = F.col(f"_code_{parent}") if parent else F.lit("")
        size = F.col(f"_rows_{parent}") if parent else F.lit(total)
        drawn = F.floor(draws.uniform("position", seed, column) * size).cast("bigint")
        ranges = draw_ranges(df, parent, column, digits).withColumnRenamed("child", own).withColumnRenamed("mine", rest)
        rows = (
            rows.withColumns({"_draw": drawn, "parent": above})
            .withColumn("block", F.expr(f"_draw DIV {BLOCK}"))
            .join(ranges, ["parent", "block"])
            .filter("first <= _draw AND _draw < past")
            .drop("parent", "block", "first", "past", "_draw")
        )
    made = [decoded(F.col(f"_code_{c}"), df.schema[c].dataType).alias(c) for c in columns]
    return rows.select(synth_id("position").alias(key), *made, F.lit(True).alias("is_synthetic"))


def pair_distances(real: DataFrame, twin: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, distance): total variation distance of the shares of value pairs."""

    def cells(df: DataFrame, side: int) -> DataFrame:
        pairs = [
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                encoded(a).alias("value_a"),
                encoded(b).alias("value_b"),
            )
            for a, b in combinations(columns, 2)
        ]
        return df.select(F.inline(F.array(*pairs)), F.lit(side).alias("side"))

    both = cells(real, 0).unionAll(cells(twin, 1))
    counted = both.groupBy("column_a", "column_b", "value_a", "value_b").agg(
        F.count_if(F.col("side") == 0).alias("real"), F.count_if(F.col("side") == 1).alias("twin")
    )
    totals = counted.groupBy("column_a", "column_b").agg(F.sum("real").alias("reals"), F.sum("twin").alias("twins"))
    # one row per pair of columns
    shares = counted.join(F.broadcast(totals), ["column_a", "column_b"])
    share = lambda part, whole: F.coalesce(F.col(part) / F.nullif(whole, F.lit(0)), F.lit(0.0))
    gap = F.abs(share("real", "reals") - share("twin", "twins"))
    return shares.groupBy("column_a", "column_b").agg((F.sum(gap) / 2.0).alias("distance"))
