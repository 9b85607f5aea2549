"""Mixing sources to target weights by systematic sampling.

Every source has a weight and a cap on how often its words may be repeated. Targets share
all words by weight; what a capped source cannot take is reshared among the others by
weight until none is above its cap, which is the level at which the capped shares add up.
Within a source every document expects the same number of copies, target / size of the
source. Running sums of these expectations, in an order that goes by size band first, are
shifted by one random offset per source, and a document is emitted once for each whole
number that its stretch of the sum crosses.

No task sees a whole source: a document's position is the number of documents in earlier
(band, bucket) cells of its source, of which there are at most 64 x 4096, plus its rank
inside its own cell.

Defined results: a null text has size 0 and is emitted like any other of its source without
adding words; a null source is a source of its own, last in the order of weights; a source
without words has target 0. Repeated rows each count. An empty table gives an empty result.
Everything is decided by digests of keys, so reruns agree on any cluster; rows that share a
key are told apart by a digest of their text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, numbered


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)  # of the sources by code point, repeating
    most_copies: float = 3.0
    seed: int = 17


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of the parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, settings: MixSettings | None = None) -> DataFrame:
    """source, source_size, target from rows (source, size): one row per source.

    The level at which capped shares add up to all words: with sources in the order of
    cap / weight, it is the first (all - caps before) / (weights from here on) that does not
    exceed the source's own cap / weight; from there on the fractions fall, so it is also the
    largest of those that do not.
    """
    s = settings or MixSettings()
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, s.weights)), (place % len(s.weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(s.most_copies))
    ratio, order = F.col("cap") / F.col("weight"), W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    sources = sources.withColumn("ratio", ratio).withColumn("level", left / F.sum("weight").over(onwards))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), level * F.col("weight"))
    return sources.select("source", "source_size", F.coalesce(target, F.col("cap")).alias("target"))


def mix(docs: DataFrame, key: str, text: str, source: str, settings: MixSettings | None = None, carried: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and what is `carried` for every row of `docs`."""
    s = settings or MixSettings()
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *carried)
    rows = rows.withColumn("band", F.floor(F.log2(F.col("size") + 1) * 4).cast("int")).withColumn(
        "bucket", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 3)
    )
    return place_copies(rows, source_targets(rows, s), s)


def place_copies(rows: DataFrame, targets: DataFrame, s: MixSettings) -> DataFrame:
    carried = [c for c in rows.columns if c not in ("doc_id", "source", "size", "band", "bucket")]
    cells = rows.groupBy("source", "band", "bucket").agg(F.count("*").alias("n"))
    running = W.partitionBy("source").orderBy("band", "bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    cells = cells.join(targets, cells["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    cell = W.partitionBy("source", "band", "bucket").orderBy("size", "doc_id", *carried)
    ranked = rows.withColumn("rank", F.row_number().over(cell) - 1)
    same = ranked["source"].eqNullSafe(cells["source"]) & (ranked["band"] == cells["band"]) & (ranked["bucket"] == cells["bucket"])
    placed = ranked.join(cells, same).select(
        "doc_id", ranked["source"], "size", "source_size", "target", *carried, (F.col("before") + F.col("rank")).alias("place")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = draw(F.lit(str(s.seed)), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    crossed = F.floor((F.col("place") + 1) * rate + offset) - F.floor(F.col("place") * rate + offset)
    return placed.withColumn("copies", crossed.cast("bigint")).drop("place")


def emit(docs: DataFrame, key: str, text: str, source: str, settings: MixSettings | None = None) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; keys may be null or repeated."""
    rows = numbered(docs, "mix-rows")
    digest = F.xxhash64(F.col(text)).alias("_digest")
    chosen = mix(rows, key, text, source, settings, (digest, F.col("_row"))).filter("copies > 0")
    chosen = chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return rows.join(chosen, "_row").drop("_row", "_copy")


def mix_sql(s: MixSettings | None = None) -> str:
    """The same result in SQL, over documents (doc_id, text, source)."""
    s = s or MixSettings()
    weights = ", ".join(f"{w!r}::double" for w in s.weights)
    return f"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), cells AS (
  SELECT *, floor(log2(size + 1) * 4)::int AS band, substr(md5(coalesce(doc_id::varchar, 'null')), 1, 3) AS bucket FROM rows
), sums AS (
  SELECT source, sum(size)::bigint AS source_size FROM rows GROUP BY source
), weighted AS (
  SELECT *, [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(s.weights)} + 1)::int] AS weight,
    source_size * {s.most_copies!r}::double AS cap FROM sums
), levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted
), targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT max(level) FROM levels WHERE level <= ratio) * weight), cap) AS target FROM levels
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, bucket, size, doc_id) - 1 AS place FROM cells
), rated AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{s.seed}:' || coalesce('s' || p.source, 'null')), 1, 8))::bigint / 4294967296.0::double AS shift
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::bigint AS size, source_size, target,
  (floor((place + 1) * rate + shift) - floor(place * rate + shift))::bigint * size AS taken FROM rated
"""
